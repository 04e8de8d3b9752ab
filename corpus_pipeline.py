"""A corpus pipeline of five stages over `documents`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.

Defined results: language identification drops null and empty texts, and texts without letters. Of a
class of near copies one row stays, the one with the least id (null is the least, then the text's digest
decides, and of equal rows any one). A null n_chars stays null, others follow the text. A document of which
substring dedup leaves nothing goes. Very long texts are worked on whole by every stage. Empty tables give
empty tables. Further columns are passed through by all but the last stage, whatever their names, unless
these begin with two underscores.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bag_minhash, decontaminate, language_id, line_dedup, packing
from tidemark.llm.common import discard_at_end, documents, noting_tables, release, shared_dir

#: A document goes if its best language has less than this part of the posterior.
MIN_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last = threading.local()  # the tables of this thread's last stage


def _cleared(spark: SparkSession) -> list[str]:
    if not hasattr(_last, "tables"):
        _last.tables = []
    release(spark, _last.tables)
    return _last.tables


def stage(f: Stage) -> Stage:
    """A stage begins when what the one before returned has been written: its tables can go."""

    @functools.wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with noting_tables(_cleared(spark)):
            return f(spark, docs, sf_dir)

    return begin


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in which no language prevails, go."""
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = language_id.predict(docs, model)
    return found.filter((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= MIN_SCORE)).drop("__language")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the document with the least id stays."""
    found = bag_minhash.classes(docs)
    heads = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("v") == F.col("head")))
    heads = heads.select(F.col("doc_id").alias("__id"), F.col("v").alias("__head")).distinct()
    keyed = docs.withColumn("__v", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept = keyed.join(heads, keyed["doc_id"].eqNullSafe(heads["__id"]) & (keyed["__v"] == heads["__head"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__v"]).drop("__v")


@stage
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; a document of which nothing is left goes."""
    found = line_dedup.dedup_lines(docs)
    changed = found.filter(F.col("__removed").isNull() | (F.trim("__kept") != "")).withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("__removed").isNull() | F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.select(docs.columns)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row go."""
    found = decontaminate.contamination(docs, documents(spark, sf_dir, "benchmark")).filter("contaminated")
    hit = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(hit, keyed["doc_id"].eqNullSafe(hit["__id"]) & (keyed["__key"] == hit["__hash"]), "left_anti").drop("__key")


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language identification", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_lines),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", pack),
]

#: Language models, signatures and packing are beyond SQL; each stage is held against brute force in its tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        release(spark, [f"{base}/{k - 1}"] if k else [])
    _cleared(spark)
    discard_at_end(spark, base)
    return docs
