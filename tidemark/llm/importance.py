"""Importance resampling of documents towards a target set, by hashed runs of words.

A text's A-Z are lowered and its separators collapsed to single spaces. Overlapped scanning with boundary
lookarounds gives, at every word, the span of the longest run of up to `longest` words; the shorter runs begin
there too and end in front of the next words' spans. A run's feature is the CRC-32 of its bytes modulo `buckets`.
A bucket's gain is the logarithm of its share among the target's features over its share among all documents',
each count with one added; a document's weight is the sum over its features. With Gumbel noise from its id added,
the highest scores are a draw without replacement in proportion to exp(weight).

Texts are scanned once: a document's buckets are stored in ascending order as differences, a byte each in most,
and both the counts and the weights are taken from these. Every task hands on one number a bucket, and the driver
gets one gain a bucket. Ranks come from one range partitioning by score, without a window over all rows.

Defined results: a null or empty text, or one without words, has no features and weight 0; only documents with
at least `min_words` words can be drawn; equal scores go to the smaller id, a null id first, and of rows that agree
in both to any one; repeated rows each count, with the same score; a null id's noise is that of the text "null";
an empty target gives each bucket the gain of no evidence; empty documents give an empty table; further columns
are not looked at; very long texts are scanned in pieces of STEP words, which changes no result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, stored

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
STEP = 1 << 16
#: Letters lowered, and a space for every byte that is neither a letter, a digit nor beyond ASCII.
COLLAPSED = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def runs_of(longest: int) -> regex.Pattern:
    """A word with up to longest - 1 words behind it, between spaces."""
    return regex.compile(rb"(?<= )[^ ]+(?: [^ ]+){0,%d}(?= )" % (longest - 1))


def spans(line: bytes, pattern: regex.Pattern, longest: int) -> Iterator[tuple[list[int], list[int]]]:
    """For one word, two and so on: where runs of so many words begin and end in `line`, which has single spaces
    between its words and one at either end."""
    found = [m.span() for m in pattern.finditer(line, overlapped=True)]
    begins = [b for b, _ in found]
    for n in range(1, min(longest, len(found)) + 1):
        yield begins, [b - 1 for b in begins[n:]] + [found[-1][1]]


def features(text: bytes, pattern: regex.Pattern, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs in ascending order."""
    words = text.translate(COLLAPSED).split()
    crc, parts = zlib.crc32, []
    for at in range(0, len(words), STEP):
        line = b" %b " % b" ".join(words[at : at + STEP + longest - 1])
        for begins, ends in spans(line, pattern, longest):
            parts.append(np.fromiter((crc(line[b:e]) for b, e in zip(begins[:STEP], ends)), np.uint32))
    found = np.concatenate(parts) % np.uint32(buckets) if parts else np.zeros(0, np.uint32)
    found.sort()
    return len(words), found


def coded(found: np.ndarray) -> bytes:
    """Differences of ascending buckets, a byte each where all fit, else four."""
    steps = np.diff(found, prepend=np.uint32(0))
    return steps.astype(np.uint8 if not len(steps) or steps.max() < 256 else "<u4").tobytes()


def decoded(code: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(code, np.uint8 if len(code) == n else "<u4"), dtype=np.int64)


def scanned(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, code (the buckets) for each document; stored once."""
    bounded_batches(docs.sparkSession)

    def scan(batches):
        claim("importance")
        pattern = runs_of(longest)
        for b in batches:
            found = [features(t or b"", pattern, longest, buckets) for t in b.column("text").to_pylist()]
            arrays = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64()), pa.array([coded(f) for _, f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names=["doc_id", "n_words", "n_features", "code"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return stored(given.mapInArrow(scan, f"doc_id {kind}, n_words long, n_features long, code binary"), "run-buckets")


def counts(found: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features of the table of scanned() each bucket has."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for code, n in zip(b.column("code").to_pylist(), b.column("n_features").to_pylist()):
                total += np.bincount(decoded(code, n), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    out = [0] * buckets
    for bucket, n in found.select("n_features", "code").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(all_counts: list[int], target_counts: list[int]) -> np.ndarray:
    """A bucket's gain in thousandths, rounded down."""
    buckets = len(all_counts)
    s_all, t_all = float(sum(all_counts) + buckets), float(sum(target_counts) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(all_counts, target_counts)], np.int64)


def scored(found: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for each row of scanned()."""

    def weigh(batches):
        for b in batches:
            pairs = zip(b.column("code").to_pylist(), b.column("n_features").to_pylist())
            weight = pa.array([int(gain[decoded(code, n)].sum()) for code, n in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), weight], names=["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    weighed = found.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (1 for the first drawn; null if not drawn) for each document."""
    spark = docs.sparkSession
    found = scanned(docs, longest, buckets, id_col, text_col)
    wanted = scanned(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), longest, buckets, "id", "text")
    rows = stored(scored(found, gains(counts(found, buckets), counts(wanted, buckets)), seed), "scores")
    # in order of the draw over all partitions; where a row stands in its own is the low part of its number
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_first("doc_id")]
    able = rows.withColumn("able", F.col("n_words") >= min_words)
    placed = stored(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "draw")
    part = F.shiftright("at", 33)
    before, drawn = [], 0
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).orderBy("part").collect()
    for r in sizes:  # a row a partition
        before.append((r["part"], drawn))
        drawn += r["n"]
    most = percent * sum(r["able"] for r in sizes) // 100
    starts = F.broadcast(spark.createDataFrame(before, "part long, start long"))
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    numbered = placed.withColumn("part", part).join(starts, "part").withColumn("rank", rank)
    return numbered.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("able") & (F.col("rank") <= most), F.col("rank")).alias("rank"))
