"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_minhash, byte_dedup, decontaminate, importance, language_id, line_dedup, log_bilinear, packing, quality, token_counts, token_ids, transcripts, whitening
from .common import documents, stored


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed (units), chars_removed, removed (start-stop character offsets), kept (the text left)."""
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    gone = F.coalesce("__removed", F.array().cast(found.schema["__removed"].dataType))
    return found.select(
        "doc_id",
        F.coalesce("__units", F.lit(0).cast("long")).alias("n_removed"),
        F.aggregate(gone, F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]).alias("chars_removed"),
        F.array_join(F.transform(gone, lambda r: F.concat_ws("-", r["start"].cast("string"), r["stop"].cast("string"))), ",").alias("removed"),
        F.col("__kept").alias("kept"),
    )


def op2_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op2_told_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_divergence_quality, with word salad and texts of another language than their label's not kept."""
    return quality.told_apart(documents(spark, sf_dir))


def op3_transcript_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, block (its number), n_lines, n_turns, roles and the canonical text of every block of up to 512 turns of a conversation."""
    raw = transcripts.labelled(documents(spark, sf_dir, "conversations"))
    model = transcripts.fit(raw.filter(~language_id.held_out(F.col("conv_id"))))
    found = transcripts.parse(stored(raw, "transcripts"), model)
    return found.select("conv_id", F.concat_ws(".", "block.high", "block.low").alias("block"), "n_lines", "n_turns", "roles", "rendered")


def op4_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class of near copies."""
    return bag_minhash.classes(documents(spark, sf_dir)).select("doc_id", "class_id")


def op7_marginal_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "__language.lang_pred", "__language.score")


def op8_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = token_ids.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_ids.read(pages)


def op10_bwt_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.dedup_bytes(documents(spark, sf_dir)).drop("removed")


def op11_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.scored(documents(spark, sf_dir))


def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(documents(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_divergence_quality, op3_transcript_hmm, op4_prefix_decontamination, op5_best_fit_packing, op6_bag_minhash, op7_marginal_language, op8_whole_token_counts, op9_simple8b_ids, op10_bwt_byte_dedup, op11_log_bilinear, op12_feast_whitening, op13_importance_resampling, op2_told_apart)}
