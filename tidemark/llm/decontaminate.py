"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

A benchmark item is cut into windows of `window` consecutive words (a shorter item is one window).
A document is hit where all words of a window occur in it in a row. Containment must be complete,
so the necessary prefix of a window, its words put in order of their rarity in the documents, is
its first word: a document without that word cannot hold the window. The rarest word of each
window, with its place in the window, is joined to the documents' words; a match proposes one
place for the whole window. Length and position bound it (it must begin and end inside the
document), and what is left is verified by comparing all words.

Each window thus meets the documents only where its rarest word stands. The rare words and their
windows are sent to all tasks only if they have at most `small` rows, which is counted first;
beyond that the words of the documents are shuffled to them and candidates are joined back to
their documents, and Spark splits the partitions of frequent words.

Defined results: a null or empty text has no words and is clean; an item without words matches
nothing; an item with a null id hits words like any other, and isn't among the items; rows that agree in id and text are judged as one and returned each; repeated items and
items with the same windows each count; an empty benchmark leaves all clean; further columns are
not returned.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, at (the window's number), win (its words)."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return words.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", "at", F.slice("w", F.col("at"), F.least(F.lit(window), F.size("w"))).alias("win")).distinct()


def prefixes(docs_words: DataFrame, windows: DataFrame, small: int) -> DataFrame:
    """For each window its rarest word in the documents (token), with its place (offset)."""
    places = windows.select("item_id", "at", "win", F.posexplode("win").alias("offset", "word"))
    vocabulary = places.select("word").distinct()
    small_enough = vocabulary.count() <= small
    vocabulary = F.broadcast(vocabulary) if small_enough else vocabulary
    words = docs_words.select(F.explode("words").alias("word"))
    # where the words have to be shuffled they are counted first, so that a frequent one brings a row a task
    seen = words.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n")) if small_enough else words.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word")
    # inner: a window with a word that no document has matches nowhere, and need not be joined
    rarest = places.join(seen, "word", "left").groupBy("item_id", "at", "win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", F.col("word").alias("token"))).alias("rarest"))
    return rarest.filter(F.col("rarest.n") > 0).select("item_id", "win", "rarest.token", "rarest.offset")


def _verified(candidates: DataFrame) -> DataFrame:
    """Candidates have words (of the document), pos (of the rare word), win, offset."""
    begin, n = F.col("pos") - F.col("offset"), F.size("win")
    inside = (begin >= 0) & (begin + n <= F.size("words"))
    return candidates.filter(inside).filter(F.slice("words", begin + 1, n) == F.col("win"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, small: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    docs_words = docs.select(*row_key(id_col, text_col), words_of(F.col(text_col)).alias("words"))
    tokens = prefixes(docs_words, item_windows(items, window), small)
    key, hit = ["doc_id", "text_hash"], ["item_id", F.struct((F.col("pos") - F.col("offset")).alias("begin"), F.size("win").alias("n")).alias("span")]
    tokens = stored(tokens, "rare-words")
    if tokens.count() <= small:
        # an empty word at each document's head meets one row of its own, so that every document
        # comes out of the same pass with its number of words
        head = docs.sparkSession.range(1).selectExpr("cast(null as string) item_id", "cast(array() as array<string>) win", "'' token", "-1 offset")
        placed = docs_words.select(*key, "words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "token")).withColumn("pos", F.col("pos") - 1)
        rows = _verified(placed.join(F.broadcast(tokens.union(head)), "token")).select(*key, F.size("words").alias("n_words"), *hit)
    else:
        docs_words = docs_words.dropDuplicates(key)
        placed = docs_words.select(*key, F.posexplode("words").alias("pos", "token"))
        found = placed.join(tokens, "token").select(*key, "pos", "offset", "win", "item_id")
        found = _verified(found.join(docs_words, [found.doc_id.eqNullSafe(docs_words.doc_id), found.text_hash == docs_words.text_hash]).select(found["*"], "words"))
        rows = found.select(*key, F.lit(0).alias("n_words"), *hit).unionByName(docs_words.select(*key, F.size("words").alias("n_words"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("struct<begin:int,n:int>").alias("span")))
    spans = F.collect_set(F.when(F.col("span.n") > 0, F.col("span")))  # a head's span is empty
    per_doc = rows.groupBy(*key).agg(F.max("n_words").cast("long").alias("n_words"), spans.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["begin"] + s["n"] - 1))))
    n_hit = F.size(places).cast("long")
    judged = per_doc.select(
        F.col("doc_id").alias("id"),
        F.col("text_hash").alias("hash"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
    each = docs.select(*row_key(id_col, text_col))  # rows that agree in both get their result each
    return each.join(judged, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).drop("id", "hash")
