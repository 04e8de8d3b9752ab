"""Exact substring dedup: bytes covered by a string of `length` bytes that occurs elsewhere too.

1. Anchors. Of the 64-byte strings in a window of `length` bytes the one with the least hash
   (leftmost of equals) is its anchor. Equal windows have equal anchors at equal places, so all
   occurrences of a repeated window meet under one anchor. Successive windows share anchors, about
   one for every 56 bytes; the bytes of all windows of an anchor's place are its context.
2. Anchors that occur once are dropped. Equal contexts of an anchor are folded to one with its
   number of occurrences, by partial aggregates.
3. Contexts of one anchor that differ are compared by bounded-depth suffix order and interval
   expansion on its Burrows-Wheeler form (bwt.repeats), in shards of about `shard_bytes` with
   whole anchors. A window is repeated if its string is found twice in its shard, or if its
   context was folded.
4. An anchor with more than `most` different contexts isn't held in one task: its contexts are cut
   into blocks of neighbouring windows, blocks are grouped by the bytes that their windows share,
   equal blocks are folded, and single windows are only written out, to be counted by digests, from blocks
   that share that core with another and differ outside it.
5. Repeated windows go back to all occurrences of their contexts and are merged per document.

Texts are read three times and shuffled only where a document has something to compare or remove
(Spark filters the documents by a Bloom filter on their ids before that shuffle).

Defined results: a null or empty text has no bytes; texts shorter than `length` keep all;
matches never cross documents but count within one; rows that agree in id and text are separate
documents that repeat each other, and each gets its row; an empty table gives an empty table;
further columns are not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeats
from .common import bounded_batches, claim, row_key, stored

GRAM = 64  # bytes of an anchor
LENGTH, MOST, SHARD_BYTES, BLOCK = 200, 2048, 500_000, 17  # half a MB: the arrays of a shard stay near the processor

_U = np.uint64
_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=_U)
_STEP = 1 << 20  # positions that are looked at together: what 20 bits hold


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, its place, first window, number of windows."""
    v, factor, size = _BYTE[np.frombuffer(data, np.uint8)], 0x9E3779B97F4A7C15, 1
    while size < GRAM:
        v = v[:-size] * _U(factor) + v[size:]
        factor, size = factor * factor & (1 << 64) - 1, size * 2
    v = (v ^ (v >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    v ^= v >> _U(32)
    width = length - GRAM + 1
    out: list[tuple] = []
    for begin in range(0, len(v) - width + 1, _STEP - width + 1):
        part = v[begin : begin + _STEP]
        # the hash's upper bits and the place in one number: the least is the leftmost least
        least, size = (part & _U((1 << 64) - _STEP)) | np.arange(len(part), dtype=_U), 1
        n = len(part) - width + 1
        while size * 2 <= width:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        place = (np.minimum(least[:n], least[width - size :][:n]) & _U(_STEP - 1)).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(place)) + 1)
        at = place[first]
        out.append((part[at].view(np.int64), at + begin, first + begin, np.diff(np.append(first, n))))
    return tuple(map(np.concatenate, zip(*out)))


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"first": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]


RUNS = "array<struct<first: int, n: int>>"


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def find(batches):
        claim("byte_dedup")
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            rows, counts = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                h, at, first, n = anchors(data, length)
                rows.append(i)
                counts.append(len(h))
                ends = (first + n + length - 1).tolist()
                digests = np.fromiter((xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(first.tolist(), ends)), _U, len(h))
                for c, x in zip(cols, (h, digests.view(np.int64), first, n, at - first)):
                    c.append(x)
            which = pa.array(np.repeat(rows, counts).astype(np.int64))
            joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols[:5]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(which), b.column("text_hash").take(which), *(pa.array(x, k) for x, k in zip(joined, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())))], names=["doc_id", "text_hash", "h", "c", "first", "n", "back"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, text_hash long, h long, c long, first long, n int, back int")


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (one for each doc_id and text_hash) with their documents' texts; an inner join, so
    that Spark filters the documents before it shuffles them."""
    return docs.join(rows, docs.doc_id.eqNullSafe(rows.doc_id) & (docs.text_hash == rows.text_hash)).select(docs["doc_id"], docs["text_hash"], docs["text"], *[c for c in rows.columns if c not in ("doc_id", "text_hash")])


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of contexts: wanted has h, c, n, back, seen, hot and rep, an occurrence of each."""
    per_doc = wanted.select("rep.doc_id", "rep.text_hash", F.struct("h", "c", "n", "back", "seen", "hot", F.col("rep.first").alias("first")).alias("x")).groupBy("doc_id", "text_hash").agg(F.collect_list("x").alias("xs"))

    def cut(batches):
        claim("byte_dedup")
        for b in batches:
            out = []
            for text, xs in zip(b.column("text").to_pylist(), b.column("xs").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                out += [{**x, "bytes": data[x["first"] : x["first"] + x["n"] + length - 1]} for x in xs]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("back", pa.int32()), ("seen", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())])
    return stored(_with_text(docs, per_doc).select("text", "xs").mapInArrow(cut, "h long, c long, n int, back int, seen long, hot boolean, bytes binary"), "context-bytes")


def _compared(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """h, c, runs: the repeated windows of contexts, by shards of whole anchors."""
    total = contexts.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["h", "c"])
        texts = pdf["bytes"].tolist()
        flags, out, start = repeats(texts, length), [], 0
        for t in texts:
            out.append(_runs(flags[start : start + len(t) - length + 1]))
            start += len(t) + 1
        return pd.DataFrame({"h": pdf["h"], "c": pdf["c"], "runs": out})

    dealt = contexts.select("h", "c", "bytes", F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(search, f"h long, c long, runs {RUNS}").filter(F.size("runs") > 0)


def _hot(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many contexts for a task, by blocks of windows."""

    def blocks(batches):
        claim("byte_dedup")
        for b in batches:
            out = []
            for x in b.to_pylist():
                # blocks are aligned at the anchor, so that equal windows are in equal blocks
                low = -x["back"]
                for block in range(low // BLOCK, (low + x["n"] - 1) // BLOCK + 1):
                    s, e = max(low, block * BLOCK), min(low + x["n"], (block + 1) * BLOCK)
                    whole = x["bytes"][s - low : e - low + length - 1]
                    # what all windows of a block share, and every part of a block holds
                    core = x["bytes"][(block + 1) * BLOCK - 1 - low : block * BLOCK + length - low]
                    out.append({"h": x["h"], "c": x["c"], "at": s - low, "n": e - s, "core": xxhash.xxh3_128_digest(core, seed=block & 0xFFFFFFFF), "whole": xxhash.xxh3_128_digest(whole, seed=s & 0xFFFFFFFF), "bytes": whole})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("h", pa.int64()), ("c", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("core", pa.binary()), ("whole", pa.binary()), ("bytes", pa.binary())]))

    def windows(batches):
        claim("byte_dedup")
        for b in batches:
            out = []
            for h, x, times in zip(*(b.column(k).to_pylist() for k in ("h", "x", "times"))):
                out += [{"h": h, "c": x["c"], "at": x["at"] + i, "times": times, "digest": xxhash.xxh3_128_digest(x["bytes"][i : i + length])} for i in range(x["n"])]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("h", pa.int64()), ("c", pa.int64()), ("at", pa.int32()), ("times", pa.int64()), ("digest", pa.binary())]))

    cut = stored(contexts.mapInArrow(blocks, "h long, c long, at int, n int, core binary, whole binary, bytes binary"), "blocks")
    wholes = stored(cut.groupBy("h", "core", "whole").agg(F.count("*").alias("times"), F.min(F.struct("c", "at", "n", "bytes")).alias("x")), "block-kinds")
    equal = wholes.filter("times > 1").select("h", "core", "whole")
    same = cut.join(equal, ["h", "core", "whole"]).select("h", "c", F.array(F.struct(F.col("at").alias("first"), "n")).alias("runs"))
    cores = wholes.groupBy("h", "core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("h", "core")
    each = stored(wholes.join(cores, ["h", "core"]).select("h", "x", "times").mapInArrow(windows, "h long, c long, at int, times long, digest binary"), "block-windows")
    twice = each.groupBy("h", "digest").agg(F.sum("times").alias("all")).filter("all > 1").select("h", "digest")
    single = each.filter("times = 1").join(twice, ["h", "digest"]).select("h", "c", F.array(F.struct(F.col("at").alias("first"), F.lit(1).alias("n"))).alias("runs"))
    return same.unionByName(single)


def repeated_windows(docs: DataFrame, length: int, most: int, shard_bytes: int) -> DataFrame:
    """doc_id, text_hash, spans: array of (start, stop) in bytes, not merged, of repeated strings."""
    rows = stored(_anchor_rows(docs, length), "anchors")
    again = stored(rows.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1"), "anchors-again")
    rows = stored(rows.join(again.filter("times > 1").select("h"), "h"), "anchors-repeated")
    folded = stored(rows.groupBy("h", "c").agg(F.count("*").alias("seen"), F.min(F.struct("doc_id", "text_hash", "first")).alias("rep"), F.max("n").alias("n"), F.max("back").alias("back")), "contexts")
    kinds = folded.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = folded.join(kinds, "h").withColumn("hot", F.col("kinds") > most)
    contexts = _contexts(docs, wanted, length)
    found = _compared(contexts.filter("not hot"), length, shard_bytes)
    hot = contexts.filter("hot")
    if not hot.isEmpty():
        found = found.unionByName(_hot(hot, length))
    whole = folded.filter("seen > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("first"), "n")).alias("runs"))
    once = folded.filter("seen = 1").select("h", "c")
    decided = stored(whole.unionByName(found.join(once, ["h", "c"], "left_semi")), "windows")
    spans = rows.join(decided, ["h", "c"]).select("doc_id", "text_hash", F.explode(F.transform("runs", lambda r: F.struct((F.col("first") + r["first"]).alias("start"), (F.col("first") + r["first"] + r["n"] + (length - 1)).alias("stop")))).alias("span"))
    return stored(spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("span")).alias("spans")), "spans")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, most: int = MOST, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (merged spans, array<struct<start,stop>>)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # let Spark filter documents by the ids that are wanted, before it shuffles their texts
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", 0)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")
    texts = docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_windows(texts, length, most, shard_bytes)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def remove(batches):
        claim("byte_dedup")
        for b in batches:
            out = []
            for doc, text, spans_ in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "spans"))):
                data, merged = text.encode("utf-8", "surrogatepass"), []
                for s in spans_:
                    if merged and s["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                    else:
                        merged.append(s)
                kept, at = hashlib.sha256(), 0
                for s in merged:
                    kept.update(data[at : s["start"]])
                    at = s["stop"]
                kept.update(data[at:])
                out.append((doc, len(data), sum(s["stop"] - s["start"] for s in merged), len(merged), kept.hexdigest(), merged))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (b.column("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    removed = "array<struct<start: bigint, stop: bigint>>"
    changed = _with_text(texts, spans.filter(F.size("spans") > 0)).mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed {removed}")
    none = F.lit(0).cast("long")
    whole = texts.select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    same = whole.join(spans, whole.doc_id.eqNullSafe(spans.doc_id) & (whole.text_hash == spans.text_hash), "left_anti")
    return changed.unionByName(same.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept_sha256", F.array().cast(removed).alias("removed")))
