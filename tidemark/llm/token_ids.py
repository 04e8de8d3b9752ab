"""Token ids of documents in a compact binary form, written and read by Spark.

write(): documents are tokenised and range-partitioned by id; each task packs its documents into
pages of Simple-8b blocks. A page is one row of a Parquet table: the ids of its documents, their
lengths, the 64-bit words, the offset of each block, and the number of token ids that lie before
the page in its part. read(): the parts' totals (a row per part) are summed in order and joined
to the pages, so every document's place in the whole sequence follows without a global sort.

The tokenizer drops white space and never joins characters across it. So texts are cut at spaces
and line feeds, many at a time, and their pieces numbered; the library encodes each different piece
once per worker while it is cached, and the ids of texts are gathered from its results by array.

Defined results: a null or empty text has only the end id; rows with a null id come first; rows
with equal ids follow each other in the order of a hash of their texts; an empty table gives an
empty table; further columns are not returned.
"""

from __future__ import annotations

import os
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import bounded_batches, claim, stored

CACHE = 400_000  # pieces of text a worker remembers, some 150 bytes each
PAGE_IDS, PAGE_DOCS = 1 << 18, 4096
SLICE = 3 << 20  # bytes of text that are encoded at once


# Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class Encoder:
    def __init__(self, model: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_str(model), cache
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.special = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.merge = self.tok.model.tokenize

    def learn(self, pieces: list[str]) -> None:
        """Enter the pieces that are not known. Half of the memory is for pieces met lately; when it is full
        it becomes the older half, and of that only what is met again stays."""
        if len(self.known) > self.limit // 2:
            self.known, self.older = {"": b""}, self.known
        new = []
        for p in pieces:
            if p not in self.known:
                ids = self.older.get(p)
                if ids is None:
                    new.append(p)
                else:
                    self.known[p] = ids
        rest = []
        for p in new:
            # a word of lower letters passes the library's normaliser and cutter as it is: only merging is left
            if p.isalpha() and max(p) < "\u0250" and p == p.lower() and (p.isascii() or is_normalized("NFC", p)):
                spelled = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LETTERS)
                self.known[p] = array("I", [t.id for t in self.merge(spelled)]).tobytes()
            else:
                rest.append(p)
        for p, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[p] = array("I", e.ids).tobytes()

    def cut(self, texts: pa.StringArray) -> pa.ListArray:
        """The pieces of texts. The library parts (lower) letters from the mark behind them, so texts are cut
        there too, and it lowers capitals; a text must not become one of its special strings by that."""
        lowered = pc.ascii_lower(texts)
        if not any(pc.any(pc.match_substring(lowered, t)).as_py() for t in self.special):
            texts = lowered
        parted = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), r"([\p{Ll}\p{Lo}])([.,;:!?])", r"\1 \2")
        return pc.split_pattern(parted, " ")

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and the number of ids of each. Arrow cuts the texts
        and numbers their different pieces; only these are looked up one by one."""
        cut = self.cut(texts)
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, pieces))
        if None in ids:
            self.learn(pieces)
            ids = [self.known[p] for p in pieces]
        table, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, code = np.cumsum(size) - size, coded.indices.to_numpy()
        n = size[code]
        ends = np.append(0, np.cumsum(n))
        place = np.repeat((begin[code] - ends[:-1]).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        offsets = cut.offsets.to_numpy()
        return table[place], np.diff(ends[offsets - offsets[0]])


def _slices(texts: pa.StringArray, size: int):
    """The array in parts of about `size` bytes, at least one text each, so that work arrays stay small."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def _encoder(model: str) -> Encoder:
    """One for all tasks of a Python worker, so that later tasks find the pieces of earlier ones."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
    return claim("token_ids", str(hash(model)), lambda: Encoder(model))


def _parts(rows: DataFrame, part_bytes: int) -> int:
    """How many parts the table needs: by its size, and enough for all cores where it has a MB for each."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(1, size // part_bytes, min(2 * rows.sparkSession.sparkContext.defaultParallelism, size >> 20))


def write(docs: DataFrame, model_path: str, end_id: int, part_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pages of `docs`, stored in the shared folder, in ascending order of ids by (part, page)."""
    spark = docs.sparkSession
    bounded_batches(spark, mb=SLICE >> 20)
    with open(model_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary file: of fixed size
    end = np.array([end_id], "<u4")

    def pack(batches):
        encoder, part, page, start = _encoder(model.value), TaskContext.get().partitionId(), 0, 0
        ids, lengths, held, size = [], [], [], 0

        def flush():
            words, offsets = simple8b.encode(np.concatenate(held))
            row = {"part": [part], "page": [page], "start": [start], "n_ids": [size], "doc_ids": [ids], "lengths": [lengths], "words": [words.astype("<u8").tobytes()], "offsets": [offsets.tolist()]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("page", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("offsets", pa.list_(pa.int32()))]))

        for b in batches:
            kind, names = b.column(0).type, b.column(0).to_pylist()
            for first, texts in _slices(b.column(1), SLICE):
                flat, n = encoder.encode_all(texts)
                at = 0
                for k, count in enumerate(n.tolist()):
                    ids.append(names[first + k])
                    lengths.append(count + 1)
                    held += (flat[at : at + count], end)
                    at += count
                    size += count + 1
                    if size >= PAGE_IDS or len(ids) >= PAGE_DOCS:
                        yield flush()
                        page, start = page + 1, start + size
                        ids, lengths, held, size = [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # behind the id, the text's hash and the row's place split ids, and copies, with very many rows
    keyed = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(_parts(rows, part_bytes), "doc_id", "text_hash", "place").sortWithinPartitions("doc_id", "text_hash")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"part int, page int, start long, n_ids long, doc_ids array<{kind}>, lengths array<long>, words binary, offsets array<int>"
    return stored(ordered.select("doc_id", "text").mapInArrow(pack, schema), "token-ids")


def read(pages: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the pages, from their words."""
    totals = pages.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row per part
    kind = pages.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches):
        for b in batches:
            for doc_ids, lengths, words, start in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = simple8b.decode(np.frombuffer(words, "<u8")).astype("<u4")
                ends = np.cumsum(lengths)
                data, begins = ids.tobytes(), ends - lengths
                crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, b.column(0).type.value_type), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (
        pages.join(F.broadcast(before), "part")
        .select("doc_ids", "lengths", "words", (F.col("base") + F.col("start")).alias("start"))
        .mapInArrow(unpack, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    )
