"""Token counts with a whole-token shortcut.

A subword tokenizer spends its time on merging. Here the vocabulary is examined once, offline:
every vocabulary string that the library itself encodes as exactly one token is entered in a
table. Texts are cut into pre-tokens at places that no vocabulary piece spans (before a run of
word marks, around line feeds); a pre-token in the table counts one without any merging, and the
library merges only the rest, each different one once per worker while it stays in the cache.
The cuts are checked against the vocabulary too: see `proof`.

Defined results: a null or empty text has no tokens; texts are counted whole, however long;
repeated rows are each counted; an empty table gives an empty table; further columns of the
input are not returned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim

MARK = "▁"  # stands for a space inside the vocabulary
CACHE = 400_000  # pre-tokens a worker remembers; when full it starts afresh, results don't change

_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def proof(model: bytes) -> list[str]:
    """The vocabulary strings that encode alone as one token, after checking that pre-token
    boundaries are safe: no piece holds a mark behind another character, or a line feed."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
        raise ValueError("a vocabulary piece spans a pre-token boundary")
    alone = []
    for p in pieces:
        # the library puts a mark in front: behind a line feed the piece stands by itself
        ids = sp.encode("\n" + p)[2:]
        if len(ids) == 1 and sp.id_to_piece(ids[0]) == p:
            alone.append(p)
    return alone


class Counter:
    """Counts tokens of texts; the words that are one token are given."""

    def __init__(self, model: bytes, alone: list[str], cache: int = CACHE):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.feed = self.sp.piece_to_id("<0x0A>")
        self.alone, self.limit = alone, cache
        self.known = dict.fromkeys(alone, 1)

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and its number of line feeds, each of which is a token."""
        if not text:
            return [], 0
        lines = (MARK + text.replace(" ", MARK)).split("\n")
        out: list[str] = []
        for line in lines:
            if MARK + MARK in line:
                out += _RUNS.findall(line)
            else:
                head, *rest = line.split(MARK)
                if head:
                    out.append(head)
                out += [MARK + w for w in rest]
        return out, len(lines) - 1

    def learn(self, text_words: list[str]) -> None:
        words = list({w for w in text_words if w not in self.known})
        if len(self.known) + len(words) > self.limit + len(self.alone):
            self.known = dict.fromkeys(self.alone, 1)
            words = list({w for w in text_words if w not in self.known})
        # many words in one call, parted by line feeds, at which no token spans
        ids = np.array(self.sp.encode("\n".join(["", *words, ""])))
        feeds = np.flatnonzero(ids == self.feed)
        self.known.update(zip(words, (np.diff(feeds) - 1).tolist()))

    def count(self, text: str) -> int:
        words, feeds = self.pretokens(text)
        try:
            return sum(map(self.known.__getitem__, words)) + feeds
        except KeyError:
            self.learn(words)
            return sum(map(self.known.__getitem__, words)) + feeds


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs`; one map over the rows, no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(model_path, "rb") as f:
        model = f.read()
    # half a MB, fixed by the vocabulary file
    shared = spark.sparkContext.broadcast((model, proof(model)))

    def run(batches):
        claim("token_counts")
        counter = Counter(*shared.value)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            n = pa.array([counter.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=["doc_id", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # the length goes through the map as part of the id column, so that rows stay in step
    packed = rows.select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("doc"), "text")
    kind = packed.schema["doc"].dataType.simpleString()
    return (
        packed.mapInArrow(lambda it: (pa.RecordBatch.from_arrays(b.columns, names=["doc", "n_tokens"]) for b in run(it)), f"doc {kind}, n_tokens long")
        .select("doc.doc_id", "doc.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
