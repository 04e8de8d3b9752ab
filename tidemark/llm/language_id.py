"""Language identification by unigram pieces, with the segmentation summed out.

The pieces are the strings of a fixed public vocabulary. Each language has a probability for each
piece. A word is a mark and its letters; its probability in a language is the sum, over all ways
to cut it into pieces, of the products of their probabilities, which a forward pass over the
word gives. A text's score in a language is the sum of its words' log probabilities, over the
whole text; with equal priors, the posterior of the best language is the score returned.

Probabilities are learned by expectation maximisation from labelled documents: a forward and a
backward pass give the expected number of uses of each piece. Words with their counts are gathered
by Spark from a sample of the labelled documents of about `train_rows` rows (all of them where
there are fewer); one pass over the words is a job, and what returns to the driver is a number
for each language and piece, bounded by the vocabulary.

Defined results: `und` with score 0 for a null text, a text without a letter, or if nothing could
be learned; equal posteriors go to the language first in the alphabet; a null id is never held
out nor learned from; repeated rows each count and each get a result; further columns are passed
through by predict() and not looked at.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded_batches, claim, stored

MARK = "▁"
CACHE = 400_000  # words a worker remembers (some 100 bytes each); when full it starts afresh
TOGETHER = 8192  # words whose sums are taken together, some KB each
SHORT = 30  # letters; products of so many probabilities are within the range of doubles
UNKNOWN = 1e-9  # probability of a character without a piece, the same in every language
_WORD = re.compile(r"[^\W\d_]+")
_SMALL, _SCALE = 1e-120, 1e120


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray  # pieces x languages


def vocabulary(model_path: str) -> list[str]:
    """The pieces that can occur in a mark followed by lower-case letters."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usual = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return [p for p in usual if p == MARK or (p.lstrip(MARK).isalpha() and p == p.lower() and MARK not in p[1:])]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Scorer:
    """Log probabilities of words in every language; remembers words."""

    def __init__(self, model: Model, cache: int = CACHE):
        self.model, self.limit = model, cache
        self.rows = dict(zip(model.pieces, map(tuple, model.probabilities.tolist())))
        self.place_of = {p: i for i, p in enumerate(model.pieces)}
        # every beginning of a piece, to know where no longer piece can match; -1: not itself a piece
        self.begins = {p[:k]: -1 for p in model.pieces for k in range(1, len(p))} | self.place_of
        self.table = np.vstack([model.probabilities, np.full((1, len(model.languages)), UNKNOWN)])
        self.longest = max(map(len, model.pieces), default=1)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.zeros((1024, len(self.model.languages)))
        self.n = 1  # row 0: what has no letter

    def forward(self, word: str) -> list[float]:
        """log P(word | language) for each language."""
        text, rows, n = MARK + word, self.rows, len(self.model.languages)
        sums = [[1.0] * n]
        lost = 0.0
        for j in range(1, len(text) + 1):
            here = [0.0] * n
            for i in range(max(0, j - self.longest), j):
                p = rows.get(text[i:j])
                if p is not None:
                    here = [h + a * b for h, a, b in zip(here, sums[i], p)]
            if text[j - 1 : j] not in rows:
                here = [h + a * UNKNOWN for h, a in zip(here, sums[j - 1])]
            sums.append(here)
            if max(here) < _SMALL:  # keep long words within the range of doubles
                lost += math.log(_SCALE)
                for i in range(max(0, j - self.longest), j + 1):
                    sums[i] = [s * _SCALE for s in sums[i]]
        return [math.log(max(s, 1e-300)) - lost for s in sums[-1]]

    def forward_many(self, words: list[str]) -> np.ndarray:
        """forward() for short words, all at once: their pieces are looked up one by one, then the
        sums go from character to character for all words together."""
        size = max(map(len, words)) + 1
        edges: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        begins, unknown = self.begins, len(self.table) - 1
        for w, word in enumerate(words):
            text = MARK + word
            n = len(text)
            for i in range(n):
                for j in range(i + 1, n + 1):
                    piece = begins.get(text[i:j])
                    if piece is None:
                        if j == i + 1:
                            piece = unknown
                        else:
                            break
                    elif piece < 0:
                        if j > i + 1:
                            continue
                        piece = unknown
                    at, pieces = edges[j * 64 + j - i]
                    at.append(w)
                    pieces.append(piece)
                    if piece == unknown and text[i:j] not in begins:
                        break
        sums = np.zeros((size + 1, len(words), self.table.shape[1]))
        sums[0] = 1.0
        for key in sorted(edges):
            j, length = divmod(key, 64)
            at, pieces = edges[key]
            sums[j][at] += sums[j - length][at] * self.table[pieces]
        ends = np.fromiter(map(len, words), np.int64) + 1
        return np.log(np.maximum(sums[ends, np.arange(len(words))], 1e-300))

    def learn(self, words: list[str]) -> None:
        new = list({w for w in words if w not in self.place})
        if self.n + len(new) > self.limit:
            self.forget()
            new = list(set(words))
        if self.n + len(new) > len(self.known):
            grown = np.zeros((max(2 * len(self.known), self.n + len(new)), self.known.shape[1]))
            grown[: self.n] = self.known[: self.n]
            self.known = grown
        short = []
        for w in new:
            if not any(map(str.isalpha, w)):
                self.place[w] = 0
            elif len(w) <= SHORT:
                short.append(w)
            else:
                self.place[w], self.known[self.n] = self.n, self.forward(w)
                self.n += 1
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            self.known[self.n : self.n + len(some)] = self.forward_many(some)
            self.place.update(zip(some, range(self.n, self.n + len(some))))
            self.n += len(some)

    def score_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Scores of texts, by groups of a million characters whose new words are learned together."""
        out, group, size = [], [], 0
        for k, text in enumerate(texts):
            group.append(_WORD.findall((text or "").lower()))
            size += len(text or "")
            if size >= 1_000_000 or k + 1 == len(texts):
                self.learn([w for w in set().union(*group) if w not in self.place])
                out += map(self.score, group)
                group, size = [], 0
        return out

    def score(self, words: list[str]) -> tuple[str, float]:
        try:
            at = [self.place[w] for w in words]
        except KeyError:
            self.learn(words)
            at = [self.place[w] for w in words]
        if not any(at) or not self.model.languages:
            return "und", 0.0
        total = self.known.take(at, 0).sum(0)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def expected(word: str, probabilities: dict[str, float], longest: int) -> list[tuple[str, float]]:
    """How often each piece is used in the word, in expectation over its segmentations."""
    text = MARK + word
    n = len(text)
    ahead, behind, edges, = [1.0] + [0.0] * n, [0.0] * n + [1.0], []
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            p = probabilities.get(text[i:j])
            if p is None and i == j - 1:
                p = UNKNOWN
            if p is not None:
                edges.append((i, j, p))
                ahead[j] += ahead[i] * p
    if ahead[n] < 1e-250:
        return []  # beyond the range of doubles; such words are too rare to matter for learning
    for i, j, p in reversed(edges):
        behind[i] += p * behind[j]
    return [(text[i:j], ahead[i] * p * behind[j] / ahead[n]) for i, j, p in edges]


def word_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int) -> DataFrame:
    """language, word, n over the sample of the documents that may be learned from."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("language"))
    labelled = labelled.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("language").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, train_rows / max(1, labelled.select("doc_id").count()))
    sample = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches):
        for b in batches:
            seen: Counter = Counter()
            for text, language in zip(*(c.to_pylist() for c in b.columns)):
                for word, n in Counter(_WORD.findall(text.lower())).items():
                    seen[language, word] += n
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(seen.values(), pa.int64())], names=["language", "word", "n"])

    counted = sample.select("text", "language").mapInArrow(count, "language string, word string, n long")
    return stored(counted.groupBy("language", "word").agg(F.sum("n").alias("n")), "language-words")


def fit(docs: DataFrame, model_path: str, train_rows: int = 10_000, rounds: int = 2, smoothing: float = 0.05, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    spark = docs.sparkSession
    bounded_batches(spark, mb=4)
    pieces = vocabulary(model_path)
    place, longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
    words = word_counts(docs, id_col, text_col, lang_col, train_rows)
    languages = sorted(r[0] for r in words.select("language").distinct().collect())
    probabilities = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, languages, probabilities))

        def uses(batches):
            names, langs, table = shared.value
            own = {lang: dict(zip(names, table[:, k].tolist())) for k, lang in enumerate(langs)}
            total: Counter = Counter()
            for b in batches:
                for language, word, n in zip(*(c.to_pylist() for c in b.columns)):
                    for piece, x in expected(word, own[language], longest):
                        if piece in own[language]:
                            total[language, piece] += n * x
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([place[k[1]] for k in keys], pa.int32()), pa.array(total.values(), pa.float64())], names=["language", "piece", "x"])

        got = words.mapInArrow(uses, "language string, piece int, x double").groupBy("language", "piece").agg(F.sum("x").alias("x"))
        counts = np.full(probabilities.shape, smoothing)
        for language, piece, x in got.collect():  # at most pieces x languages
            counts[piece, languages.index(language)] += x
        probabilities = counts / counts.sum(0)
    return Model(languages, pieces, probabilities)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with __language, struct<lang_pred string, score double>; one map over the rows."""
    spark = docs.sparkSession
    bounded_batches(spark, mb=4)
    shared, name, names = spark.sparkContext.broadcast(model), uuid.uuid4().hex, docs.columns
    at = names.index(text_col)

    def run(batches):
        # one for all tasks of a Python worker, so that later tasks find the words of earlier ones
        scorer = claim("language_id", name, lambda: Scorer(shared.value))
        for b in batches:
            found = scorer.score_all(b.column(at).to_pylist())
            result = pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns, result], names=[*names, "__language"])

    schema = StructType([*docs.schema.fields, StructField("__language", StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))])
    return docs.mapInArrow(run, schema)
