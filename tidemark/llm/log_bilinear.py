"""Language-model scores by a log-bilinear model, trained by noise-contrastive estimation.

A text's tokens are its words, A-Z lowered, and one end. Spark counts the words of all training documents. A word's
probability has two factors: its class's, given the classes of the two tokens before, by the log-bilinear model, and
its own within the class. The `own` most frequent words and the end are classes by themselves, all others share
`rare` classes by their last two bytes, where a word has its count with one added and unknown words together have
one. So the model's parameters are bounded, and what it knows of words grows with the corpus.

The model predicts a vector as the sum of one vector for each class in front, and a class's score is its product
with that class's own vector, and a bias. Training goes once over all training documents, in rounds of growing
shares of them: in each, every task starts from the shared parameters, takes minibatches of its own texts against
noise drawn from the classes' frequencies, by stochastic gradients with adaptive steps in numpy; the tasks' results
are averaged by Spark, weighted by tokens. Scoring is normalised: one matrix product gives the normaliser of every
context. Only the words with a count of at least a power of two which leaves no more than `most` of them, of at most
LONG bytes, are sent to the tasks; rarer words of a text are joined to their counts.

Defined results: a null or empty text is one end; a null id is never held out; repeated rows each count and each get
a result; with nothing to learn from each token has probability one for the base, and the model has its starting
parameters; an empty table gives an empty table; further columns are not looked at; very long texts are whole, with
their words in memory once.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, stored

OWN, RARE, WIDTH = 768, 256, 16
MOST, LONG = 1 << 18, 64
BATCH, NOISE, STEP = 2048, 64, np.float32(0.1)
#: Of 16 parts of the training documents, where each round ends.
ROUNDS = (1, 4, 16)
HELD, FOLDS = 2, 7
FLUSH, PIECE = 500_000, 4096
END = b""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def rare_class(word: bytes, rare: int) -> int:
    return zlib.crc32(word[-2:]) % rare


@dataclass
class Words:
    """The words that tasks know, and what is known of the others' classes."""

    words: list[bytes]  # the own classes first, of which the end is number 0
    counts: np.ndarray
    own: int
    rare: int
    totals: np.ndarray  # for each rare class the counts of its words, one more for each, and one for unknown ones
    tokens: int
    distinct: int
    below: int  # words with a count below this, or that are long, are not among `words`

    @property
    def classes(self) -> int:
        return self.own + self.rare

    def sizes(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.own] + 1.0, self.totals])

    def tables(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """Places of words; and of each its class, base score, and score within its class."""
        classes = np.array([self.own + rare_class(w, self.rare) for w in self.words], np.int64)
        classes[: self.own] = np.arange(self.own)
        within = np.log10((self.counts + 1) / self.totals[np.maximum(classes - self.own, 0)])
        within[: self.own] = 0
        base = np.log10((self.counts + 1) / (self.tokens + self.distinct + 1))
        return {w: i for i, w in enumerate(self.words)}, classes, base, within


class Model:
    """Parameters in one flat array, with a name for each part."""

    def __init__(self, classes: int, width: int = WIDTH, flat: np.ndarray | None = None):
        self.classes, self.width = classes, width
        shapes = {"first": (classes + 1, width), "second": (classes + 1, width), "out": (classes, width), "bias": (classes,)}
        shapes |= {f"{k}_step": (s[0], 1) if len(s) == 2 else s for k, s in shapes.items()}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        self.flat = np.full(ends[-1], 1e-3, np.float32) if flat is None else flat
        self.parts = {k: self.flat[e - int(np.prod(s)) : e].reshape(s) for (k, s), e in zip(shapes.items(), ends)}

    @classmethod
    def starting(cls, sizes: np.ndarray, width: int = WIDTH) -> Model:
        model, rng = cls(len(sizes), width), np.random.default_rng(0)
        for k in ("first", "second", "out"):
            model.parts[k][:] = rng.standard_normal(model.parts[k].shape) * 0.1
        model.parts["bias"][:] = np.log(sizes / sizes.sum())
        return model

    def moved(self, part: str, at: np.ndarray, by: np.ndarray) -> None:
        """A step along `by`, added up for equal places, shorter the more a place has moved."""
        order = np.argsort(at.astype(np.int16) if self.classes < 1 << 15 else at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        at, by = at[starts], np.add.reduceat(by[order], starts, axis=0)
        step = self.parts[f"{part}_step"]
        step[at] += (by * by).mean(1, keepdims=True) if by.ndim == 2 else by * by
        self.parts[part][at] += STEP * by / np.sqrt(step[at])

    def learn(self, second: np.ndarray, first: np.ndarray, seen: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
        """One minibatch: tell the classes seen behind (second, first) from noise, which has these log
        probabilities, in a proportion of one to as many as there are."""
        out, bias = self.parts["out"], self.parts["bias"]
        h = self.parts["first"][first] + self.parts["second"][second]
        own, others = out[seen], out[noise]
        odds = bias - log_noise - np.float32(np.log(len(noise)))
        up = 1 / (1 + np.exp(np.minimum((h * own).sum(1) + odds[seen], 60)))
        down = -1 / (1 + np.exp(np.minimum(-(h @ others.T + odds[noise]), 60)))
        back = up[:, None] * own + down @ others
        places = np.concatenate([seen, noise])
        change = np.concatenate([up[:, None] * h, down.T @ h])
        self.moved("first", first, back)
        self.moved("second", second, back)
        self.moved("out", places, change)
        self.moved("bias", places, np.concatenate([up, down.sum(0)]))

    def normalised(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log probability of class k behind (second, first): one[first, k] + two[second, k] - norm[first, second]."""
        out = self.parts["out"].astype(np.float64)
        one = self.parts["first"] @ out.T + self.parts["bias"]
        two = self.parts["second"] @ out.T
        top, high = one.max(1, keepdims=True), two.max(1, keepdims=True)
        norm = np.log(np.exp(one - top) @ np.exp(two - high).T) + top + high.T
        return one.astype(np.float32), two.astype(np.float32), norm.astype(np.float32)


def counted(texts: DataFrame) -> DataFrame:
    """word (bytes; the empty one is the end) and n over all texts, stored."""

    def count(batches):
        claim("log-bilinear")
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column("text"):
                seen.update(words_of(t.as_py()))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield rows()
        yield rows()

    return stored(texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def known(counts: DataFrame, own: int = OWN, rare: int = RARE, most: int = MOST) -> Words:
    """What tasks get of the table of counted(): a bounded number of words, and sums by class."""
    level = F.floor(F.log2("n"))
    short = F.length("word") <= LONG
    levels = counts.groupBy(level.alias("level")).agg(F.count_if(short).alias("words"), F.sum("n").alias("n"), F.count("*").alias("all")).orderBy(F.desc("level")).collect()
    below, room = 1 << 62, most
    for r in levels:
        room -= r["words"]
        if room < 0:
            break
        below = 1 << r["level"]
    found = counts.filter(short & (F.col("n") >= below) & (F.col("word") != F.lit(END))).toArrow()
    pairs = sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    pairs.insert(0, (END, ends["n"] if ends else 0))
    own = min(own + 1, len(pairs))
    totals = np.ones(rare)
    by_class = counts.groupBy((F.crc32(F.substring("word", -2, 2)) % rare).alias("class")).agg((F.sum("n") + F.count("*")).alias("total"))
    for r in by_class.collect():
        totals[r["class"]] += r["total"]
    for word, n in pairs[:own]:
        if n:
            totals[rare_class(word, rare)] -= n + 1
    return Words([w for w, _ in pairs], np.array([n for _, n in pairs], np.int64), own, rare, totals, sum(r["n"] for r in levels), sum(r["all"] for r in levels), below)


def sequences(texts: list[bytes | None], places: dict[bytes, int], classes: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Counter]]:
    """Of texts in a row, each behind two starts: classes, places of words (-1: not known, -2: a start), where texts
    begin, and the words of each that are not known."""
    found, missing, lengths = [], [], []
    for text in texts:
        own = words_of(text)
        at = np.fromiter(map(places.get, own, repeat(-1)), np.int64, len(own))
        absent = np.flatnonzero(at < 0).tolist()
        missing.append(Counter(own[i] for i in absent))
        shown = classes[at] if len(at) else at
        if absent:
            shown[absent] = [words.own + rare_class(own[i], words.rare) for i in absent]
        found.append((at, shown))
        lengths.append(len(own) + 3)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if lengths else np.zeros(0, np.int64)
    at, shown = np.full(sum(lengths), -2, np.int64), np.full(sum(lengths), words.classes, np.int64)
    for b, n, (own_at, own_shown) in zip(begins.tolist(), lengths, found):
        at[b + 2 : b + n - 1], shown[b + 2 : b + n - 1] = own_at, own_shown
        at[b + n - 1] = shown[b + n - 1] = 0
    return shown, at, begins, missing


def trained(texts: DataFrame, words: Words, width: int = WIDTH) -> Model:
    """The model after all rounds over `texts` (text, share: a number below the last of ROUNDS)."""
    spark = texts.sparkSession
    sent, name = spark.sparkContext.broadcast(words), uuid.uuid4().hex
    model, sizes = Model.starting(words.sizes(), width), words.sizes()
    log_noise = np.log(sizes / sizes.sum()).astype(np.float32)
    below = 0
    for number, end in enumerate(ROUNDS):
        start = spark.sparkContext.broadcast(model.flat)

        def run(batches, number=number, start=start):
            places, classes, _, _ = claim("log-bilinear", name, lambda: sent.value.tables())
            own, seen = Model(sent.value.classes, width, start.value.copy()), 0
            rng = np.random.default_rng((number, TaskContext.get().partitionId()))
            cumulative = np.cumsum(np.exp(log_noise, dtype=np.float64))
            for b in batches:
                shown, at, _, _ = sequences([t.as_py() for t in b.column("text")], places, classes, sent.value)
                order = rng.permutation(np.flatnonzero(at > -2))
                for k in range(0, len(order), BATCH):
                    i = order[k : k + BATCH]
                    noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), len(cumulative) - 1)
                    own.learn(shown[i - 2], shown[i - 1], shown[i], noise, log_noise)
                seen += len(order)
            if seen:
                pieces = [own.flat[k : k + PIECE] for k in range(0, len(own.flat), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([seen] * len(pieces), pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "n", "flat"])

        def average(group):
            # a row a task, in a fixed order, so that sums are the same each time
            rows = sorted(zip(group.column("n").to_pylist(), group.column("flat").to_pylist()))
            mean = sum(n * np.frombuffer(f, np.float32).astype(np.float64) for n, f in rows) / sum(n for n, _ in rows)
            return pa.table({"piece": group.column("piece").slice(0, 1), "flat": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

        part = texts.filter((F.col("share") >= below) & (F.col("share") < end)).select("text")
        found = dict(map(tuple, part.mapInArrow(run, "piece int, n long, flat binary").groupBy("piece").applyInArrow(average, "piece int, flat binary").collect()))
        if found:
            model = Model(words.classes, width, np.frombuffer(b"".join(bytes(found[k]) for k in sorted(found)), np.float32).copy())
        below = end
    return model


def score(docs: DataFrame, counts: DataFrame, words: Words, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    sent, name = spark.sparkContext.broadcast(words), uuid.uuid4().hex
    tables = spark.sparkContext.broadcast(model.normalised())

    def run(batches):
        places, classes, base, within = claim("log-bilinear", name, lambda: sent.value.tables())
        one, two, norm = tables.value
        w = sent.value
        seen = np.append(w.counts > 0, [False, False])  # by places, with those of starts and of words not known at the end
        base, within = np.append(base, [0.0, 0.0]), np.append(within, [0.0, 0.0])
        for b in batches:
            shown, at, begins, missing = sequences([t.as_py() for t in b.column("text")], places, classes, w)
            if not len(begins):
                continue
            second, first = np.roll(shown, 2), np.roll(shown, 1)
            real = np.flatnonzero(at > -2)
            of_class = np.zeros(len(at))
            k, s, f = shown[real], second[real], first[real]
            of_class[real] = (one[f, k].astype(np.float64) + two[s, k] - norm[f, s]) / np.log(10)
            sums = [np.add.reduceat(x, begins) for x in (of_class + within[at], base[at], seen[at].astype(np.int64))]
            lengths = np.diff(np.append(begins, len(at))) - 2
            absent = [[{"word": x, "n": n, "total": float(w.totals[rare_class(x, w.rare)])} for x, n in m.items()] for m in missing]
            kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("total", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0]), pa.array(absent, kind)], names=["doc_id", "n_tokens", "n_known", "base", "model", "absent"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base double, model double, absent array<struct<word:binary,n:bigint,total:double>>")
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "text-scores")
    each = parts.select("row", F.explode("absent").alias("x")).select("row", "x.word", "x.n", "x.total")
    others = counts.filter((F.length("word") > LONG) | (F.col("n") < words.below)).withColumnRenamed("n", "c")
    c, all_ = F.coalesce("c", F.lit(0)), float(words.tokens + words.distinct + 1)
    sums = each.join(others, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((c + 1) / all_)).alias("more_base"),
        F.sum(F.col("n") * F.log10((c + 1) / F.col("total"))).alias("more_model"),
    )
    whole = parts.drop("absent").join(sums, "row", "left")
    more = lambda what: F.coalesce(F.col(f"more_{what}"), F.lit(0))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + more("known")).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("base")).alias("base_score"),
        (F.col("model") + more("model")).alias("score"),
    )


def scored(docs: DataFrame, own: int = OWN, rare: int = RARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    bounded_batches(docs.sparkSession, rows=1024, mb=4)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    share = F.coalesce(F.floor(F.crc32(F.col("doc_id").cast("string")) / FOLDS) % ROUNDS[-1], F.lit(0))
    learned = given.filter(~held_out(F.col("doc_id"))).select("text", share.alias("share"))
    counts = counted(learned)
    words = known(counts, own, rare, most)
    model = trained(learned, words)
    return score(given, counts, words, model).withColumn("held_out", held_out(F.col("doc_id")))
