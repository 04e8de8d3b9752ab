"""Substring dedup by line hashing.

Texts are cut into lines and these, behind each end of a sentence, into units, so that a passage which
was pasted into the middle of a line is found too. A unit is normalised (lower case, white space runs
to one space, ends stripped). Digested are whole lines, and from every unit on the fewest units in a
row, across lines too, that have `min_chars` characters; nothing of fewer characters is digested,
for short phrases repeat by nature. The guard counts characters and not words, so that it holds
for scripts without spaces as well.

Digests of 128 bits are grouped over the whole corpus; of each group the occurrence of the earliest
rank (document id, then hash of the text, then place) stays and all others are removed, with their
offsets in the original text kept. Grouping is done in two steps, so that what occurs once, which
is nearly everything, is shuffled as little as possible: 64 bits of each digest are counted; what occurs
more than once by that is then grouped by the whole digest. Both send a row per digest and task,
however frequent a line is; digests with more than a thousandth of the repeats number at most a
thousand, and are broadcast where the others are joined.

Defined results: a null text stays null; blank units stay unless they are inside of a removed
passage; passages repeated inside one document are removed too; a passage's last units stay if
they are too few to be digested by themselves and end no repeated line; rows that agree in id and
text get the same result, and the first of them keeps its passages like the others; an empty table gives an
empty table; columns of the input other than the text are passed through, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import bounded_batches, claim, row_key, stored

MIN_CHARS = 150
_END = re.compile(r"[.!?] |\n")
_U = np.uint64
_BASE = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_TURN = tuple(_U(pow(int(b), -1, 1 << 64)) for b in _BASE)


def units(text: str) -> list[tuple[int, int]]:
    """Start and stop of the units of a text, one after another."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def normalise(unit: str) -> str:
    return " ".join(unit.lower().split())


def passages(texts: list[str], min_chars: int) -> tuple[np.ndarray, ...]:
    """Of all lines and stretches that are digested: text, start, stop, and two halves of the digest."""
    start, stop, size, line, owner, digests = [], [], [], [], [], []
    for k, text in enumerate(texts):
        at = 0
        for a, b in units(text):
            plain = normalise(text[a:b])
            if plain:
                start.append(a)
                stop.append(b)
                size.append(len(plain))
                line.append(at)
                owner.append(k)
                digests.append(xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass")))
            at += text.endswith("\n", a, b)
    if not owner:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),) * 2
    start, stop, size, line, owner = (np.array(x, np.int64) for x in (start, stop, size, line, owner))
    upto, m = np.cumsum(size), len(owner)
    # fewest units in a row that are long enough
    last = np.searchsorted(upto, upto - size + min_chars)
    inside = np.flatnonzero((last < m) & (owner[np.minimum(last, m - 1)] == owner))
    # whole lines
    head = np.ones(m, bool)
    head[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(head)
    tail = np.append(first[1:], m) - 1
    long = (upto[tail] - upto[first] + size[first] >= min_chars) & (last[first] != tail)
    i, j = np.concatenate((inside, first[long])), np.concatenate((last[inside], tail[long]))
    halves = []
    for unit, base, turn in zip(np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).T, _BASE, _TURN):
        # the polynomial of the units' digests, by differences of prefix sums
        sums = np.append(_U(0), np.cumsum(unit * np.cumprod(np.full(m, base))))
        halves.append(((sums[j + 1] - sums[i]) * np.cumprod(np.full(m, turn))[i]).view(np.int64))
    return owner[i], start[i], stop[j], *halves


def digested(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every passage that counts: doc_id, text_hash, start and stop in characters, h1, h2."""
    bounded_batches(docs.sparkSession)

    def cut(batches):
        claim("line_dedup")
        for b in batches:
            owner, *numbers = passages(b.column("text").to_pylist(), min_chars)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("text_hash").take(at), *map(pa.array, numbers)], names=["doc_id", "text_hash", "start", "stop", "h1", "h2"])

    rows = docs.filter(F.col(text_col).isNotNull()).select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, start long, stop long, h1 long, h2 long")


def _found(rows: DataFrame, groups: DataFrame, value: str, hot_share: float) -> DataFrame:
    """`rows` whose h1 is in `groups` (h1, n, and the column `value`). Keys with more than a share of all
    repeats, at most 1 / hot_share of them, are broadcast, and their rows stay where they are; the
    rows of other keys are shuffled to them."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > total * hot_share
    hot = F.broadcast(groups.filter(is_hot).select("h1", F.col(value).alias("hot_value")))
    rare = groups.filter(~is_hot).select(F.col("h1").alias("key"), F.col(value).alias("rare_value"))
    marked = rows.join(hot, "h1", "left")
    own = F.xxhash64("doc_id", "text_hash", "start", "stop")  # should it be the key of others: hot_value goes first
    keyed = marked.withColumn("key", F.when(F.col("hot_value").isNull(), F.col("h1")).otherwise(own))
    found = keyed.join(rare, "key", "left").withColumn("value", F.coalesce("hot_value", "rare_value"))
    return found.filter(F.col("value").isNotNull()).select(*rows.columns, "value")


def repeated(rows: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """The passages to remove: rows of `rows` whose digest has an earlier one."""
    often = stored(rows.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    again = stored(_found(rows, often, "n", hot_share).drop("value"), "repeats")
    place = F.struct("doc_id", "text_hash", "start", "stop")
    firsts = again.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    by_half = firsts.groupBy("h1").agg(F.sum("n").alias("n"), F.collect_list(F.struct("h2", "first")).alias("firsts"))  # nearly always one
    found = _found(again, stored(by_half, "first-occurrences"), "firsts", hot_share)
    first = F.filter("value", lambda x: x["h2"] == F.col("h2"))[0]["first"]
    return found.filter(first != place).select("doc_id", "text_hash", "start", "stop")


_SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])
_CUT = StructType([StructField("removed", ArrayType(_SPAN)), StructField("units", LongType()), StructField("kept", StringType())])


@F.pandas_udf(_CUT)
def _without(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
    """The removed stretches of each text, joined where they touch, the number of their units, and the rest."""
    out: list[tuple] = []
    for t, a, b in zip(text, starts, stops):
        if t is None or a is None:
            out.append((None, None, None))
            continue
        order = np.argsort(a, kind="stable")
        a, b = np.asarray(a)[order], np.maximum.accumulate(np.asarray(b)[order])
        new = np.append(True, a[1:] > b[:-1])
        begin, end = a[new].tolist(), b[np.append(new[1:], True)].tolist()
        heads = np.array([u for u, v in units(t) if t[u:v].strip()])
        n = int((np.searchsorted(heads, end) - np.searchsorted(heads, begin)).sum())
        kept = "".join(t[u:v] for u, v in zip([0, *end], [*begin, len(t)]))
        out.append(([{"start": u, "stop": v} for u, v in zip(begin, end)], n, kept))
    return pd.DataFrame(out, columns=["removed", "units", "kept"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with columns __removed: the removed stretches, array<struct<start,stop>> in order (null:
    none), __units: how many units they have, and __kept: the text without them."""
    gone = repeated(digested(docs, min_chars, id_col, text_col)).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__spans")
    _, text_hash = row_key(id_col, text_col)
    keyed = docs.withColumn("__key", text_hash)
    joined = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left").drop("__key", "__id", "__hash")
    starts, stops = F.transform("__spans", lambda s: s["start"]), F.transform("__spans", lambda s: s["stop"])
    cut = joined.withColumn("__cut", _without(F.when(F.col("__spans").isNotNull(), F.col(text_col)), starts, stops))
    return cut.select(*docs.columns, F.col("__cut.removed").alias("__removed"), F.col("__cut.units").alias("__units"), F.coalesce("__cut.kept", text_col).alias("__kept"))
