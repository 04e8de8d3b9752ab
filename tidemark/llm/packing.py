"""Best-fit packing of documents into training sequences of several permitted lengths.

A document of n units (by default its words and an end mark) longer than the greatest capacity is
cut into pieces of that capacity and a rest; nothing is dropped. Pieces are dealt at random by a
hash over shards of about `shard_pieces` pieces, and every shard is packed by itself in one task:
pieces in descending length; each goes to the open bin with the least room that holds it; if
there is none, a bin is opened. Its capacity is chosen by what is still to come: for each capacity the
pieces ahead that would fill it, the largest that fits each time, are counted, and the capacity
whose bin, downsized to these, costs least for each unit, overhead included, is opened. At last each bin is
downsized to the least capacity that holds its contents. A shard is also packed with each
capacity (or the least that holds the piece) for all bins, and the packing that costs least in
all is kept, so none of the permitted lengths alone would do better in a shard. Shards bound the memory of a task and
what is lost with an executor; a shard's last bins are all that sharding costs.

Defined results: a null or empty document is a piece of one unit, its end mark; ties in length go
by document id, then piece; rows that agree in id and length are packed like any others; an empty
table gives an empty table; further columns are not returned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16  # what a sequence costs besides its units
SHARD_PIECES = 20_000


def word_units(text: Column) -> Column:
    """Words parted by ASCII white space, and one for the end mark."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1


class Outlook:
    """What a bin opened for the piece at some place would be filled with, of pieces in descending order."""

    def __init__(self, lengths: list[int]):
        self.falling = [-n for n in lengths]
        self.sums = [0, *accumulate(lengths)]

    def filled(self, at: int, capacity: int) -> int:
        """Units in a bin of that capacity with piece `at` and the pieces ahead that fit, one by one."""
        used, at = -self.falling[at], at + 1
        while True:
            at = bisect_left(self.falling, used - capacity, at)  # the first that isn't longer than the room
            if at == len(self.falling):
                return used
            stop = bisect_right(self.sums, self.sums[at] + capacity - used, at) - 1  # a run that fits as a whole
            used, at = used + self.sums[stop] - self.sums[at], stop


def cost(sizes: list[int], overhead: int) -> int:
    return sum(sizes) + overhead * len(sizes)


def fill(lengths: list[int], capacities: tuple[int, ...], choose: Callable[[int, int], int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Best fit of lengths in descending order; choose(place, length) is the capacity of a bin to open.
    Each piece's bin and offset, and each bin's capacity, downsized."""
    placed, used, room = [], [], []
    for k, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, bin_ = room.pop(at)
        else:
            free, bin_ = choose(k, n), len(used)
            used.append(0)
        placed.append((bin_, used[bin_]))
        used[bin_] += n
        if free > n:
            insort(room, (free - n, bin_))
    return placed, [min(c for c in capacities if c >= u) for u in used]


def pack(lengths: list[int], capacities: tuple[int, ...], overhead: int) -> tuple[list[tuple[int, int]], list[int]]:
    """The least costly of the packings of lengths in descending order; the first of equal ones."""
    ahead = Outlook(lengths)

    def by_outlook(k: int, n: int) -> int:
        def each(c: int) -> float:
            used = ahead.filled(k, c)
            return (min(x for x in capacities if x >= used) + overhead) / used

        return min((c for c in capacities if c >= n), key=lambda c: (each(c), c))

    plans = [by_outlook, *(lambda _, n, size=size: min(c for c in capacities if c >= max(n, size)) for size in capacities)]
    return min((fill(lengths, capacities, plan) for plan in plans), key=lambda p: cost(p[1], overhead))


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES, units: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start (in the document), n_units, shard, bin, capacity, offset (in the bin)."""
    spark, capacities = docs.sparkSession, tuple(sorted(capacities))
    most = capacities[-1]
    # the place of a row in the stored table is the same in a retry; without it, copies of a row would share a shard
    sized = docs.select(F.col(id_col).alias("doc_id"), (word_units(F.col("text")) if units is None else units).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    pieces = sized.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("n_units"))
    # pieces tell the number of shards; a row's random number would not survive a retry, a hash of its content does
    total = sized.agg(F.coalesce(F.sum(F.floor((F.col("n") - 1) / most) + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_pieces))
    # the start of long documents tells their pieces apart, text and place split rows of one id or none
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_units", "row"), F.lit(shards)).cast("int")).drop("row")
    kind = sized.schema["doc_id"].dataType.simpleString()

    def fill_shard(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_units", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        placed, sizes = pack(shard["n_units"].tolist(), capacities, overhead)
        return shard.assign(bin=[b for b, _ in placed], capacity=[sizes[b] for b, _ in placed], offset=[o for _, o in placed])

    return dealt.groupBy("shard").applyInPandas(fill_shard, f"doc_id {kind}, piece long, start long, n_units long, shard int, bin long, capacity long, offset long")
