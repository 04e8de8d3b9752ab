"""Pairs inside of keys, where some keys may have very many rows.

Keys are counted first. The rows of a key are dealt to blocks of about `most` rows, and each pair is formed in one cell
of two blocks, so that no task gets more than the rows of two blocks for a cell, whatever one key holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block: a cell is two blocks, and at most their product of pairs.
MOST = 2_000
Fits = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def large(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled, and not sent to all tasks through the driver while it is still small."""
    return side.hint("merge")


def _blocks(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Into how many blocks the keys go that need more than one."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    return sizes.select(key, F.ceil(F.col("__n") / most).cast("int").alias("__blocks"))


def _dealt(rows: DataFrame, blocks: DataFrame, key: str, by: str) -> DataFrame:
    all_ = rows.join(blocks, key, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    return all_.withColumn("__block", F.pmod(F.xxhash64(by), F.col("__blocks")).cast("int"))


def _of(side: str) -> Callable[[str], Column]:
    return lambda name: F.col(f"{side}.{name}")


def within(rows: DataFrame, key: str, by: str, fits: Fits | None = None, most: int = MOST) -> DataFrame:
    """a, b (a < b): pairs of different `by` in one key, from rows that hold each (key, by) once. fits(of left, of right)
    drops pairs where they are formed. A pair that has several keys comes once for each."""
    dealt = _dealt(rows, _blocks(rows, key, most), key, by)
    last = F.col("__blocks") - 1
    left = dealt.select("*", F.col("__block").alias("__i"), F.explode(F.sequence("__block", last)).alias("__j")).alias("left")
    right = dealt.select("*", F.explode(F.sequence(F.lit(0), "__block")).alias("__i"), F.col("__block").alias("__j")).alias("right")
    x, y = _of("left"), _of("right")
    same_cell = (x(key) == y(key)) & (x("__i") == y("__i")) & (x("__j") == y("__j"))
    once = (x("__i") < x("__j")) | (x(by) < y(by))
    found = left.join(right, same_cell & once if fits is None else same_cell & once & fits(x, y))
    return found.select(F.least(x(by), y(by)).alias("a"), F.greatest(x(by), y(by)).alias("b"))


def across(few: DataFrame, many: DataFrame, key: str, by: str, fits: Fits | None = None, most: int = MOST) -> DataFrame:
    """a, b: `by` of a row of `few` and of a row of `many` in one key. The rows of `many` are dealt to blocks, and those of
    `few` go to each."""
    blocks = _blocks(many, key, most)
    right = _dealt(many, blocks, key, by).alias("right")
    left = few.join(blocks, key, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1))).alias("left")
    x, y = _of("left"), _of("right")
    same = (x(key) == y(key)) & (x("__block") == y("__block")) & (x(by) != y(by))
    return left.join(right, same if fits is None else same & fits(x, y)).select(x(by).alias("a"), y(by).alias("b"))


def by_rarity(rows: DataFrame, key: str, by: str) -> DataFrame:
    """by, key, place (1 for the rarest key of `by`), size (keys of `by`), from rows that hold each (key, by) once."""
    held = rows.groupBy(key).agg(F.count("*").alias("__df"))
    own = rows.join(held, key).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__df", key))).alias("__own"))
    return own.select(by, F.size("__own").alias("size"), F.posexplode("__own").alias("__at", "__x")).select(by, F.col(f"__x.{key}").alias(key), (F.col("__at") + 1).alias("place"), "size")
