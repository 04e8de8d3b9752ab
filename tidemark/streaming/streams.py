"""The stateful behaviours of ingest and scoring as Structured Streaming jobs.

Each function takes a streaming DataFrame and returns one; state is bounded by a watermark or by one
small row for each key. Steps with state of their own follow an aggregation in the same query: Spark closes event-time
windows and folds their rows, and folded() keeps one row for each key, in lists for groups of keys. drained() runs a stream over what there is and
reads what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ListState
from pyspark.sql.types import StructType

from ..sources.places import new_folder

#: Keys with timers need the store that Spark keeps on the executors' disks, and in the checkpoint.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


@contextmanager
def _with_store(spark: SparkSession) -> Iterator[None]:
    """A query takes the setting when it starts; the session gets its own back."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def run(stream: DataFrame, at: str) -> StreamingQuery:
    """Write all there is now to at/out, from where the query whose state is in at/state has come to."""
    with _with_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drained(stream: DataFrame) -> DataFrame:
    """What the stream gives for all input that is there now."""
    at = new_folder(stream.sparkSession, "streams")
    run(stream, at)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def daily(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Counts of closed days only."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col(key)).agg(F.count("*").alias("n"))
    return days.select(F.col(key).alias("series"), F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


def weekly(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Counts of closed ISO weeks, Monday to Sunday: the windows of weekly digests."""
    weeks = stream.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "7 days", "4 days"), F.col(key)).agg(F.count("*").alias("n"))  # the epoch was a Thursday
    week = F.concat_ws("-W", F.extract(F.lit("YEAROFWEEK"), F.col("window.start")).cast("string"), F.lpad(F.weekofyear("window.start").cast("string"), 2, "0"))
    return weeks.select(F.col(key).alias("series"), week.alias("week"), "n")


#: Into how many groups keys are dealt. It is part of a checkpoint, so it stays as it is while one is used.
GROUPS = 1024


def in_groups(stream: DataFrame, *keys: str, groups: int | None = None) -> GroupedData:
    """`stream` grouped by groups of its keys, for state that is read and written once for all keys of a group. With a call
    for each key, calls to the state and small frames take milliseconds a key, however little there is to do."""
    return stream.withColumn("dealt", F.pmod(F.xxhash64(*keys), F.lit(groups or GROUPS)).cast("int")).groupBy("dealt")


def put_all(state: ListState, rows: list[tuple], at_once: int = 10_000) -> None:
    """`rows` in place of what a list holds."""
    if not rows:
        state.clear()
    for k in range(0, len(rows), at_once):
        state.appendList(rows[k : k + at_once]) if k else state.put(rows[:at_once])


def only_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The timer of a group in place of the one it had, or none."""
    had = list(handle.listTimers())
    for t in had:
        if t != at:
            handle.deleteTimer(t)
    if at is not None and at not in had:
        handle.registerTimer(at)


class Fold(StatefulProcessor):
    """Rows of each key in the order of `at` through `step`, with one row of state for a key and one timer for a group of keys.

    step(key, state or None, rows) gives the next state (None: forget the key), rows to put out, and when the key is
    due in milliseconds (None: never); expired(key, state, due) gives the same when event time has passed it. A group's state
    is a list with a row for each key, and its timer stands at the earliest time when one is due. Spark calls a timer when
    event time has come to it, so it is set a millisecond behind."""

    def __init__(self, key: str, step: Callable, kept: str, out: str, expired: Callable | None = None):
        self.key, self.step, self.expired = key, step, expired
        self.kept = f"of_key string, due long, {kept}"
        self.columns = StructType.fromDDL(out).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("states", self.kept)

    def _held(self) -> dict[str, tuple[int | None, tuple]]:
        return {key: (due, tuple(state)) for key, due, *state in self.state.get()} if self.state.exists() else {}

    def _ended(self, held: dict, keys: list[str], mark: int, out: list[tuple]) -> None:
        """Tells those of `keys` whose time event time has passed."""
        for key in keys:
            while key in held and held[key][0] is not None and held[key][0] < mark:
                self._moved(held, key, self.expired(key, held[key][1], held[key][0]), out)

    def _moved(self, held: dict, key: str, moved: tuple, out: list[tuple]) -> None:
        state, rows, due = moved
        out += rows
        if state is None:
            held.pop(key, None)
        else:
            held[key] = (due, tuple(state))

    def _told(self, held: dict, out: list[tuple]) -> Iterator[pd.DataFrame]:
        put_all(self.state, [(key, due, *state) for key, (due, state) in held.items()])
        if self.expired:
            only_timer(self.handle, min((due + 1 for due, _ in held.values() if due is not None), default=None))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out, own = self._held(), [], {}
        # as many rows as windows of the group's keys were closed together
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").to_dict("records"):
            own.setdefault(r[self.key], []).append(r)
        for name, ordered in own.items():
            self._moved(held, name, self.step(name, held[name][1] if name in held else None, ordered), out)
        if self.expired:
            self._ended(held, list(own), timerValues.getCurrentWatermarkInMs(), out)
        yield from self._told(held, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        self._ended(held, list(held), timerValues.getCurrentWatermarkInMs(), out)
        yield from self._told(held, out)

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, step: Callable, kept: str, out: str, expired: Callable | None = None, groups: int | None = None) -> DataFrame:
    """`stream` (with its event time in `at`, and a string as its key) through a Fold."""
    return in_groups(stream, key, groups=groups).transformWithStateInPandas(Fold(key, step, kept, out, expired), out, "Append", "EventTime" if expired else "None")


def closed_windows(stream: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """series, start, at, rows (ts, value in order) of each window that the watermark has closed. What is held
    at once is the rows of open windows; rows that come later than the watermark are dropped, so windows of a
    series leave in order and what follows may rely on it."""
    rows = F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("rows")
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", every), "series").agg(rows)
    return windows.select("series", F.col("window.start").alias("start"), F.window_time("window").alias("at"), "rows")


def ewma(stream: DataFrame, alpha: float = 0.3, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """series, start, n, ewma: the running exponential mean of each series (series, ts, value) behind each
    closed window. A window is folded to its number of rows and what they add; state carries the mean."""
    added = F.aggregate("rows", F.lit(0.0), lambda m, r: (1 - alpha) * m + alpha * r["value"])
    windows = closed_windows(stream.filter("value is not null"), every, late).select("series", "start", "at", F.size("rows").alias("n"), added.alias("added"), F.col("rows")[0]["value"].alias("first"))

    def step(key, state, rows):
        n, mean = state or (0, None)
        out = []
        for w in rows:
            mean = (w["first"] if mean is None else mean) * (1 - alpha) ** w["n"] + w["added"]  # the first value is its own mean
            n += int(w["n"])
            out.append((key, w["start"], n, float(mean)))
        return (n, float(mean)), out, None

    return folded(windows, "series", step, "n long, mean double", "series string, start timestamp, n long, ewma double")


def changes(stream: DataFrame, threshold: float = 5.0, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """series, ts, kind, magnitude: rows of a score stream (series, ts, value) that moved by the threshold since
    the row before. Inside of a window rows are compared with each other, and the first one with the last of
    the window before, which is all that state carries."""
    windows = closed_windows(stream.filter("value is not null"), every, late)
    pairs = F.zip_with(F.slice("rows", F.lit(1), F.size("rows") - 1), F.slice("rows", F.lit(2), F.size("rows")), lambda a, b: F.struct(F.unix_micros(b["ts"]).alias("at"), (b["value"] - a["value"]).alias("move")))
    inside = F.filter(pairs, lambda p: F.abs(p["move"]) >= threshold)
    moved = windows.select("series", "at", F.unix_micros(F.col("rows")[0]["ts"]).alias("begin"), F.col("rows")[0]["value"].alias("first"), F.element_at("rows", -1)["value"].alias("last"), F.to_json(inside).alias("inside"))

    def step(key, state, rows):
        last = state[0] if state else None
        out = []
        for w in rows:
            border = w["first"] - last if last is not None and abs(w["first"] - last) >= threshold else None
            out.append((key, int(w["begin"]), border, w["inside"]))
            last = float(w["last"])
        return (last,), out, None

    found = folded(moved, "series", step, "last double", "series string, begin long, move double, inside string")
    both = F.concat(F.array(F.struct(F.col("begin").alias("at"), "move")), F.from_json("inside", "array<struct<at: bigint, move: double>>"))
    each = found.select("series", F.explode(both).alias("p")).select("series", F.timestamp_micros("p.at").alias("ts"), "p.move").filter("move is not null")
    kind = F.when(F.col("move") > 0, "score_increased").otherwise("score_decreased")
    return each.select("series", "ts", kind.alias("kind"), F.abs("move").alias("magnitude"))


def cooldown(stream: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """series, ts: rows that fire: none within `hours` after one that fired. A window is no longer than an hour or
    the cooldown, so at most one row of it fires: the first from the time on when the series is free, which is
    the state, and is dropped by a timer when that time has passed."""
    windows = closed_windows(stream.withColumn("value", F.lit(None).cast("double")), f"{max(1, min(60, hours * 60))} minutes", late)
    times = windows.select("series", "at", F.array_join(F.array_distinct(F.transform("rows", lambda r: F.unix_micros(r["ts"]).cast("string"))), ",").alias("times"))

    def step(key, state, rows):
        free, out = state[0] if state else -(1 << 62), []
        for w in rows:
            fit = next((t for t in map(int, w["times"].split(",")) if t >= free), None)
            if fit is not None:
                out.append((key, pd.Timestamp(fit, unit="us")))
                free = fit + hours * 3_600_000_000
        return (free,), out, free // 1000

    return folded(times, "series", step, "free long", "series string, ts timestamp", lambda key, state, due: (None, [], None))
