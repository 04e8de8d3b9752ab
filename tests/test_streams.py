"""Streams that stop and start again, late and repeated input, and ends that only a timer tells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ingest as I
from tidemark.streaming import lifecycles as L
from tidemark.streaming import streams as T

SCHEMA = "subject string, day int, score double, confidence double, sources int, stage string, spike boolean"
START = dt.datetime(2024, 1, 1)


def land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def followed(spark, path):
    """Evaluations as they land, each with the observation of its own day."""
    raw = spark.readStream.schema(SCHEMA).parquet(path)
    at = F.timestamp_seconds(F.lit(int(START.replace(tzinfo=dt.timezone.utc).timestamp())) + F.col("day").cast("long") * 86_400)
    e = raw.withColumn("at", at).withWatermark("at", "1 day")
    seen = F.unix_millis("at")
    named = {"trend_score": "score", "independent_sources": "sources", "is_one_day_spike": "spike"}
    return L.trend_lifecycle(e.select("subject", "at", seen.alias("seen_first"), seen.alias("seen_last"), "confidence", "stage", F.lit(False).alias("is_seasonal"), *[F.col(v).alias(k) for k, v in named.items()]), 0)


def told(spark, at):
    rows = spark.read.parquet(f"{at}/out").collect()
    return sorted((r["subject"], (r["at"] - START).days, r["state"], r["peak"], r["cause"]) for r in rows)


A, B, C = [("a", d, s, 60.0, 3, "emerging", False) for d, s in ((0, 70.0), (5, 45.0), (9, 72.0))], [("b", 1, 40.0, 30.0, 2, "emerging", False), ("b", 8, 40.0, 30.0, 2, "emerging", True)], [("c", 2, 10.0, 90.0, 5, "declining", False)]
LATER = [("z", 200, 5.0, 5.0, 1, "emerging", False)]
BACK = [("a", 210, 65.0, 60.0, 2, "emerging", False), ("z", 300, 5.0, 5.0, 1, "emerging", False)]
WANTED = [
    ("a", 0, "confirmed", 70.0, "evaluation"), ("a", 5, "weakening", 70.0, "evaluation"), ("a", 9, "confirmed", 72.0, "evaluation"), ("a", 70, "ended", 72.0, "silence"),
    ("a", 210, "confirmed", 72.0, "evaluation"), ("a", 271, "ended", 72.0, "silence"),
    ("b", 1, "active", 40.0, "evaluation"), ("b", 8, "invalidated", 40.0, "evaluation"), ("b", 69, "ended", 40.0, "silence"),
    ("c", 2, "weakening", 10.0, "evaluation"), ("c", 63, "ended", 10.0, "silence"),
    ("z", 200, "candidate", 5.0, "evaluation"), ("z", 261, "ended", 5.0, "silence"), ("z", 300, "candidate", 5.0, "evaluation"),
]


@pytest.mark.parametrize("restarts", [False, True])
def test_lifecycle(spark, tmp_path, restarts):
    """Subjects that end by the timer alone, one that comes back, and the same states however often the query stops."""
    given, at = str(tmp_path / "in"), str(tmp_path / "run")
    for rows in (A + B + C, LATER, BACK):
        land(spark, rows, given)
        if restarts:
            T.run(followed(spark, given), at)
    T.run(followed(spark, given), at)
    assert told(spark, at) == sorted(WANTED)


@pytest.mark.parametrize("last, ends", [(62, []), (63, [("a", 61)])])
def test_an_end_on_the_watermark_waits(spark, tmp_path, last, ends):
    """Event time that has come to the day of an end, and not passed it, doesn't tell the end."""
    given, at = str(tmp_path / "in"), str(tmp_path / "run")
    land(spark, [("a", 0, 70.0, 60.0, 3, "emerging", False), ("z", last, 5.0, 5.0, 1, "emerging", False)], given)
    T.run(followed(spark, given), at)
    assert [row[:2] for row in told(spark, at) if row[4] == "silence"] == ends


def test_setting_of_the_session_stays(spark, tmp_path):
    before = spark.conf.get(T.STORE[0], None)
    with T._with_store(spark):
        assert spark.conf.get(*T.STORE) == T.STORE[1]
    assert spark.conf.get(T.STORE[0], None) == before


READINGS = "series string, ts timestamp, value double, arrived long"


def reading(series, minute, value, arrived):
    return series, None if minute is None else START + dt.timedelta(minutes=minute), value, arrived


def test_first_value_wins(spark, tmp_path):
    """Late, repeated, and out of order; a batch that runs again; nulls; one row for each moment with its first value."""
    given, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    batches = [
        [reading("a", 1, 1.0, 2), reading("a", 1, 9.0, 1), reading("b", 1, 5.0, 3), reading(None, 1, 0.0, 4), reading("a", None, 0.0, 5)],
        [reading("a", 1, 7.0, 6), reading("a", 2, 2.0, 7), reading("a", 2, 2.0, 7), reading("b", 1, 5.0, 3)],
        [reading("a", -20_000, 3.0, 8), reading("b", 1, None, 9), reading("b", 2, None, 10), reading("b", 2, 4.0, 11)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").parquet(given)
        for _ in range(2):
            I.ingest(spark.readStream.schema(READINGS).parquet(given), store, state, ["series", "ts"], "arrived")
    wanted = sorted([("a", START + dt.timedelta(minutes=1), 9.0, 1), ("b", START + dt.timedelta(minutes=1), 5.0, 3), ("a", START + dt.timedelta(minutes=2), 2.0, 7), ("a", START - dt.timedelta(minutes=20_000), 3.0, 8), ("b", START + dt.timedelta(minutes=2), None, 10)])
    schema = spark.createDataFrame([], READINGS).schema
    rows = lambda: sorted((r["series"], r["ts"], r["value"], r["arrived"]) for r in I.stored(spark, store, schema).collect())
    assert rows() == wanted
    for number in (1, 2):  # as after a failure behind the write: the same batch once more
        I.merge(spark.createDataFrame(batches[number], READINGS), number, store, ["series", "ts"], "arrived")
        assert rows() == wanted


def test_changes_and_cooldown_over_restarts(spark, tmp_path):
    """What state carries over a stop: the last value of a series, and until when it is not to fire."""
    schema = "series string, ts timestamp, value double"
    rows = [("s", START + dt.timedelta(minutes=30 * k), float(v)) for k, v in enumerate([0, 10, 11, 20, 20, 1, 1, 9, 9, 9, 30, 30])]
    given, one, two = (str(tmp_path / x) for x in ("in", "one", "two"))
    for k in range(0, len(rows), 4):
        spark.createDataFrame(rows[k : k + 4], schema).coalesce(1).write.mode("append").parquet(given)
        stream = spark.readStream.schema(schema).parquet(given)
        T.run(T.changes(stream), one)
        T.run(T.cooldown(stream, 2), two)
    spark.createDataFrame([("t", START + dt.timedelta(days=3), 0.0)], schema).coalesce(1).write.mode("append").parquet(given)
    T.run(T.changes(spark.readStream.schema(schema).parquet(given)), one)
    T.run(T.cooldown(spark.readStream.schema(schema).parquet(given), 2), two)
    moves = [(r["ts"], r["kind"], r["magnitude"]) for r in spark.read.parquet(f"{one}/out").filter("series = 's'").orderBy("ts").collect()]
    assert moves == [(rows[k][1], "score_increased" if b > a else "score_decreased", abs(b - a)) for k, (a, b) in enumerate(zip([0, 0, 10, 11, 20, 20, 1, 1, 9, 9, 9, 30], [r[2] for r in rows])) if abs(b - a) >= 5]
    fired = sorted(r["ts"] for r in spark.read.parquet(f"{two}/out").filter("series = 's'").collect())
    assert fired == [rows[k][1] for k in (0, 4, 8)]
