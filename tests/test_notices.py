"""Streams of what users are told, over restarts, against plain loops and the batch operators."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitoring as M
from tidemark.streaming import notices as N
from tidemark.streaming import streams as T

START = dt.datetime(2024, 3, 1)
HOUR = dt.timedelta(hours=1)
c = F.col


def fed(spark, tmp_path, schema, parts, step):
    """What `step` gives, stopped and started again behind each part."""
    given, at = str(tmp_path / "in"), str(tmp_path / "run")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(given)
        T.run(step(spark.readStream.schema(schema).parquet(given)), at)
    return spark.read.parquet(f"{at}/out")


@pytest.mark.parametrize("remember", [40, 400])
def test_facts_are_told_once(spark, tmp_path, remember):
    """Replayed facts: not while they are remembered; what came in the quiet hours may come again."""
    draw = random.Random(5)
    rows = sorted(((f"r{draw.randrange(3)}", f"u{draw.randrange(2)}", START + draw.randrange(300) * HOUR + dt.timedelta(minutes=draw.randrange(60)), f"f{draw.randrange(12)}", 7) for _ in range(400)), key=lambda r: r[2])
    rows += [(None, "u0", START, "f", 1), ("r0", None, START, "f", 1), ("r0", "u0", START, None, 1)]
    last = [("z", "z", START + 900 * HOUR, "z", None)]
    schema = "rule_id string, user_id string, ts timestamp, fact string, cooldown_hours int"
    parts = [rows[:150] + rows[400:], rows[150:260], rows[260:400], last]
    got = fed(spark, tmp_path, schema, parts, lambda s: N.told_once(s, remember=remember * 3_600_000)).collect()
    runs, free, told, wanted = {}, {}, {}, []
    for rule, user, ts, fact, _ in rows[:400]:
        runs.setdefault((ts.replace(minute=0) + HOUR, rule, user), set()).add(fact)
    for (end, rule, user), facts in sorted(runs.items()):
        if end < free.get((rule, user), end):
            continue
        new = [f for f in sorted(facts) if end - told.get((rule, user, f), START - 10_000 * HOUR) > remember * HOUR]
        told |= {(rule, user, f): end for f in new}
        wanted += [(rule, user, f, end) for f in new]
        if new:
            free[rule, user] = end + 7 * HOUR
    # Spark names a run by the last millisecond of its window
    seen = sorted((r["rule_id"], r["user_id"], r["fact"], r["at"].replace(microsecond=0) + dt.timedelta(seconds=1)) for r in got)
    assert len({w[:3] for w in wanted}) < len(wanted) if remember == 40 else len({w[:3] for w in wanted}) == len(wanted)
    assert seen == sorted(wanted)


def test_changes_of_every_kind(spark, tmp_path):
    draw = random.Random(3)
    rows = [(f"s{k % 4}", START + dt.timedelta(minutes=17 * k), draw.choice([10.0, 14.0, 16.0, 30.0]), draw.choice([1.0, 8.0, 9.0, None]), draw.choice(["low", "high", None]), draw.choice(["a", "b"])) for k in range(120)]
    schema = "subject string, at timestamp, score double, confidence double, risk_level string, state string"
    odd = [(None, START, 1.0, 1.0, "low", "a"), ("s0", START, None, 1.0, "low", "a")]
    last = [("z", START + dt.timedelta(days=9), 1.0, 1.0, "low", "a")]
    got = fed(spark, tmp_path, schema, [rows[:50] + odd, rows[50:70], rows[70:], last], N.changes)
    want = M.change_events(spark.createDataFrame(rows, schema))
    plain = lambda df: sorted(map(tuple, df.select("subject", "at", "kind", "magnitude").collect()))
    assert plain(got) == plain(want) and {r["kind"] for r in got.collect()} >= {"risk_increased", "risk_decreased", "state_changed", "confidence_increased", "score_decreased"}


def test_local_periods(spark, tmp_path):
    """Both nights on which clocks change; a user whose last period only the timer ends; frequencies that have none."""
    zones = ["UTC", "America/New_York", "Asia/Kolkata", "Europe/Berlin", "Australia/Lord_Howe"]
    draw = random.Random(8)
    rows = sorted(((u, START + dt.timedelta(minutes=draw.randrange(60 * 24 * 270)), ("daily", "weekly", "never")[u % 3], zones[u % 5]) for u in (draw.randrange(15) for _ in range(1500))), key=lambda r: r[1])
    schema = "user_id int, ts timestamp, frequency string, zone string"
    parts = [rows[:400] + [(None, START, "daily", "UTC"), (1, None, "weekly", "UTC")], rows[400:900], rows[900:], [(99, START + dt.timedelta(days=400), "daily", "UTC")]]
    got = fed(spark, tmp_path, schema, parts, N.local_periods).collect()
    wanted = {}
    for user, ts, how, zone in rows:
        day = ts.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone)).date()
        if how == "weekly":
            day -= dt.timedelta(days=day.weekday())
        begin, end = (dt.datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(zone)).astimezone(dt.timezone.utc).replace(tzinfo=None) for d in (day, day + dt.timedelta(days=1 if how == "daily" else 7)))
        year, week, _ = day.isocalendar()
        if how != "never":
            key = (str(user), f"daily:{day}" if how == "daily" else f"weekly:{year}-W{week:02d}", begin, end)
            wanted[key] = wanted.get(key, 0) + 1
    assert sorted((r["user_id"], r["key"], r["start"], r["end"], r["n"]) for r in got) == sorted((*k, n) for k, n in wanted.items())


def test_keys_that_share_state(spark, tmp_path, monkeypatch):
    """The same rows where all keys share one group, with its lists and its timer; and groups are bounded, however many keys there are."""
    dealt = T.in_groups(spark.range(20_000).select(c("id").cast("string").alias("k")), "k").count().collect()
    assert len(dealt) <= T.GROUPS and max(r["count"] for r in dealt) < 100
    monkeypatch.setattr(T, "GROUPS", 1)
    test_facts_are_told_once(spark, tmp_path / "facts", 40)
    test_changes_of_every_kind(spark, tmp_path / "changes")
    test_local_periods(spark, tmp_path / "periods")
