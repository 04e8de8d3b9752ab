"""Hand-made series with known answers."""

import datetime as dt

from tidemark.operators import series as S
from tidemark.operators import trends as T


def frame(spark, **series):
    rows = [(name, dt.datetime(2024, 1, 1) + dt.timedelta(days=step * i), None if v is None else float(v), "missing" if v is None else "ok") for name, (step, values) in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, at timestamp, value double, status string")


def test_profiles(spark):
    obs = frame(
        spark,
        gaps=(30, [100, None, 120, None, 140, 160, 180, 200]), zeros=(30, [50, 40, 0, 30, 20, 10, 0, 0]), none=(30, [None] * 5), spike=(1, [10, 11, 9, 300, 12, 10, 11]),
        late=(1, [10, 11, 10, 9, 11, 300]), plateau=(1, [10, 11, 9, 10, 10, 10, 60, 61, 62, 60]), season=(30, [100 + (60 if i % 12 == 0 else 0) for i in range(37)]), short=(1, [1, 2]),
    )
    got = {r["series"]: r for r in S.growth_profile(obs).collect()}
    assert (got["gaps"]["observation_count"], got["gaps"]["missing_count"], got["gaps"]["direction"]) == (6, 2, "rising")
    assert (got["zeros"]["observation_count"], got["zeros"]["missing_count"], got["zeros"]["direction"]) == (8, 0, "falling")
    assert got["none"]["direction"] == "unknown" and got["none"]["growth_30d"] is None and got["none"]["observation_count"] == 0
    assert got["spike"]["is_one_day_spike"] and got["late"]["is_one_day_spike"] and not got["plateau"]["is_one_day_spike"]
    assert got["season"]["month_index"] > 1.15
    assert got["short"]["growth_30d"] is None and got["short"]["persistence"] is None


def test_statistics(spark):
    obs = frame(spark, flat=(1, [5] * 30), jump=(1, [10 + i % 3 for i in range(30)] + [200]), hole=(1, [1, None, 3, 4]), empty=(1, [None]))
    got = {r["series"]: r for r in S.statistics(obs).collect()}
    assert got["flat"]["zscore"] is None and got["jump"]["zscore"] > 5 and got["jump"]["is_anomaly"]
    assert got["hole"]["direction"] == "unknown" and got["empty"]["n"] == 1


def test_order_and_partitions_change_nothing(spark):
    obs = frame(spark, a=(1, list(range(40))), b=(7, [i * i % 17 for i in range(60)]))
    one, other = S.growth_profile(obs), S.growth_profile(obs.orderBy("value").repartition(7))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_lifecycle_needs_corroboration(spark):
    base = "'s' subject, 0 days_since_last, false is_one_day_spike, false is_seasonal, 90d peak_score, 'emerging' stage"
    rows = spark.sql(f"select {base}, 70d trend_score, 60d confidence, 1 independent_sources, null previous_state union all select {base}, 70d, 60d, 2, null union all select {base}, 65d, 60d, 2, 'active'")
    assert [r[0] for r in rows.select(T.next_state()).collect()] == ["candidate", "confirmed", "weakening"]
