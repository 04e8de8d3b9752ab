"""Queries over series, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources import bindings as B

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

ORDERS = """orders_obs AS (
    SELECT 'orders:' || n_name AS series, n_name AS subject, date_trunc('month', o_orderdate) AS tick, CAST(count(*) AS DOUBLE) AS value, 'ok' AS status
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY ALL
)"""
BUYERS = """buyers_obs AS (
    SELECT 'buyers:' || n_name AS series, n_name AS subject, date_trunc('month', o_orderdate) AS tick, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS value, 'ok' AS status
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY ALL
)"""
TRADE = """trade_obs AS (
    SELECT 'trade:' || n_name AS series, n_name AS subject, date_trunc('month', l_shipdate) AS tick, sum(l_quantity) AS value, 'ok' AS status
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate < TIMESTAMP '2001-08-01' GROUP BY ALL
)"""
ATTENTION = """attention_obs AS (
    SELECT 'attention:' || n_name AS series, n_name AS subject, CAST(CAST(ts AS DATE) - 8217 AS TIMESTAMP) AS tick, CAST(count(*) AS DOUBLE) AS value, 'ok' AS status
    FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE event_type = 'view' GROUP BY ALL
)"""
EVENTS = """events_obs AS (
    SELECT event_type AS series, event_type AS subject, date_trunc('day', ts) AS tick, CAST(count(*) AS DOUBLE) AS value, 'ok' AS status FROM events GROUP BY ALL
)"""
ALL = f"{ORDERS}, {BUYERS}, {TRADE}, {ATTENTION}, all_obs AS (SELECT * FROM orders_obs UNION ALL SELECT * FROM buyers_obs UNION ALL SELECT * FROM trade_obs UNION ALL SELECT * FROM attention_obs)"


def pct(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / nullif(abs({b}), 0) * 100"


def ranked(obs: str) -> str:
    return f"""ranked AS (
    SELECT *, n - i AS r FROM (SELECT series, subject, tick, value, row_number() OVER (PARTITION BY series ORDER BY tick, value) - 1 AS i, count(*) OVER (PARTITION BY series) AS n
        FROM {obs} WHERE status = 'ok' AND value IS NOT NULL)
)"""


def profile(obs: str) -> str:
    """CTEs that end in profile: the growth profile of each series."""
    back = "tick <= last_at - INTERVAL '{0} days'"
    growth = ", ".join(f"max_by(value, i) FILTER ({back.format(d)}) AS at_{d}" for d in (7, 30, 90, 365))
    windows = ", ".join(f"{pct('latest', f'at_{d}')} AS growth_{d}d" for d in (7, 30, 90, 365))
    return f"""{ranked(obs)}, lasts AS (
    SELECT *, max(tick) OVER w AS last_at, min(tick) OVER w AS first_at, first_value(i) OVER (PARTITION BY series ORDER BY value DESC, i) AS peak_i, max(value) OVER w AS peak_value
    FROM ranked WINDOW w AS (PARTITION BY series)
), typical AS (SELECT series, median(value) FILTER (i <> peak_i) AS others FROM lasts GROUP BY series
), points AS (SELECT * FROM lasts JOIN typical USING (series)
), blocked AS (
    SELECT series, i, value, n, least(5, greatest(3, n // 3)) AS k FROM points WHERE n >= 6
), bucketed AS (
    SELECT series, CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // (n // k) END AS b, avg(value) AS m FROM blocked GROUP BY ALL
), stepped AS (SELECT series, m, lag(m) OVER (PARTITION BY series ORDER BY b) AS p FROM bucketed
), rises AS (SELECT series, round(count(*) FILTER (m > p) / count(p), 4) AS persistence FROM stepped GROUP BY series
), facts AS (
    SELECT series, any_value(subject) AS subject, max(n) AS n, max(first_at) AS first_at, max(last_at) AS last_at, max_by(value, i) AS latest, min_by(value, i) AS earliest,
        median(value) AS typical_value, median(value) FILTER (i < greatest(1, least(5, n // 4))) AS baseline_value, {growth},
        count(*) FILTER (tick >= last_at - INTERVAL '30 days') AS recent_n,
        regr_slope(value, epoch(tick) / 86400.0) FILTER (tick >= last_at - INTERVAL '30 days') AS slope, avg(value) FILTER (tick >= last_at - INTERVAL '30 days') AS recent_mean,
        regr_slope(value, epoch(tick) / 86400.0) FILTER (r <= least(8, n)) AS few_slope, avg(value) FILTER (r <= least(8, n)) AS few_mean,
        max(value) FILTER (i = n // 2 - 1) AS early_end, max(value) FILTER (i = n // 2) AS late_begin,
        max(peak_i) AS peak_i, max(peak_value) AS peak_value, max(others) AS others,
        max(value) FILTER (i = peak_i - 1 AND value > 0) AS b, max(value) FILTER (i = peak_i + 1 AND value > 0) AS a,
        max(i) FILTER (i < peak_i AND value < 3 * others) AS low_left, min(i) FILTER (i > peak_i AND value < 3 * others) AS low_right,
        median(value) FILTER (i > peak_i) AS after_median, max(value) FILTER (r > 1) AS prior_maximum, avg(value) AS mean,
        avg(value) FILTER (month(tick) = month(last_at)) AS month_mean, sum(value) FILTER (tick > last_at - INTERVAL '365 days') AS year,
        sum(value) FILTER (tick > last_at - INTERVAL '730 days' AND tick <= last_at - INTERVAL '365 days') AS prior_year
    FROM points GROUP BY series
), measured AS (
    SELECT *, date_diff('second', first_at, last_at) // 86400 AS history_days, {windows}, {pct('latest', 'earliest')} AS growth_total,
        CASE WHEN n >= 4 THEN CASE WHEN recent_n >= 3 THEN slope / abs(nullif(recent_mean, 0)) ELSE few_slope / abs(nullif(few_mean, 0)) END * 100 END AS momentum,
        CASE WHEN n >= 6 THEN {pct('latest', 'late_begin')} - ({pct('early_end', 'earliest')}) END AS acceleration_pp,
        {pct('year', 'prior_year')} AS yoy
    FROM facts LEFT JOIN rises USING (series)
), missing AS (SELECT series, count(*) - count(value) FILTER (status = 'ok') AS missing_count FROM {obs} GROUP BY series
), profile AS (
    SELECT *, latest AS latest_value, latest - at_30 AS absolute_growth_30d, latest - baseline_value AS absolute_growth_total,
        coalesce(n >= 5 AND others > 0 AND peak_value / others >= 5 AND peak_value / least(a, b) >= 5 AND coalesce(low_right, n) - coalesce(low_left, -1) - 1 <= 2
            AND (coalesce(after_median <= 2 * others, false) OR peak_i = n - 1), false) AS is_one_day_spike,
        CASE WHEN n >= 5 AND others > 0 THEN peak_value / others END AS spike_ratio,
        CASE WHEN n >= 24 AND history_days >= 400 AND mean > 0 THEN month_mean / mean END AS month_index,
        CASE WHEN n >= 24 AND history_days >= 400 AND mean > 0 THEN yoy END AS yoy_change_pct,
        CASE WHEN coalesce(growth_30d, growth_90d, growth_total) IS NULL THEN 'unknown' WHEN coalesce(growth_30d, growth_90d, growth_total) > 5 THEN 'rising'
            WHEN coalesce(growth_30d, growth_90d, growth_total) < -5 THEN 'falling' ELSE 'flat' END AS direction
    FROM measured JOIN missing USING (series)
)"""


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c).cast("bigint") if t in ("int", "smallint") else F.col(c) for c, t in df.select(*columns).dtypes])


@query(f"WITH {EVENTS} SELECT series, strftime(tick, '%Y-%m-%d') AS day, CAST(value AS BIGINT) AS n FROM events_obs")
def daily_counts(spark, sf_dir):
    return S.daily_counts(B.table(spark, sf_dir, "events"), "event_type", "ts").select("series", F.date_format("at", "yyyy-MM-dd").alias("day"), "n")


@query(f"""WITH {ORDERS}, holed AS (SELECT * FROM orders_obs WHERE month(tick) <> 2),
spans AS (SELECT series, min(tick) AS lo, max(tick) AS hi FROM holed GROUP BY series),
months AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL '1 month')) AS tick FROM spans)
SELECT m.series, strftime(m.tick, '%Y-%m-%d') AS month, round(o.value, 4) AS value, coalesce(o.status, 'missing') AS status FROM months m LEFT JOIN holed o USING (series, tick)""")
def gap_calendar(spark, sf_dir):
    holed = B.series(spark, sf_dir, "orders").filter(F.month("at") != 2)
    return S.gap_calendar(holed).select("series", F.date_format("at", "yyyy-MM-dd").alias("month"), F.round("value", 4).alias("value"), "status")


@query(f"""WITH {ORDERS} SELECT series, strftime(tick, '%Y-%m-%d') AS month, value, p AS previous, round({pct('value', 'p')}, 4) AS change_pct
FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY tick) AS p FROM orders_obs)""")
def prev_chain(spark, sf_dir):
    return S.chained(B.series(spark, sf_dir, "orders")).select("series", F.date_format("at", "yyyy-MM-dd").alias("month"), "value", "previous", F.round("change_pct", 4).alias("change_pct"))


@query(f"""WITH {EVENTS} SELECT series, strftime(tick, '%Y-%m-%d') AS day, CASE WHEN count(*) OVER w = 7 THEN round(avg(value) OVER w, 4) END AS moving_average
FROM events_obs WINDOW w AS (PARTITION BY series ORDER BY tick ROWS 6 PRECEDING)""")
def moving_avg(spark, sf_dir):
    return S.moving_average(B.events_series(spark, sf_dir)).select("series", F.date_format("at", "yyyy-MM-dd").alias("day"), F.round("moving_average", 4).alias("moving_average"))


def statistics_sql(obs: str) -> str:
    return f"""{ranked(obs)}, shifts AS (
    SELECT series, i, abs(avg(value) OVER hi - avg(value) OVER lo) / nullif(sqrt(var_samp(value) OVER lo / i + var_samp(value) OVER hi / r), 0) AS t, n FROM ranked
    WINDOW lo AS (PARTITION BY series ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), best AS (
    SELECT series, arg_max(i, (round(t, 9), -i)) AS i, max(t) AS t FROM shifts WHERE i >= 5 AND i < n - 5 AND t IS NOT NULL GROUP BY series
), summed AS (
    SELECT series, max(n) AS n, max(value) FILTER (r = 1) AS last, max(value) FILTER (r = 2) AS second, max(value) FILTER (r = least(8, n)) AS back, avg(value) FILTER (r <= 7) AS mean,
        avg(value) FILTER (r BETWEEN 2 AND 31) AS hm, stddev_samp(value) FILTER (r BETWEEN 2 AND 31) AS hs, count(*) FILTER (r BETWEEN 2 AND 31) AS hn,
        max(value) FILTER (r = 7) AS r0, max(value) FILTER (r = 8) AS p1, max(value) FILTER (r = 14) AS p0,
        sum(CASE WHEN i = 0 THEN value * power(0.7, n - 1) ELSE value * 0.3 * power(0.7, r - 1) END) AS ewma
    FROM ranked GROUP BY series
), stats AS (
    SELECT s.series, s.n, {pct('last', 'second')} AS change_last, {pct('last', 'back')} AS change_window, CASE WHEN s.n >= 7 THEN mean END AS moving_average,
        CASE WHEN s.n >= 8 AND hn >= 7 AND hs <> 0 THEN (last - hm) / hs END AS zscore, ewma, CASE WHEN s.n >= 15 THEN {pct('last', 'r0')} - ({pct('p1', 'p0')}) END AS acceleration,
        CASE WHEN s.n >= 10 AND t >= 3 THEN best.i END AS changepoint
    FROM summed s LEFT JOIN best USING (series)
)"""


SUMMARY = """SELECT series, n, round(change_last, 4) AS change_last, round(change_window, 4) AS change_window, round(moving_average, 4) AS moving_average, round(zscore, 4) AS zscore,
    round(ewma, 4) AS ewma, round(acceleration, 4) AS acceleration, changepoint, coalesce(abs(zscore) >= 2.5, false) OR changepoint IS NOT NULL AS is_anomaly,
    CASE WHEN change_window IS NULL THEN 'unknown' WHEN change_window > 1 THEN 'up' WHEN change_window < -1 THEN 'down' ELSE 'flat' END AS direction,
    round(0.6 * least(coalesce(abs(zscore), 0) / 5, 1) + 0.4 * least(coalesce(abs(acceleration), 0) / 50, 1), 4) AS strength FROM stats"""
SUMMED = ("series", "n", "change_last", "change_window", "moving_average", "zscore", "ewma", "acceleration", "changepoint", "is_anomaly", "direction", "strength")


@query(f"WITH {ORDERS}, {statistics_sql('orders_obs')} {SUMMARY}")
def series_summary(spark, sf_dir):
    return rounded(S.statistics(B.series(spark, sf_dir, "orders")), *SUMMED)


@query(f"WITH {EVENTS}, {statistics_sql('events_obs')} {SUMMARY}")
def event_summary(spark, sf_dir):
    return rounded(S.statistics(B.events_series(spark, sf_dir)), *SUMMED)


def _part(name: str, family: str, cte: str, *columns: str) -> None:
    shown = ", ".join(f"round({c}, 4) AS {c}" if c not in TEXT else c for c in columns)
    sql = f"WITH {cte}, {profile(family + '_obs')} SELECT series, {shown} FROM profile"

    def run(spark, sf_dir):
        return rounded(S.growth_profile(B.series(spark, sf_dir, family)), "series", *columns)

    QUERIES[name], ORACLE[name] = run, sql


TEXT = ("direction", "is_one_day_spike", "missing_count", "history_days")
_part("growth_windows", "orders", ORDERS, "growth_7d", "growth_30d", "growth_90d", "growth_365d", "absolute_growth_30d")
_part("persistence", "orders", ORDERS, "persistence", "baseline_value", "typical_value", "absolute_growth_total")
_part("momentum", "trade", TRADE, "momentum", "acceleration_pp", "prior_maximum")
_part("spike", "attention", ATTENTION, "is_one_day_spike", "spike_ratio")
_part("seasonality", "trade", TRADE, "month_index", "yoy_change_pct")
_part("growth_profile", "trade", TRADE, "latest_value", "baseline_value", "typical_value", "growth_30d", "growth_90d", "momentum", "persistence", "acceleration_pp", "direction", "missing_count", "history_days")


@query(f"""WITH {ORDERS}, {profile('orders_obs')} SELECT subject, round(coalesce(growth_30d, growth_90d), 4) AS growth, round(acceleration_pp, 4) AS acceleration_pp, persistence, direction
FROM profile ORDER BY growth DESC NULLS LAST, subject LIMIT 10""")
def top_growth(spark, sf_dir):
    """The ten nations whose orders grow most."""
    found = S.growth_profile(B.series(spark, sf_dir, "orders")).withColumn("growth", F.round(F.coalesce("growth_30d", "growth_90d"), 4))
    return found.select(F.substring_index("series", ":", -1).alias("subject"), "growth", F.round("acceleration_pp", 4).alias("acceleration_pp"), "persistence", "direction").orderBy(F.desc_nulls_last("growth"), "subject").limit(10)
