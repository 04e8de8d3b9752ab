"""Streaming queries, drained over the event stream. SQL gives the same rows from the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.places import new_folder
from ..streaming import ingest as I
from ..streaming import lifecycles as L
from ..streaming import notices as N
from ..streaming import streams as T
from . import alert_queries as AQ

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
VALUES = "event_type AS series, ts, value"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _values(spark, sf_dir):
    return T.events(spark, sf_dir).select(F.col("event_type").alias("series"), "ts", "value")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    e = T.events(spark, sf_dir)
    return T.drained(T.deduplicated(e.union(e), ["event_id"]).select("event_id"))


@query("SELECT event_type AS series, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 day' GROUP BY ALL")
def stream_daily(spark, sf_dir):
    return T.drained(T.daily(T.events(spark, sf_dir), "event_type"))


@query("""SELECT event_type AS series, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, count(*) AS n FROM events
WHERE date_trunc('week', ts) + INTERVAL '7 days' <= (SELECT max(ts) FROM events) - INTERVAL '1 day' GROUP BY ALL""")
def stream_weekly(spark, sf_dir):
    return T.drained(T.weekly(T.events(spark, sf_dir), "event_type"))


@query("""SELECT event_type || '/' || CAST(user_id % 3 AS VARCHAR) AS series, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, arg_min(value, event_id) AS value, min(event_id) AS arrived
FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def stream_first_values(spark, sf_dir):
    """The first reading that arrived for each minute of a series of users, through the store of an ingest stream."""
    series = F.concat_ws("/", "event_type", (F.col("user_id") % 3).cast("string"))
    readings = T.events(spark, sf_dir).filter("value is not null").select(series.alias("series"), F.date_trunc("minute", "ts").alias("ts"), "value", F.col("event_id").alias("arrived"))
    at = new_folder(spark, "ingest")
    I.ingest(readings, f"{at}/store", f"{at}/state", ["series", "ts"], "arrived")
    return I.stored(spark, f"{at}/store", readings.schema).select("series", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), "value", "arrived")


CLOSED = "e AS (SELECT event_type AS series, ts, value FROM events WHERE date_trunc('hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour')"


@query(f"""WITH {CLOSED}, r AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY ts, value) AS i, count(*) OVER (PARTITION BY series) AS n FROM e WHERE value IS NOT NULL)
SELECT series, max(n) AS n, round(sum(CASE WHEN i = 1 THEN value * power(0.7, n - 1) ELSE 0.3 * value * power(0.7, n - i) END), 4) AS ewma FROM r GROUP BY series""")
def stream_ewma(spark, sf_dir):
    last = T.drained(T.ewma(_values(spark, sf_dir))).groupBy("series").agg(F.max_by(F.struct("n", "ewma"), "start").alias("l"))
    return last.select("series", "l.n", F.round("l.ewma", 4).alias("ewma"))


@query(f"""WITH {CLOSED}, r AS (SELECT series, ts, value, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS p FROM e WHERE value IS NOT NULL)
SELECT series, CASE WHEN value > p THEN 'score_increased' ELSE 'score_decreased' END AS kind, count(*) AS n, round(sum(abs(value - p)), 2) AS moved FROM r WHERE abs(value - p) >= 5 GROUP BY ALL""")
def stream_changes(spark, sf_dir):
    return T.drained(T.changes(_values(spark, sf_dir))).groupBy("series", "kind").agg(F.count("*").alias("n"), F.round(F.sum("magnitude"), 2).alias("moved"))


@query(f"""WITH RECURSIVE {CLOSED}, fired AS (SELECT series, min(ts) AS ts FROM e GROUP BY series UNION ALL SELECT series, (SELECT min(x.ts) FROM e x WHERE x.series = fired.series AND x.ts >= fired.ts + INTERVAL '24 hours') FROM fired WHERE ts IS NOT NULL)
SELECT series, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM fired WHERE ts IS NOT NULL""")
def stream_cooldown(spark, sf_dir):
    return T.drained(T.cooldown(_values(spark, sf_dir), 24)).select("series", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


MONTHS = """w AS (
    SELECT o_custkey AS subject, epoch_ms(o_orderdate) // 2592000000 AS b, count(*) AS n, sum(o_totalprice) AS total, count(DISTINCT o_orderpriority) AS sources, min(epoch_ms(o_orderdate)) AS first, max(epoch_ms(o_orderdate)) AS last
    FROM orders GROUP BY ALL
), mark AS (SELECT max(epoch_ms(o_orderdate)) - 86400000 AS now FROM orders
), e AS (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY b) AS k, round(least(100, 15 * n + total / 8000), 2) AS score, least(100, 15 * n + 15 * sources) AS sure,
        lead(first) OVER (PARTITION BY subject ORDER BY b) AS next_first
    FROM w WHERE (b + 1) * 2592000000 <= (SELECT now FROM mark)
)"""
TOLD = """SELECT subject, strftime(make_timestamp(((b + 1) * 2592000000 - 1) // 1000 * 1000000), '%Y-%m-%d') AS day, state, score, peak, 'evaluation' AS cause FROM r
UNION ALL SELECT subject, strftime(make_timestamp((last + {stale}) * 1000), '%Y-%m-%d'), '{over}', NULL, peak, 'silence' FROM r
WHERE CASE WHEN next_first IS NULL THEN last + {stale} + 2592000000 < (SELECT now FROM mark) ELSE next_first >= last + {stale} END AND state <> '{over}'"""


def _months(spark, sf_dir):
    """Closed months of thirty days of each customer."""
    o = T.table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp")).withWatermark("ts", "1 day")
    sums = [F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.size(F.collect_set("o_orderpriority")).alias("sources"), F.unix_millis(F.min("ts")).alias("seen_first"), F.unix_millis(F.max("ts")).alias("seen_last")]
    w = o.groupBy(F.window("ts", "30 days"), F.col("o_custkey").cast("string").alias("subject")).agg(*sums)
    score, sure = F.round(F.least(F.lit(100.0), 15 * F.col("n") + F.col("total") / 8000), 2), F.least(F.lit(100.0), 15.0 * F.col("n") + 15 * F.col("sources"))
    return w.select("subject", F.window_time("window").alias("at"), "n", "total", "sources", "seen_first", "seen_last", score.alias("score"), sure.alias("sure"))


def _told(stream):
    return T.drained(stream).select(F.col("subject").cast("bigint").alias("subject"), F.date_format("at", "yyyy-MM-dd").alias("day"), "state", "score", "peak", "cause")


@query(f"""WITH RECURSIVE {MONTHS}, x AS (SELECT *, n = 1 AND total > 350000 AS spike, CASE WHEN n = 1 AND total > 350000 THEN 'candidate' WHEN score >= 60 AND sure >= 55 AND sources >= 2 THEN 'confirmed'
    WHEN score >= 35 AND sure >= 25 THEN CASE WHEN sources < 2 THEN 'candidate' ELSE 'active' END WHEN total < 60000 THEN 'weakening' ELSE 'candidate' END AS alone FROM e
), r AS (
    SELECT *, score AS peak, alone AS state FROM x WHERE k = 1
    UNION ALL SELECT x.*, greatest(r.peak, x.score), CASE WHEN r.state IN ('active', 'confirmed') AND x.first < r.last + 5270400000
        THEN CASE WHEN x.spike THEN 'invalidated' WHEN greatest(r.peak, x.score) - x.score >= 20 THEN 'weakening' ELSE x.alone END ELSE x.alone END
    FROM r JOIN x ON x.subject = r.subject AND x.k = r.k + 1
) {TOLD.format(stale=61 * 86_400_000, over='ended')}""")
def stream_trend_lifecycle(spark, sf_dir):
    """Customers followed as trends: a month of orders is an evaluation, two months of silence end them."""
    m, c = _months(spark, sf_dir), F.col
    spike, stage = (c("n") == 1) & (c("total") > 350_000), F.when(c("total") < 60_000, "declining").otherwise("emerging")
    e = m.select("subject", "at", "seen_first", "seen_last", c("score").alias("trend_score"), c("sure").alias("confidence"), c("sources").alias("independent_sources"), stage.alias("stage"), spike.alias("is_one_day_spike"), F.lit(False).alias("is_seasonal"))
    return _told(L.trend_lifecycle(e, 30 * L.DAY))


@query(f"""WITH RECURSIVE {MONTHS}, x AS (SELECT *, CASE WHEN total > 400000 THEN 'invalidated' WHEN score >= 70 AND sure >= 65 AND n < 4 THEN 'strong_evidence' WHEN score >= 55 AND sure >= 45 THEN 'promising'
    WHEN score >= 35 THEN 'watchlist' ELSE 'candidate' END AS alone FROM e
), r AS (
    SELECT *, score AS peak, alone AS state FROM x WHERE k = 1
    UNION ALL SELECT x.*, greatest(r.peak, x.score), CASE WHEN x.total <= 400000 AND r.state IN ('watchlist', 'promising', 'strong_evidence') AND x.first < r.last + 10454400000 AND greatest(r.peak, x.score) - x.score >= 18
        THEN 'weakening' ELSE x.alone END
    FROM r JOIN x ON x.subject = r.subject AND x.k = r.k + 1
) {TOLD.format(stale=121 * 86_400_000, over='archived')}""")
def stream_opportunity_lifecycle(spark, sf_dir):
    """The same months held to the rules of opportunities, which are archived after 120 days of silence."""
    m, c = _months(spark, sf_dir), F.col
    risk, doubt = F.when(c("n") >= 4, "very_high").otherwise("moderate"), F.when(c("total") > 400_000, "reject").otherwise("continue_research")
    e = m.select("subject", "at", "seen_first", "seen_last", c("score").alias("opportunity_score"), c("sure").alias("opportunity_confidence"), risk.alias("risk_level"), doubt.alias("skeptic_status"))
    return _told(L.opportunity_lifecycle(e, 30 * L.DAY))


#: Orders with an hour of their own, as what their customers hear of.
ORDERED = "o AS (SELECT *, o_orderdate + to_hours(o_orderkey % 24) AS ts FROM orders), mark AS (SELECT max(epoch_ms(ts)) - 3600000 AS now FROM o)"


def _ordered(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int")))


@query(f"""WITH {ORDERED}, f AS (SELECT o_custkey AS user_id, CASE o_custkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'never' END AS frequency, list_value{AQ.ZONES}[o_custkey % 4 + 1] AS zone, ts FROM o
), d AS (SELECT *, CAST(timezone(zone, timezone('UTC', ts)) AS DATE) AS today FROM f WHERE frequency <> 'never'), s AS (SELECT user_id, frequency, zone, CASE frequency WHEN 'daily' THEN today ELSE CAST(date_trunc('week', today) AS DATE) END AS first, CASE frequency WHEN 'daily' THEN 1 ELSE 7 END AS days FROM d
), p AS (SELECT user_id, {AQ.PERIOD}, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, key, strftime(start, '%Y-%m-%d %H:%M') AS start, strftime(stop, '%Y-%m-%d %H:%M') AS stop, n FROM p WHERE epoch_ms(stop) < (SELECT now FROM mark)""")
def stream_digest_periods(spark, sf_dir):
    """Orders in every local day or week of their customers, over years of four zones, told by timers."""
    k = F.col("o_custkey")
    how = F.get(F.array(*map(F.lit, ("daily", "weekly", "never"))), (k % 3).cast("int"))
    p = T.drained(N.local_periods(_ordered(spark, sf_dir).select(k.alias("user_id"), "ts", how.alias("frequency"), AQ._zone(k).alias("zone"))))
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    return p.select(F.col("user_id").cast("bigint").alias("user_id"), "key", shown("start").alias("start"), shown("end").alias("stop"), "n")


@query(f"""WITH {ORDERED}, h AS (SELECT o_custkey AS subject, ts AS t, round(o_totalprice / 5000, 1) AS score, (o_orderkey * 7 % 100)::DOUBLE AS confidence, list_value('low', 'moderate', 'high', 'very_high')[o_orderkey % 4 + 1] AS risk, o_orderstatus AS state
    FROM o WHERE (epoch_ms(ts) // 3600000 + 1) * 3600000 <= (SELECT now FROM mark)
), r AS (SELECT subject, t, score - lag(score) OVER w AS ds, confidence - lag(confidence) OVER w AS dc, list_position(['low', 'moderate', 'high', 'very_high'], risk) - lag(list_position(['low', 'moderate', 'high', 'very_high'], risk)) OVER w AS dr,
    state <> lag(state) OVER w AS moved FROM h WINDOW w AS (PARTITION BY subject ORDER BY t, score, confidence, risk, state)
), e AS (SELECT subject, t, 'score_increased' AS kind, ds AS m FROM r WHERE ds >= 5 UNION ALL SELECT subject, t, 'score_decreased', -ds FROM r WHERE ds <= -5 UNION ALL SELECT subject, t, 'confidence_increased', dc FROM r WHERE dc >= 8
    UNION ALL SELECT subject, t, 'confidence_decreased', -dc FROM r WHERE dc <= -8 UNION ALL SELECT subject, t, 'risk_increased', dr FROM r WHERE dr > 0 UNION ALL SELECT subject, t, 'risk_decreased', -dr FROM r WHERE dr < 0 UNION ALL SELECT subject, t, 'state_changed', 0 FROM r WHERE moved)
SELECT subject, strftime(t, '%Y-%m-%d %H:%M') AS minute, kind, round(m, 4)::DOUBLE AS magnitude FROM e""")
def stream_change_events(spark, sf_dir):
    """Orders of a customer as successive evaluations: changes of score, confidence, risk and state."""
    k = F.col("o_orderkey")
    level = F.get(F.array(*map(F.lit, ("low", "moderate", "high", "very_high"))), (k % 4).cast("int"))
    h = _ordered(spark, sf_dir).select(F.col("o_custkey").alias("subject"), F.col("ts").alias("at"), F.round(F.col("o_totalprice") / 5000, 1).alias("score"), (k * 7 % 100).cast("double").alias("confidence"), level.alias("risk_level"), F.col("o_orderstatus").alias("state"))
    return T.drained(N.changes(h)).select(F.col("subject").cast("bigint").alias("subject"), F.date_format("at", "yyyy-MM-dd HH:mm").alias("minute"), "kind", F.round("magnitude", 4).alias("magnitude"))


@query(f"""WITH RECURSIVE {ORDERED}, runs AS (SELECT o_orderpriority AS rule_id, o_custkey AS user_id, (epoch_ms(ts) // 3600000 + 1) * 3600000 AS run, o_orderkey AS fact FROM o WHERE (epoch_ms(ts) // 3600000 + 1) * 3600000 <= (SELECT now FROM mark)
), fired AS (SELECT rule_id, user_id, min(run) AS run FROM runs GROUP BY ALL UNION ALL SELECT x.rule_id, x.user_id, min(x.run) FROM fired f JOIN runs x ON x.rule_id = f.rule_id AND x.user_id = f.user_id AND x.run > f.run AND x.run - 1 >= f.run - 1 + 90 * 86400000::BIGINT GROUP BY ALL)
SELECT rule_id, user_id, CAST(fact AS VARCHAR) AS fact, run FROM fired JOIN runs USING (rule_id, user_id, run)""")
def stream_alerts(spark, sf_dir):
    """A rule for each priority and customer, quiet for 90 days behind what it tells; every order comes twice."""
    o = _ordered(spark, sf_dir).select(F.col("o_orderpriority").alias("rule_id"), F.col("o_custkey").alias("user_id"), "ts", F.col("o_orderkey").alias("fact"), F.lit(24 * 90).alias("cooldown_hours"))
    told = T.drained(N.told_once(o.unionByName(o)))
    return told.select("rule_id", F.col("user_id").cast("bigint").alias("user_id"), "fact", (F.unix_millis("at") + 1).alias("run"))
