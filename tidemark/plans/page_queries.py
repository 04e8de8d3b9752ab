"""Pages of trends, signals and entities under the conditions that a reader sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import listings as L
from ..sources import bindings as B
from ..sources import connectors as K
from ..sources.places import kept
from . import trend_queries as TQ
from .series_queries import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col

#: Listings by name: order, conditions, and the same as SQL.
TRENDS = {
    "score": ({"spikes": False, "seasonal": False, "limit": 7, "offset": 2}, "NOT is_one_day_spike AND NOT is_seasonal", "trend_score DESC, confidence DESC", 2, 7),
    "confidence": ({"least_score": 20.0, "geo_scope": "country", "limit": 20}, "trend_score >= 20 AND geo_scope = 'country'", "confidence DESC, trend_score DESC", 0, 20),
    "newest": ({"subject_type": "topic", "least_confidence": 10.0}, "subject_type = 'topic' AND confidence >= 10", "first_detected_at DESC", 0, 50),
    "updated": ({"stage": "weak_signal", "state": "candidate", "limit": 5, "offset": 1}, "stage = 'weak_signal' AND state = 'candidate'", "last_evaluated_at DESC", 1, 5),
    "acceleration": ({"subject_type": "entity", "limit": 30, "analysis_mode": "live_only"}, "subject_type = 'entity' AND analysis_mode = 'live_only'", "acceleration_pp DESC NULLS LAST", 0, 30),
}


def trend_listings(spark, sf_dir):
    """A page in each order over the trends of nations and topics, which are evaluated once."""
    as_of, topic = F.lit(B.AS_OF).cast("date"), c("subject").startswith("topic/")
    rows = TQ.levels(spark, sf_dir).withColumns({
        "subject_type": F.when(topic, "topic").otherwise("entity"), "geo_scope": F.when(topic, "global").otherwise("country"), "analysis_mode": F.when(F.length("subject") % 2 == 0, "live_only").otherwise("demo_inclusive"),
        "first_detected_at": F.date_sub(as_of, c("history_days").cast("int")), "last_evaluated_at": F.date_sub(as_of, c("days_since_last").cast("int")),
    })
    stored = kept(rows.select("subject", "subject_type", "geo_scope", "analysis_mode", "stage", "state", "is_one_day_spike", "is_seasonal", "trend_score", "confidence", "acceleration_pp", "first_detected_at", "last_evaluated_at"), "trends")
    pages = [L.trend_listing(stored, order, **asked).withColumn("listing", F.lit(order)) for order, (asked, *_) in TRENDS.items()]
    return rounded(reduce(lambda a, b: a.unionByName(b), pages), "listing", "place", "subject", "trend_score", "confidence", "acceleration_pp", "total")


_PAGES = " UNION ALL ".join(
    f"(SELECT '{order}' AS listing, row_number() OVER (ORDER BY {by}, subject) AS place, subject, trend_score, confidence, acceleration_pp, (SELECT count(*) FROM kept WHERE {where}) AS total FROM kept WHERE {where} QUALIFY place BETWEEN {offset + 1} AND {offset + limit})"
    for order, (_, where, by, offset, limit) in TRENDS.items()
)
QUERIES["trend_listings"] = trend_listings
ORACLE["trend_listings"] = f"""{TQ.LEVELS}, kept AS (SELECT *, CASE WHEN subject LIKE 'topic/%' THEN 'topic' ELSE 'entity' END AS subject_type, CASE WHEN subject LIKE 'topic/%' THEN 'global' ELSE 'country' END AS geo_scope,
    CASE WHEN length(subject) % 2 = 0 THEN 'live_only' ELSE 'demo_inclusive' END AS analysis_mode, DATE '2001-08-01' - history_days::INT AS first_detected_at, DATE '2001-08-01' - days_since_last::INT AS last_evaluated_at FROM trends)
    SELECT listing, place, subject, round(trend_score, 4)::DOUBLE AS trend_score, round(confidence, 4)::DOUBLE AS confidence, round(acceleration_pp, 4)::DOUBLE AS acceleration_pp, total FROM ({_PAGES})"""


def signal_page(spark, sf_dir):
    """Deliveries as signals of the part they are of, their suppliers as sources: those of one type and class."""
    lines, parts, makers = (B.table(spark, sf_dir, name) for name in ("lineitem", "part", "supplier"))
    signals = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("signal_id"), c("l_partkey").alias("entity_id"), c("l_suppkey").alias("source_id"), c("l_returnflag").alias("signal_type"), c("l_linestatus").alias("signal_class"),
        F.when(c("l_quantity") > 25, "global").otherwise("country").alias("geo_scope"),
    )
    found = L.signal_listing(signals, parts.select(c("p_partkey").alias("entity_id"), c("p_name").alias("canonical_name")), makers.select(c("s_suppkey").alias("source_id"), c("s_name").alias("slug")), 40, 15, signal_type="R", signal_class="F", geo_scope="global", source_id=None)
    return found.select("place", "signal_id", "entity_name", "source_slug", "total")


QUERIES["signal_page"] = signal_page
ORACLE["signal_page"] = """WITH found AS (SELECT l_orderkey || '-' || l_linenumber AS signal_id, p_name AS entity_name, s_name AS source_slug FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 25)
SELECT row_number() OVER (ORDER BY entity_name, signal_id) AS place, signal_id, entity_name, source_slug, (SELECT count(*) FROM found) AS total FROM found QUALIFY place BETWEEN 16 AND 55"""


def entity_page(spark, sf_dir):
    """Customers whose normalised name holds a text, of one segment."""
    rows = B.table(spark, sf_dir, "customer").select(c("c_custkey").alias("entity_id"), c("c_name").alias("canonical_name"), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]+", " ")).alias("normalized"), c("c_mktsegment").alias("entity_type"))
    return L.entity_listing(rows, "ER 00", "BUILDING", limit=25, offset=3).select("place", "entity_id", "canonical_name", "total")


QUERIES["entity_page"] = entity_page
ORACLE["entity_page"] = """WITH found AS (SELECT c_custkey AS entity_id, c_name AS canonical_name FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')), 'er 00'))
SELECT row_number() OVER (ORDER BY canonical_name, entity_id) AS place, entity_id, canonical_name, (SELECT count(*) FROM found) AS total FROM found QUALIFY place BETWEEN 4 AND 28"""


def run_accounts(spark, sf_dir):
    """Days of an event type as runs of a source; a user's second event of a day is a duplicate, values under 1 are rejected, and days of which most values are low found nothing."""
    e = B.table(spark, sf_dir, "events").select(c("event_type").alias("source_id"), c("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "value").withColumn("run_id", F.concat_ws("/", "source_id", F.to_date("ts").cast("string")))
    runs = e.groupBy("run_id", "source_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), (F.count_if(c("value") < 20) * 2 > F.count("*")).alias("low"), F.count("*").alias("n"))
    runs = kept(runs.select("run_id", "source_id", "started_at", "finished_at", F.when(c("low"), "nothing there").alias("error"), (c("n") > 12).alias("is_capped")), "runs")
    first = e.groupBy("run_id", "user_id").agg(F.min("event_id").alias("first"))
    found = e.join(runs.filter("error is null").select("run_id"), "run_id", "left_semi").join(first, ["run_id", "user_id"])
    records = found.select("run_id", F.when(c("value") < 1, "too small").alias("reason"), (c("event_id") > c("first")).alias("is_duplicate"), F.when(c("value") >= 5, c("value")).alias("metric_value"), F.lit("ok").alias("status"))
    return K.run_accounts(runs, records).select("run_id", "fetched", "rejected", "duplicate", "stored", "observations", "duration_ms", "run_status", "failures", "source_status")


QUERIES["run_accounts"] = run_accounts
ORACLE["run_accounts"] = """WITH e AS (SELECT event_type AS source_id, event_type || '/' || CAST(ts::DATE AS VARCHAR) AS run_id, * FROM events
), runs AS (SELECT run_id, source_id, min(ts) AS started, max(ts) AS ended, count(*) FILTER (value < 20) * 2 > count(*) AS low, count(*) > 12 AS capped FROM e GROUP BY ALL
), marked AS (SELECT *, row_number() OVER (PARTITION BY run_id, user_id ORDER BY event_id) > 1 AS again, coalesce(value < 1, false) AS bad FROM e
), sums AS (SELECT run_id, count(*) AS fetched, count(*) FILTER (bad) AS rejected, count(*) FILTER (NOT bad AND again) AS duplicate, count(*) FILTER (NOT bad AND NOT again) AS stored, count(*) FILTER (NOT bad AND NOT again AND value >= 5) AS observations
    FROM marked JOIN runs USING (run_id) WHERE NOT low GROUP BY run_id
), a AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started, run_id) AS i FROM runs LEFT JOIN sums USING (run_id)
), b AS (SELECT *, i - coalesce((SELECT max(x.i) FROM a x WHERE x.source_id = a.source_id AND x.i <= a.i AND NOT x.low), 0) AS failures FROM a)
SELECT run_id, coalesce(fetched, 0) AS fetched, coalesce(rejected, 0) AS rejected, coalesce(duplicate, 0) AS duplicate, coalesce(stored, 0) AS stored, coalesce(observations, 0) AS observations, (epoch_us(ended) - epoch_us(started)) // 1000 AS duration_ms,
    CASE WHEN low THEN 'failed' WHEN capped THEN 'partial' ELSE 'succeeded' END AS run_status, failures, CASE WHEN failures >= 5 THEN 'error' ELSE 'active' END AS source_status FROM b"""
