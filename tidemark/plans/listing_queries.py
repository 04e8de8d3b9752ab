"""Queries that list, page and count: parts as opportunities, brands as their trends, orders as evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listings as L
from ..operators import trends as T
from ..sources import bindings as B
from .series_queries import ORDERS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _opportunities(spark, sf_dir):
    p, size = c("p_partkey"), c("p_size")
    level = F.get(F.array(*map(F.lit, ("low", "moderate", "high", "very_high", "odd"))), size % 5)
    parts = B.table(spark, sf_dir, "part").select(
        p.alias("key"), c("p_type").alias("opportunity_type"), c("p_brand").alias("trend"), level.alias("risk_level"), L.risk_rank(level).alias("risk_rank"),
        (size * 2).alias("confidence"), F.round(c("p_retailprice") / 25, 2).alias("opportunity_score"), F.when(size % 3 != 0, size * 1000).alias("capital_required"),
        F.date_add(F.lit("2001-01-01").cast("date"), (p % 200).cast("int")).cast("timestamp").alias("detected_at"), (p % 9 == 0).alias("is_demo"),
    )
    trends = B.table(spark, sf_dir, "part").groupBy(c("p_brand").alias("trend")).agg(F.round(F.avg("p_size") + 1e-9, 3).alias("trend_score")).filter("trend_score > 25")
    return parts.join(trends, "trend", "left")


OPPORTUNITIES = """opps AS (
    SELECT p_partkey AS key, p_type AS opportunity_type, list_value('low', 'moderate', 'high', 'very_high', 'odd')[p_size % 5 + 1] AS risk_level, p_size % 5 AS risk_rank, p_size * 2 AS confidence,
        round(p_retailprice / 25, 2) AS opportunity_score, CASE WHEN p_size % 3 <> 0 THEN p_size * 1000 END AS capital_required, TIMESTAMP '2001-01-01' + to_days(CAST(p_partkey % 200 AS INT)) AS detected_at, p_partkey % 9 = 0 AS is_demo, trend_score
    FROM part LEFT JOIN (SELECT p_brand, round(avg(p_size) + 1e-9, 3) AS trend_score FROM part GROUP BY p_brand HAVING round(avg(p_size) + 1e-9, 3) > 25) t USING (p_brand))"""


def _page(order: str, sql_order: str):
    """A page in one of the orders, of live opportunities of some confidence found since a day."""

    def run(spark, sf_dir):
        rows = L.narrowed(_opportunities(spark, sf_dir), least={"confidence": 20}, after={"detected_at": "2001-02-01"}, hide=("is_demo",))
        return L.page(rows, order, "key", limit=20, offset=10).select("key", "place", "opportunity_score", "trend_score", "total")

    QUERIES[f"opportunity_page_{order}"] = run
    ORACLE[f"opportunity_page_{order}"] = f"""WITH {OPPORTUNITIES}, found AS (SELECT * FROM opps WHERE confidence >= 20 AND detected_at > TIMESTAMP '2001-02-01' AND NOT is_demo)
        SELECT key, row_number() OVER (ORDER BY {sql_order} NULLS LAST, key) AS place, opportunity_score, trend_score, (SELECT count(*) FROM found) AS total FROM found QUALIFY place BETWEEN 11 AND 30"""


_page("score", "opportunity_score DESC")
_page("confidence", "confidence DESC")
_page("risk", "risk_rank ASC")
_page("capital", "capital_required ASC")
_page("newest", "detected_at DESC")
_page("trend", "trend_score DESC")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice >= 100000 AND o_orderdate > TIMESTAMP '1999-01-01'")
def record_listing(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").withColumn("at", c("o_orderdate").cast("timestamp"))
    found = L.narrowed(rows, equal={"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}, least={"o_totalprice": 100_000}, after={"at": "1999-01-01"})
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


@query("""WITH newest AS (SELECT o_custkey AS subject, o_orderdate AS moment, 'record' AS what, o_orderkey AS ref FROM orders WHERE o_orderpriority <> '1-URGENT' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 15)
SELECT subject, strftime(moment, '%Y-%m-%d') AS day, what, ref FROM (SELECT * FROM newest UNION ALL SELECT o_custkey, o_orderdate, 'evaluated', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, min(o_orderdate), 'detected', min(o_orderkey) FROM orders GROUP BY o_custkey)""")
def evidence_timeline(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select(c("o_custkey").alias("subject"), c("o_orderdate").cast("timestamp").alias("at"), c("o_orderkey").alias("ref"), "o_orderpriority")
    urgent = c("o_orderpriority") == "1-URGENT"
    found = L.timeline(rows.groupBy("subject").agg(F.min("at").alias("at"), F.min("ref").alias("ref")), rows.filter(urgent), rows.filter(~urgent))
    return found.select("subject", F.date_format("at", "yyyy-MM-dd").alias("day"), "what", "ref")


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 2 THEN 'unseen' WHEN c_acctbal <= 0 THEN 'rejected' WHEN c_custkey % 2 = 0 THEN 'updated' ELSE 'created' END AS outcome FROM customer WHERE c_custkey % 3 <> 2 OR c_custkey % 2 = 0""")
def run_outcomes(spark, sf_dir):
    k = B.table(spark, sf_dir, "customer").select(c("c_custkey").alias("key"), (c("c_acctbal") > 0).alias("accepted"))
    return L.outcomes(k.filter("key % 3 != 2"), k.filter("key % 2 = 0"))


@query("""WITH s AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal) FILTER (c_custkey % 4 <> 0) / 50 + 1e-9, 1) AS mean, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT n_nationkey AS k, n_name, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey - 12 END AS growth FROM nation)
SELECT n_name AS subject, CASE WHEN growth IS NULL THEN 'unknown' WHEN growth > 5 THEN 'rising' WHEN growth < -5 THEN 'falling' ELSE 'flat' END AS direction,
    coalesce(string_agg(c_mktsegment || '=' || CAST(mean AS DECIMAL(10, 1)), '|' ORDER BY c_mktsegment) FILTER (mean IS NOT NULL), '') AS by_class, coalesce(sum(n), 0)::BIGINT AS signals FROM r LEFT JOIN s ON c_nationkey = k GROUP BY ALL""")
def rejection_briefs(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation").select("n_nationkey", c("n_name").alias("subject"), F.array(F.lit("score")).alias("reasons"), F.when(c("n_nationkey") % 5 != 0, (c("n_nationkey") - 12).cast("double")).alias("growth"))
    signals = B.table(spark, sf_dir, "customer").join(n, c("c_nationkey") == c("n_nationkey")).select("subject", c("c_mktsegment").alias("signal_class"), F.when(c("c_custkey") % 4 != 0, c("c_acctbal") / 50).alias("growth_30d"))
    found = L.rejection_briefs(n, signals)
    shown = F.array_join(F.transform(F.map_entries("by_class"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("decimal(10,1)").cast("string"))), "|")
    return found.select("subject", "direction", F.coalesce(shown, F.lit("")).alias("by_class"), "signals")


@query("SELECT p_partkey AS key, CASE WHEN p_size / 50 <= p_retailprice / 3000 AND p_size / 50 <= (p_partkey % 100) / 80 THEN 'p_size' WHEN (p_partkey % 100) / 80 <= p_retailprice / 3000 THEN 'rest' ELSE 'worth' END AS weakest FROM part")
def weakest_component(spark, sf_dir):
    rows = B.table(spark, sf_dir, "part").select(c("p_partkey").alias("key"), "p_size", (c("p_partkey") % 100).alias("rest"), c("p_retailprice").alias("worth"))
    return rows.select("key", L.weakest({"p_size": 50, "rest": 80, "worth": 3000}).alias("weakest"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderstatus <> 'O' THEN 'confirmed' WHEN o_orderdate < DATE '2001-08-01' - 120 THEN 'archived' ELSE 'candidate' END AS state FROM orders""")
def archive_stale(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("key"), F.when(c("o_orderstatus") == "O", "candidate").otherwise("confirmed").alias("state"), c("o_orderdate").cast("date").alias("evaluated_at"))
    return L.archived(rows, F.lit(B.AS_OF).cast("date")).select("key", "state")


@query("""WITH m AS (SELECT l_orderkey, l_partkey, l_suppkey % 7 = 0 AS hit FROM lineitem), o AS (SELECT sum(CAST(hit AS INT)) AS h, count(*) AS n FROM m GROUP BY l_orderkey), p AS (SELECT sum(CAST(hit AS INT)) AS h, count(*) AS n FROM m GROUP BY l_partkey)
SELECT 'orders' AS name, sum(h)::BIGINT AS affected, count(*) FILTER (h > 0 AND h < n) AS mixed FROM o UNION ALL SELECT 'parts', sum(h)::BIGINT, count(*) FILTER (h > 0 AND h < n) FROM p""")
def lineage_impact(spark, sf_dir):
    lines, gone = B.table(spark, sf_dir, "lineitem"), B.table(spark, sf_dir, "supplier").filter("s_suppkey % 7 = 0").select(c("s_suppkey").alias("source"))
    owned = lambda key: lines.select(c("l_suppkey").alias("source"), c(key).alias("owner"))
    return L.lineage_impact({"orders": owned("l_orderkey"), "parts": owned("l_partkey")}, gone, "source")


@query("SELECT l_orderkey AS owner FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag <> 'N')")
def owners_only_from(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("owner"), (c("l_returnflag") != "N").alias("returned"))
    return L.only_from(rows, "owner", "returned")


COUNTED = ("customer", "orders", "lineitem", "part", "documents", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in COUNTED))
def table_counters(spark, sf_dir):
    return L.counters({t: B.table(spark, sf_dir, t) for t in COUNTED})


@query("SELECT c_custkey AS source_id, round(epoch(TIMESTAMP '2001-08-01' - max(o_orderdate)) / 3600 + 1e-9, 1) AS hours FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def source_freshness(spark, sf_dir):
    last = B.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(c("o_orderdate").cast("timestamp")).alias("last_success"))
    sources = B.table(spark, sf_dir, "customer").join(last, c("c_custkey") == c("o_custkey"), "left").select(c("c_custkey").alias("source_id"), "last_success")
    return L.freshness(sources, F.lit(B.AS_OF).cast("timestamp")).select("source_id", "hours")


@query("""SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'thin|stale' WHEN p_size % 5 = 0 THEN 'thin|proxy' ELSE 'thin' END WHEN p_size % 3 = 0 THEN 'stale|thin' WHEN p_size % 5 = 0 THEN 'proxy|thin' ELSE '' END AS warnings FROM part""")
def merged_warnings(spark, sf_dir):
    size = c("p_size")
    one = F.when(size % 2 == 0, F.array(F.lit("thin")))
    two = F.when(size % 3 == 0, F.array(F.lit("stale"), F.lit("thin"))).when(size % 5 == 0, F.array(F.lit("proxy"), F.lit("thin")))
    return B.table(spark, sf_dir, "part").select(c("p_partkey").alias("key"), F.array_join(L.warnings(one, two), "|").alias("warnings"))


@query("SELECT event_type, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS unset, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def config_values(spark, sf_dir):
    found = B.table(spark, sf_dir, "events").select("event_type", L.settings(c("props")).alias("s"))
    return found.groupBy("event_type").agg(F.count_if(c("s.k").isNull()).alias("unset"), F.sum("s.k").alias("total"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = l.l_partkey AND x.l_suppkey = l.l_suppkey AND x.l_returnflag = 'R')")
def dropped_support(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return L.dropped(lines.filter("l_returnflag = 'N'").select("l_partkey", "l_suppkey").distinct(), lines.filter("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


@query("(SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events) EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_except(spark, sf_dir):
    of = lambda name, key, test="true": B.table(spark, sf_dir, name).filter(test).select(c(key).alias("k"))
    return L.either_but(of("orders", "o_custkey"), of("events", "user_id"), of("customer", "c_custkey", "c_acctbal < 0"))


@query("SELECT c_nationkey AS subject, median(c_acctbal) AS growth FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_nationkey")
def median_growth(spark, sf_dir):
    rows = B.table(spark, sf_dir, "customer").select(c("c_nationkey").alias("subject"), (c("c_mktsegment") != "BUILDING").alias("is_adoption"), c("c_acctbal").alias("growth_30d"))
    return L.median_growth(rows)


@query("SELECT user_id AS series, count(*) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (value IS NOT NULL AND event_type <> 'error') >= 4")
def series_with_history(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select(c("user_id").alias("series"), "value", F.when(c("event_type") == "error", "missing").otherwise("ok").alias("status"))
    return L.with_history(rows).groupBy("series").agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE url IS NOT NULL AND regexp_extract(html, '(?i)<title[^>]*>([^<]+)<', 1) <> ''")
def documents_only(spark, sf_dir):
    title = F.nullif(F.regexp_extract("html", "(?i)<title[^>]*>([^<]+)<", 1), F.lit(""))
    return L.documents_only(B.table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"))).select("page_id")


@query(f"WITH {ORDERS} SELECT subject, strftime(tick, '%Y-%m-%d') AS day, max(value) OVER w AS peak, max(value) OVER w - value AS fall FROM orders_obs WINDOW w AS (PARTITION BY subject ORDER BY tick)")
def running_peak(spark, sf_dir):
    history = B.series(spark, sf_dir, "orders").select("subject", c("at").alias("evaluated_at"), c("value").alias("score"))
    return T.running_peak(history).select("subject", F.date_format("evaluated_at", "yyyy-MM-dd").alias("day"), "peak", c("drop").alias("fall"))
