"""Queries over alerts, digests and monitoring: customers as users with a rule each, nations as subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import monitoring as M
from ..sources import bindings as B
from . import market_queries as MQ
from .series_queries import ORDERS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col
NOW = "2001-08-01 00:00:00"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _nations(spark, sf_dir):
    n = c("n_nationkey")
    kind = F.when(n % 2 == 0, "business").otherwise("import_distribution")
    return B.table(spark, sf_dir, "nation").select(c("n_name").alias("subject"), n, kind.alias("opportunity_type"), F.concat(F.lit("N"), n.cast("string")).alias("country"))


def _events(spark, sf_dir):
    day = F.date_format("at", "yyyy-MM-dd")
    rows = MQ._changes(spark, sf_dir).join(_nations(spark, sf_dir), "subject")
    return rows.withColumn("event_id", F.concat_ws("/", "subject", day, "kind"))


def _rules(spark, sf_dir):
    k, none = c("c_custkey"), F.array().cast("array<string>")
    return B.table(spark, sf_dir, "customer").select(
        k.alias("rule_id"), k.alias("user_id"),
        F.get(F.array(*map(F.lit, ("score_threshold", "risk_change", "watchlist_change", "confidence_threshold"))), (k % 4).cast("int")).alias("trigger"),
        F.when(k % 50 != 0, F.concat(F.lit("n"), c("c_nationkey").cast("string"))).alias("country"),
        F.when(k % 3 == 0, 40.0).alias("min_score"), F.when(k % 5 == 1, 9.0).alias("min_magnitude"), F.when(k % 7 == 0, "business").alias("type"),
        F.when(k % 5 == 0, k % 10).alias("watchlist_id"), F.when(k % 8 == 0, 50.0).alias("min_relevance"),
        F.when(k % 3 == 1, F.array(F.lit("email"))).when(k % 3 == 2, F.array(F.lit("email"), F.lit("telegram"))).otherwise(none).alias("channels"),
        F.when(k % 6 == 0, F.lit("2001-07-31 20:00:00").cast("timestamp")).alias("last_fired_at"), (k % 3 * 4).cast("int").alias("cooldown_hours"), (k % 11 != 0).alias("enabled"),
    )


def _links(spark, sf_dir):
    k = c("c_custkey")
    rows = B.table(spark, sf_dir, "customer")
    link = lambda channel, address, verified, days: rows.select(k.alias("user_id"), F.lit(channel).alias("channel"), address.alias("address"), verified.alias("verified"), F.date_add(F.lit("2001-01-01").cast("date"), days.cast("int")).alias("verified_at"))
    email = link("email", F.concat(F.lit("u"), k, F.lit("@mail")), k % 2 == 0, k % 10)
    return email.union(link("telegram", F.concat(F.lit("t"), k), k % 4 == 0, k % 10)).union(link("telegram", F.concat(F.lit("s"), k), k % 4 < 2, k % 7))


def _matched(spark, sf_dir, match=A.matched):
    watched = _nations(spark, sf_dir).select((c("n_nationkey") % 10).cast("bigint").alias("watchlist_id"), "subject")
    pairs = match(_events(spark, sf_dir), _rules(spark, sf_dir), F.lit(NOW).cast("timestamp"), watched)
    known = B.table(spark, sf_dir, "customer").join(_nations(spark, sf_dir), c("c_nationkey") == c("n_nationkey")).filter(c("c_custkey") % 16 != 0)
    return A.personal(pairs, known.select(c("c_custkey").alias("user_id"), "subject", (c("c_custkey") * 31 % 100).alias("relevance")))


MATCHED = f"""{MQ.HISTORY}, ev AS (
    SELECT subject || '/' || strftime(tick, '%Y-%m-%d') || '/' || kind AS event_id, subject, kind, magnitude, score, n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN 'business' ELSE 'import_distribution' END AS sort
    FROM changes JOIN nation ON n_name = subject
), rules AS (SELECT c_custkey AS k, c_nationkey AS home, list_value('score', 'risk', '', 'confidence')[c_custkey % 4 + 1] AS stem FROM customer WHERE c_custkey % 11 <> 0
), pairs AS (
    SELECT k, event_id, subject, kind, CASE WHEN k % 6 = 0 AND (k % 3) * 4 > 4 THEN 'cooldown' WHEN k % 5 = 0 AND k % 10 <> n % 10 THEN 'not_watched' WHEN k % 3 = 0 AND score < 40 THEN 'score'
        WHEN k % 5 = 1 AND abs(magnitude) < 9 THEN 'magnitude' WHEN k % 7 = 0 AND sort <> 'business' THEN 'type'
        WHEN k % 8 = 0 AND (k % 16 = 0 OR n <> home) THEN 'relevance_unknown' WHEN k % 8 = 0 AND k * 31 % 100 < 50 THEN 'relevance' END AS why_not
    FROM rules JOIN ev ON (k % 50 = 0 OR n = home) AND starts_with(kind, CASE WHEN stem = '' THEN '' ELSE stem || '_' END)
)"""


@query(f"WITH {MATCHED} SELECT k AS rule_id, event_id, why_not FROM pairs")
def alert_reasons(spark, sf_dir):
    return _matched(spark, sf_dir).select("rule_id", "event_id", "why_not")


@query(f"""WITH {MATCHED}, wide AS (SELECT *, unnest(list_value(['in_app'], ['in_app', 'email'], ['in_app', 'email', 'telegram'])[k % 3 + 1]) AS channel FROM pairs WHERE why_not IS NULL
), addressed AS (SELECT *, unnest(CASE channel WHEN 'in_app' THEN [CAST(k AS VARCHAR)] WHEN 'email' THEN CASE WHEN k % 2 = 0 THEN ['u' || k || '@mail'] ELSE [] END
        ELSE CASE WHEN k % 4 = 0 THEN ['t' || k, 's' || k] WHEN k % 4 = 1 THEN ['s' || k] ELSE [] END END) AS address FROM wide)
SELECT k AS rule_id, k AS user_id, event_id, channel, address, left(sha256(k || '|' || subject || '|' || kind || '|' || event_id), 48) || ':' || channel AS dedupe_key FROM addressed""")
def alert_fan_out(spark, sf_dir):
    return A.fan_out(_matched(spark, sf_dir, A.passing), _links(spark, sf_dir)).select("rule_id", "user_id", "event_id", "channel", "address", "dedupe_key")


ZONES = ("UTC", "America/New_York", "Asia/Kolkata", "Europe/Berlin")


def _zone(key):
    return F.get(F.array(*map(F.lit, ZONES)), (key % 4).cast("int"))


def _period_sql(now: str, frequency: str, zone: str) -> str:
    """key, start, end of a period; `now` is a timestamp without zone in UTC."""
    today = f"CAST(timezone({zone}, timezone('UTC', {now})) AS DATE)"
    first = f"CASE {frequency} WHEN 'daily' THEN {today} - 1 WHEN 'weekly' THEN CAST(date_trunc('week', {today}) AS DATE) - 7 END"
    return f"{first} AS first, CASE {frequency} WHEN 'daily' THEN 1 ELSE 7 END AS days, {zone} AS zone, {frequency} AS frequency"


PERIOD = """CASE frequency WHEN 'daily' THEN 'daily:' || first WHEN 'weekly' THEN 'weekly:' || isoyear(first) || '-W' || lpad(CAST(week(first) AS VARCHAR), 2, '0') END AS key,
    timezone('UTC', timezone(zone, CAST(first AS TIMESTAMP))) AS start, timezone('UTC', timezone(zone, CAST(first + days AS TIMESTAMP))) AS stop"""


@query(f"""WITH o AS (SELECT o_orderkey, {_period_sql("o_orderdate + to_hours(o_orderkey % 24)", "list_value('daily', 'weekly', 'never')[o_orderkey % 3 + 1]", f"list_value{ZONES}[o_custkey % 4 + 1]")} FROM orders)
SELECT o_orderkey, key, strftime(start, '%Y-%m-%d %H:%M') AS start, strftime(stop, '%Y-%m-%d %H:%M') AS stop FROM (SELECT o_orderkey, {PERIOD} FROM o WHERE frequency <> 'never')""")
def digest_periods(spark, sf_dir):
    """The last completed period before each order, in the zone of its customer."""
    now = c("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(c("o_orderkey") % 24).cast("int"))
    how = F.get(F.array(F.lit("daily"), F.lit("weekly"), F.lit("never")), (c("o_orderkey") % 3).cast("int"))
    rows = B.table(spark, sf_dir, "orders").select("o_orderkey", A.period(now, how, _zone(c("o_custkey"))).alias("p")).filter("p is not null")
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    return rows.select("o_orderkey", "p.key", shown("p.start").alias("start"), shown("p.end").alias("stop"))


def _digests(spark, sf_dir):
    k = c("c_custkey")
    customers = B.table(spark, sf_dir, "customer").join(_nations(spark, sf_dir), c("c_nationkey") == c("n_nationkey"))
    how = F.when(k % 2 == 0, "daily").otherwise("weekly")
    users = customers.select(k.alias("user_id"), how.alias("frequency"), A.period(F.lit("2001-07-20 03:00:00").cast("timestamp"), how, _zone(k)).alias("p")).select("user_id", "frequency", "p.*")
    orders = B.table(spark, sf_dir, "orders").join(customers.select(k, "subject"), c("o_custkey") == k)
    at = c("o_orderdate").cast("timestamp")
    told = orders.select(c("o_custkey").alias("user_id"), at.alias("at"), F.when(c("o_orderkey") % 5 == 0, "email").otherwise("in_app").alias("channel"), c("o_orderkey").alias("dedupe_key"))
    events = orders.select(c("o_orderkey").alias("event_id"), at.alias("at"), "subject")
    mine = customers.select(k.alias("user_id"), "subject")
    found = A.digests(users.drop("frequency"), told, events, mine)
    return found.join(users.select("user_id", "frequency"), "user_id")


DIGESTS = f"""u AS (SELECT c_custkey AS k, n_name AS home, {_period_sql("TIMESTAMP '2001-07-20 03:00:00'", "CASE WHEN c_custkey % 2 = 0 THEN 'daily' ELSE 'weekly' END", f"list_value{ZONES}[c_custkey % 4 + 1]")} FROM customer JOIN nation ON n_nationkey = c_nationkey
), p AS (SELECT k, home, frequency, {PERIOD} FROM u), ev AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS moment, n_name AS subject FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
), shown AS (SELECT key, start, subject FROM (SELECT DISTINCT key, start, stop FROM p) JOIN ev ON moment >= start AND moment < stop QUALIFY row_number() OVER (PARTITION BY key, start ORDER BY moment DESC, id) <= 50
), alerts AS (SELECT k, least(100, count(*)) AS alerts FROM p JOIN ev ON o_custkey = k AND moment >= start AND moment < stop AND id % 5 <> 0 GROUP BY k
), digests AS (SELECT k, key, frequency, coalesce(max(alerts), 0) AS alerts, count(*) FILTER (subject = home) AS watched, count(*) FILTER (subject <> home) AS other
    FROM p LEFT JOIN shown USING (key, start) LEFT JOIN alerts USING (k) GROUP BY k, key, frequency)"""


@query(f"WITH {DIGESTS} SELECT k AS user_id, key, alerts, watched, other, alerts + watched + other = 0 AS is_empty FROM digests")
def digests(spark, sf_dir):
    return _digests(spark, sf_dir).drop("frequency")


@query(f"""WITH {DIGESTS} SELECT k AS user_id, key, 'telegram' AS channel, CASE WHEN k % 4 = 1 THEN 's' || k WHEN k % 10 < k % 7 OR k % 10 = k % 7 AND false THEN 't' || k ELSE 's' || k END AS address
FROM digests WHERE k % 4 < 2 AND k % 13 <> 0 AND k % 6 <> 0 AND k % 9 <> 0""")
def digest_deliveries(spark, sf_dir):
    """Digests by telegram to those who want them and haven't had them, on the oldest proved link."""
    k = c("c_custkey")
    how = F.when(k % 6 == 0, "none").when(k % 2 == 0, "daily").otherwise("weekly")
    users = B.table(spark, sf_dir, "customer").select(k.alias("user_id"), how.alias("digest_frequency"), (k % 13 != 0).alias("is_active"))
    found = _digests(spark, sf_dir)
    sent = found.filter("user_id % 9 = 0").select("user_id", "key", F.lit("telegram").alias("channel"))
    return A.digest_deliveries(found, users, _links(spark, sf_dir), "telegram", sent)


CHECKS = f"""{ORDERS}, cond AS (SELECT 'orders:' || n_name AS series, n_nationkey AS condition_id, list_value('gt', 'gte', 'lt', 'lte')[n_nationkey % 4 + 1] AS op FROM nation
), runs AS (SELECT unnest([TIMESTAMP '1999-08-01', TIMESTAMP '2000-02-01', TIMESTAMP '2000-08-01', TIMESTAMP '2001-02-01', TIMESTAMP '2001-08-01']) AS moment
), r AS (SELECT condition_id, moment, tick, CASE op WHEN 'gt' THEN value > 8 WHEN 'gte' THEN value >= 8 WHEN 'lt' THEN value < 8 ELSE value <= 8 END AS ok FROM cond CROSS JOIN runs JOIN orders_obs USING (series) WHERE tick >= moment - INTERVAL '365 days' AND tick < moment
), checks AS (SELECT condition_id, moment, CASE WHEN arg_max(ok, tick) THEN CASE WHEN count(*) FILTER (ok) / count(*) >= 0.6 THEN 'met' ELSE 'partially_met' END WHEN count(*) FILTER (ok) > 0 THEN 'partially_met' ELSE 'failed' END AS state FROM r GROUP BY ALL)"""


@query(f"""WITH {CHECKS}, every AS (SELECT condition_id, moment, coalesce(state, 'unknown') AS state FROM cond CROSS JOIN runs LEFT JOIN checks USING (condition_id, moment))
SELECT condition_id, strftime(moment, '%Y-%m-%d') AS day, state, lag(state) OVER w AS previous, state = 'met' AND coalesce(lag(state) OVER w, 'unknown') <> 'met' AS newly_met,
    state = 'failed' AND coalesce(lag(state) OVER w, 'unknown') <> 'failed' AS newly_failed FROM every WINDOW w AS (PARTITION BY condition_id ORDER BY moment)""")
def check_history(spark, sf_dir):
    """Conditions on orders at five runs, with the state of the run before."""
    pick = F.get(F.array(*map(F.lit, ("gt", "gte", "lt", "lte"))), (c("n_nationkey") % 4).cast("int"))
    conditions = B.table(spark, sf_dir, "nation").select(c("n_nationkey").alias("condition_id"), F.concat(F.lit("orders:"), "n_name").alias("series"), pick.alias("comparator"), F.lit(8.0).alias("threshold"), F.lit(365).alias("window_days"))
    readings, runs = B.series(spark, sf_dir, "orders"), None
    for at in ("1999-08-01", "2000-02-01", "2000-08-01", "2001-02-01", "2001-08-01"):
        then = M.check_conditions(conditions, readings.filter(c("at") < F.lit(at).cast("timestamp")), at).select("condition_id", F.lit(at).alias("at"), "state")
        runs = then if runs is None else runs.union(then)
    return A.with_previous(runs).select("condition_id", c("at").alias("day"), "state", "previous", "newly_met", "newly_failed")


LIVE = f"{MQ.HISTORY}, live AS (SELECT subject, arg_max(score, tick) AS now, arg_max(state, tick) AS phase FROM history GROUP BY subject), top AS (SELECT subject FROM live WHERE phase = 'active' ORDER BY now DESC, subject LIMIT 10)"


@query(f"WITH {LIVE} SELECT subject, strftime(tick, '%Y-%m-%d') AS day, kind, magnitude::DOUBLE AS magnitude FROM changes JOIN top USING (subject)")
def monitor_top(spark, sf_dir):
    """Changes of the ten live subjects of the highest score."""
    h = MQ._history(spark, sf_dir)
    last = h.groupBy("subject").agg(F.max_by(F.struct("score", "state"), "at").alias("l")).select("subject", "l.*")
    top = last.filter("state = 'active'").orderBy(F.desc("score"), "subject").limit(10).select("subject")
    return M.change_events(h.join(F.broadcast(top), "subject")).select("subject", F.date_format("at", "yyyy-MM-dd").alias("day"), "kind", "magnitude")  # ten rows


@query(f"""WITH {MQ.HISTORY} SELECT subject, strftime(tick, '%Y-%m-%d') AS day, kind, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY tick DESC, kind) AS place FROM changes WHERE tick >= TIMESTAMP '2000-06-01') WHERE place <= 5""")
def recent_events(spark, sf_dir):
    """The five newest changes of each subject since a time."""
    rows = _events(spark, sf_dir).filter(c("at") >= F.lit("2000-06-01").cast("timestamp"))
    return A.latest(rows, ["subject"], "at", ["kind"], 5).select("subject", F.date_format("at", "yyyy-MM-dd").alias("day"), "kind", "place")
