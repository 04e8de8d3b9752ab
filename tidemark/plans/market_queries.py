"""Queries over entities, countries and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import geography as G
from ..operators import monitoring as M
from ..operators import series as S
from ..operators import upkeep as U
from ..operators.pairs import large
from ..sources import bindings as B
from ..sources.places import kept
from .series_queries import ALL, BUYERS, ORDERS, profile

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


NAMES = "ents AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name)"
SIM = """CASE WHEN a.n = b.n THEN 1 WHEN replace(a.n, ' ', '') = replace(b.n, ' ', '') THEN 0.95 WHEN len(list_intersect(a.w, b.w)) = len(a.w) AND len(a.w) = len(b.w) THEN 0.9
    ELSE round(greatest(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), CASE WHEN len(list_intersect(a.w, b.w)) = least(len(a.w), len(b.w)) THEN 0.6 ELSE 0 END), 4) END"""


def _names(spark, sf_dir):
    return B.table(spark, sf_dir, "part").groupBy(c("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("entity_type", F.lit("product"))


@query(f"""WITH {NAMES}, e AS (SELECT id, lower(name) AS n, list_distinct(string_split(lower(name), ' ')) AS w FROM ents), p AS (SELECT a.id AS a, b.id AS b, {SIM} AS s FROM e a JOIN e b ON a.id <> b.id)
SELECT a, b, s::DOUBLE AS similarity, row_number() OVER (PARTITION BY a ORDER BY s DESC, b)::INT AS rank FROM p WHERE s >= 0.3 QUALIFY rank <= 3""")
def review_candidates(spark, sf_dir):
    return E.look_alikes(_names(spark, sf_dir), least=0.3)


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'ID' || o_custkey END AS ident, lower(c_name) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT id AS mention_id, CASE WHEN ident IS NOT NULL AND c % 2 = 0 THEN 'e' || c WHEN c % 5 = 0 THEN 'a' || c WHEN c % 7 = 0 THEN 'd' || c ELSE 'new:' || coalesce(ident, 'customer/' || n) END AS entity_id,
CASE WHEN ident IS NOT NULL AND c % 2 = 0 THEN 'identifier' WHEN c % 5 = 0 THEN 'alias' WHEN c % 7 = 0 THEN 'decision' ELSE 'new' END AS how FROM (SELECT *, CAST(regexp_extract(n, '(\\d+)', 1) AS BIGINT) AS c FROM m)""".replace("regexp_extract(n, '(\\d+)', 1)", "regexp_extract(n, '([0-9]+)', 1)"))
def entity_resolve(spark, sf_dir):
    customers = B.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.regexp_extract("c_name", "([0-9]+)", 1).cast("bigint").alias("k"))
    m = B.table(spark, sf_dir, "orders").join(customers, c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("mention_id"), c("c_name").alias("name"), F.lit("customer").alias("entity_type"), F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("ID"), "o_custkey")).alias("identifier"))
    ids = customers.filter("k % 2 = 0").select(F.concat(F.lit("ID"), "c_custkey").alias("identifier"), F.concat(F.lit("e"), "k").alias("entity_id"))
    named = lambda k, p: customers.filter(c("k") % k == 0).select(F.lower("c_name").alias("normalized"), F.lit("customer").alias("entity_type"), F.concat(F.lit(p), "k").alias("entity_id"))
    return E.resolve(m, ids, named(5, "a").withColumn("normalized", _normal()), named(7, "d").withColumn("normalized", _normal()))


def _normal():
    from ..functions.text import normal_name

    return normal_name(c("normalized"))


ORACLE["entity_resolve"] = ORACLE["entity_resolve"].replace("lower(c_name) AS n FROM", "trim(regexp_replace(lower(c_name), '[^a-z0-9_\\s-]', ' ', 'g')) AS n FROM")


@query("""WITH seen AS (SELECT DISTINCT l_orderkey AS run, l_suppkey AS e FROM lineitem) SELECT a.e AS a, b.e AS b, count(*) AS runs FROM seen a JOIN seen b USING (run) WHERE a.e < b.e GROUP BY ALL HAVING count(*) >= 3""")
def cooccurrence(spark, sf_dir):
    return E.cooccurrence(B.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


ENTS = """ents AS (SELECT p_partkey AS id, lower(replace(p_brand, 'Brand#', 'b')) || 's' || p_size || ' the p' || p_partkey || CASE WHEN p_partkey % 50 < 3 THEN ' x' || p_partkey // 50 ELSE '' END AS name FROM part)"""
CLUSTERS = f"""{ENTS}, held AS (SELECT DISTINCT CAST(id AS VARCHAR) AS id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS w FROM ents),
telling AS (SELECT w FROM held WHERE length(w) >= 2 AND w <> 'the' GROUP BY w HAVING count(*) BETWEEN 2 AND greatest(3, 0.4 * (SELECT count(*) FROM ents))), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM held x JOIN held y USING (w) JOIN telling USING (w)),
reach AS (SELECT CAST(id AS VARCHAR) AS v, CAST(id AS VARCHAR) AS r FROM ents UNION SELECT v, b FROM reach JOIN e ON r = a), labels AS (SELECT v, min(r) AS topic FROM reach GROUP BY v),
clusters AS (SELECT topic, v AS id FROM labels QUALIFY count(*) OVER (PARTITION BY topic) BETWEEN 2 AND 12)"""


def _parts(spark, sf_dir):
    """Parts as entities, named by brand and size; three in fifty share a word with their neighbours too."""
    k = c("p_partkey")
    family = F.concat(F.lower(F.replace("p_brand", F.lit("Brand#"), F.lit("b"))), F.lit("s"), c("p_size").cast("string"))
    more = F.when(k % 50 < 3, F.concat(F.lit(" x"), F.floor(k / 50).cast("string"))).otherwise("")
    return B.table(spark, sf_dir, "part").select(k.alias("id"), F.concat(family, F.lit(" the p"), k.cast("string"), more).alias("name"))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT topic, string_agg(id, '|' ORDER BY id) AS members FROM clusters GROUP BY topic")
def topic_clusters(spark, sf_dir):
    return E.topics(_parts(spark, sf_dir), ["the"])


@query(f"""WITH RECURSIVE {CLUSTERS}, shared AS (SELECT topic, w FROM clusters JOIN held USING (id) JOIN (SELECT topic, count(*) AS n FROM clusters GROUP BY topic) USING (topic) WHERE w IN (SELECT w FROM telling) GROUP BY topic, w, n HAVING count(*) >= 0.6 * n
    QUALIFY max(count(*) = n) OVER (PARTITION BY topic) = (count(*) = n)),
named AS (SELECT topic, string_agg(w, '|' ORDER BY w) AS normalized FROM shared GROUP BY topic), own AS (SELECT normalized, id FROM clusters JOIN named USING (topic)),
old AS (SELECT DISTINCT normalized FROM own WHERE CAST(id AS BIGINT) % 3 = 0), members AS (SELECT normalized, id FROM own UNION SELECT normalized, 'gone' FROM old UNION SELECT 'no|more', '1')
SELECT normalized, count(*) AS members, strftime(CASE WHEN normalized = 'no|more' OR normalized IN (SELECT normalized FROM old) THEN DATE '2001-01-01' ELSE DATE '2001-08-01' END, '%Y-%m-%d') AS first_seen,
    CASE normalized WHEN 'no|more' THEN '2001-01-01' ELSE '2001-08-01' END AS last_seen FROM members GROUP BY normalized""")
def topic_store(spark, sf_dir):
    """Topics of parts behind a second run: every third part's topic was there before, with a member that has gone since."""
    parts = _parts(spark, sf_dir)
    clusters = kept(E.topics(parts, ["the"]).select("topic", F.explode(F.split("members", "\\|")).alias("id")), "topics")
    words = kept(E.telling_words(parts, ["the"]), "topics")
    members = clusters.withColumn("entity_type", F.lit("product"))
    found = kept(U.topic_attributes(members, words), "topics")
    named = clusters.join(large(found.select("topic", F.array_join(F.array_sort(F.split("shared", "\\|")), "|").alias("normalized"))), "topic")
    old = named.filter(c("id").cast("bigint") % 3 == 0).select("normalized").distinct()
    old = old.unionByName(spark.createDataFrame([("no|more",)], "normalized string"))
    before = F.lit("2001-01-01").cast("timestamp")
    stored = old.select("normalized", F.lit("old").alias("label"), F.lit("old").alias("category"), before.alias("first_seen"), before.alias("last_seen"))
    had = old.select("normalized", F.when(c("normalized") == "no|more", "1").otherwise("gone").alias("id"))
    topics, all_ = U.rebuilt_topics(stored, had, found, clusters, B.AS_OF)
    day = lambda x: F.date_format(x, "yyyy-MM-dd").alias(x)
    return all_.groupBy("normalized").agg(F.count("*").alias("members")).join(large(topics.select("normalized", day("first_seen"), day("last_seen"))), "normalized")


@query(f"WITH RECURSIVE {CLUSTERS.replace(ENTS, NAMES).replace('BETWEEN 2 AND 12', 'BETWEEN 2 AND 60')} SELECT topic, string_agg(id, '|' ORDER BY id) AS members FROM clusters GROUP BY topic")
def topic_clusters_all(spark, sf_dir):
    """Parts by their names alone, with clusters of up to 60."""
    return E.topics(_names(spark, sf_dir), ["the"], most_members=60)


FACTS = """facts AS (
    SELECT n_name AS country, 'gdp_per_capita_ppp' AS key, DATE '2000-01-01' AS as_of, 0.9::DOUBLE AS confidence FROM nation UNION ALL SELECT n_name, 'population', DATE '1996-01-01', 0.1::DOUBLE FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT n_name, 'logistics_performance', DATE '1999-06-01', 0.7::DOUBLE FROM nation WHERE n_nationkey % 3 = 0)"""


@query(f"""WITH {ALL}, {FACTS}, earned AS (SELECT country, sum(CASE key WHEN 'gdp_per_capita_ppp' THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN date_diff('day', as_of, DATE '2001-08-01') <= 1095 THEN 1 ELSE 0.5::DOUBLE END * greatest(0.2::DOUBLE, confidence)) / 17.5::DOUBLE AS s FROM facts GROUP BY country),
seen AS (SELECT subject AS country, count(DISTINCT series) AS n, count(DISTINCT split_part(series, ':', 1)) AS k FROM all_obs GROUP BY subject)
SELECT country, round(round(100 * (0.5::DOUBLE * coalesce(s, 0) + 0.3::DOUBLE * least(1, coalesce(n, 0) / 20) + 0.2::DOUBLE * least(1, coalesce(k, 0) / 5)), 9), 1) AS coverage,
round(round(100 * (0.5::DOUBLE * coalesce(s, 0) + 0.3::DOUBLE * least(1, coalesce(n, 0) / 20) + 0.2::DOUBLE * least(1, coalesce(k, 0) / 5)), 9), 1) < 40 AS is_low FROM earned FULL JOIN seen USING (country)""")
def country_coverage(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation")
    fact = lambda rows, key, at, sure: rows.select(c("n_name").alias("country"), F.lit(key).alias("key"), F.lit(at).cast("date").alias("as_of"), F.lit(sure).alias("confidence"), F.lit("measured").alias("status"))
    facts = fact(n, "gdp_per_capita_ppp", "2000-01-01", 0.9).union(fact(n.filter("n_nationkey % 2 = 0"), "population", "1996-01-01", 0.1)).union(fact(n.filter("n_nationkey % 3 = 0"), "logistics_performance", "1999-06-01", 0.7))
    seen = B.all_series(spark, sf_dir).select(c("subject").alias("country"), "series", F.substring_index("series", ":", 1).alias("source_id")).distinct()
    return G.coverage(facts, seen, B.AS_OF)


@query(f"""WITH {BUYERS}, {profile('buyers_obs')} SELECT subject, CASE WHEN growth_365d IS NULL THEN NULL WHEN growth_365d >= 60 THEN 'high' WHEN growth_365d >= 25 THEN 'growing' WHEN growth_365d >= 8 THEN 'emerging' WHEN growth_365d > 0 THEN 'low' ELSE 'none' END AS level FROM profile""")
def adoption_level(spark, sf_dir):
    p = S.growth_profile(B.series(spark, sf_dir, "buyers"))
    return p.select(F.substring_index("series", ":", -1).alias("subject"), G.level(c("growth_365d"), F.lit(True)).alias("level"))


MARKETS = "markets AS (SELECT n_name AS country, n_regionkey AS region, (SELECT avg(c_acctbal) / 10000 FROM customer WHERE c_nationkey = n_nationkey) AS a, (SELECT nullif(count(*), 0) / 100.0::DOUBLE FROM supplier WHERE s_nationkey = n_nationkey) AS b FROM nation)"


def _markets(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation").select("n_nationkey", c("n_name").alias("country"), c("n_regionkey").alias("region"))
    a = B.table(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("n_nationkey")).agg((F.avg("c_acctbal") / 10000).alias("a"))
    b = B.table(spark, sf_dir, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg((F.count("*") / 100.0).alias("b"))
    return n.join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").drop("n_nationkey")


@query(f"""WITH {MARKETS} SELECT m.country, round(CASE WHEN m.b IS NULL OR t.b IS NULL THEN 1 - abs(m.a - t.a) ELSE (2 - abs(m.a - t.a) - abs(m.b - t.b)) / 2 END, 4) AS similarity FROM markets m, markets t WHERE t.country = 'NATION_3' AND m.country <> 'NATION_3'""")
def market_similarity(spark, sf_dir):
    return G.market_similarity(_markets(spark, sf_dir), ["a", "b"], "NATION_3")


@query(f"""WITH {MARKETS} SELECT m.country, round((SELECT avg(x.b) FROM markets x WHERE x.region = m.region AND x.country <> m.country), 4) AS leaders, round((SELECT avg(x.b) FROM markets x WHERE x.region = m.region AND x.country <> m.country) - b, 4) + 0 AS gap FROM markets m""")
def geo_gap(spark, sf_dir):
    return G.leader_gap(_markets(spark, sf_dir).withColumnRenamed("region", "subject"), "b").select("country", "leaders", "gap")


def _conversions(lines, o):
    even = c("l_linenumber") % 2 == 0
    lines = lines.join(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), c("l_orderkey") == c("o_orderkey"))
    return lines.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.when(even, c("o_orderstatus")).otherwise(c("o_orderpriority")).alias("base"), F.when(even, c("o_orderpriority")).otherwise(c("o_orderstatus")).alias("quote"), c("l_shipdate").cast("timestamp").alias("as_of"))


@query("""WITH rates AS (SELECT o_orderpriority AS base, o_orderstatus AS quote, CAST(o_orderdate AS TIMESTAMP) AS t, min(o_totalprice / 1000) AS rate FROM orders GROUP BY ALL
), needs AS (
    SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 2 = 0 AS turned, CAST(l_shipdate AS TIMESTAMP) AS t, o_orderpriority AS p, o_orderstatus AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
SELECT id, round(CASE WHEN turned THEN 1 / rate ELSE rate END, 6) AS rate FROM needs n ASOF LEFT JOIN rates r ON n.p = r.base AND n.s = r.quote AND n.t >= r.t""")
def fx_asof(spark, sf_dir):
    """The newest rate, from the rates of all orders, for every line; every other line asks for the inverse."""
    o = B.table(spark, sf_dir, "orders")
    rates = o.select(c("o_orderpriority").alias("base"), c("o_orderstatus").alias("quote"), c("o_orderdate").cast("timestamp").alias("as_of"), (c("o_totalprice") / 1000).alias("rate"))
    return G.rates_at(_conversions(B.table(spark, sf_dir, "lineitem"), o), rates).select("id", F.round("rate", 6).alias("rate"))


QUERIES["fx_asof_all"], ORACLE["fx_asof_all"] = fx_asof, ORACLE["fx_asof"]  # its name before


@query(f"""WITH {ORDERS}, cond AS (SELECT 'orders:' || n_name AS series, n_nationkey AS condition_id, ['gt', 'gte', 'lt', 'lte', 'odd'][n_nationkey % 5 + 1] AS op, 8.0::DOUBLE AS t FROM nation),
r AS (SELECT condition_id, tick, value, op, t FROM cond JOIN orders_obs USING (series) WHERE tick >= TIMESTAMP '2001-08-01' - INTERVAL '365 days'), j AS (SELECT *, CASE op WHEN 'gt' THEN value > t WHEN 'gte' THEN value >= t WHEN 'lt' THEN value < t WHEN 'lte' THEN value <= t END AS ok FROM r),
s AS (SELECT condition_id, count(*) AS n, count(*) FILTER (ok) AS p, arg_max(ok, tick) AS now FROM j GROUP BY condition_id)
SELECT condition_id, CASE WHEN now IS NULL OR op = 'odd' THEN 'unknown' WHEN now THEN CASE WHEN p / n >= 0.6 THEN 'met' ELSE 'partially_met' END WHEN p > 0 THEN 'partially_met' ELSE 'failed' END AS state, coalesce(n, 0) AS readings, coalesce(p, 0) AS passing FROM cond LEFT JOIN s USING (condition_id)""")
def condition_checks(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation")
    conditions = n.select(c("n_nationkey").alias("condition_id"), F.concat(F.lit("orders:"), "n_name").alias("series"), F.get(F.array(*map(F.lit, ("gt", "gte", "lt", "lte", "odd"))), c("n_nationkey") % 5).alias("comparator"), F.lit(8.0).alias("threshold"), F.lit(365).alias("window_days"))
    return M.check_conditions(conditions, B.series(spark, sf_dir, "orders"), B.AS_OF)


HISTORY = f"""{ORDERS}, history AS (SELECT subject, tick, least(100, value * 4) AS score, least(100, value * 7) AS confidence, CASE WHEN value < 5 THEN 1 WHEN value < 8 THEN 2 WHEN value < 12 THEN 3 ELSE 4 END AS risk, CASE WHEN value >= 9 THEN 'active' ELSE 'candidate' END AS state FROM orders_obs),
steps AS (SELECT *, score - lag(score) OVER w AS ds, confidence - lag(confidence) OVER w AS dc, risk - lag(risk) OVER w AS dr, lag(state) OVER w AS ws FROM history WINDOW w AS (PARTITION BY subject ORDER BY tick)),
changes AS (SELECT subject, tick, score, 'score_increased' AS kind, ds AS magnitude FROM steps WHERE ds >= 5 UNION ALL SELECT subject, tick, score, 'score_decreased', -ds FROM steps WHERE ds <= -5 UNION ALL SELECT subject, tick, score, 'confidence_increased', dc FROM steps WHERE dc >= 8
    UNION ALL SELECT subject, tick, score, 'confidence_decreased', -dc FROM steps WHERE dc <= -8 UNION ALL SELECT subject, tick, score, 'risk_increased', dr FROM steps WHERE dr > 0 UNION ALL SELECT subject, tick, score, 'risk_decreased', -dr FROM steps WHERE dr < 0 UNION ALL SELECT subject, tick, score, 'state_changed', 0 FROM steps WHERE state <> ws)"""


def _history(spark, sf_dir):
    v = c("value")
    return B.series(spark, sf_dir, "orders").select("subject", "at", F.least(F.lit(100.0), v * 4).alias("score"), F.least(F.lit(100.0), v * 7).alias("confidence"), F.when(v < 5, "low").when(v < 8, "moderate").when(v < 12, "high").otherwise("very_high").alias("risk_level"), F.when(v >= 9, "active").otherwise("candidate").alias("state"))


def _changes(spark, sf_dir):
    h = _history(spark, sf_dir)
    return M.change_events(h).join(h.select("subject", "at", "score"), ["subject", "at"])


@query(f"WITH {HISTORY} SELECT subject, strftime(tick, '%Y-%m-%d') AS day, kind, magnitude::DOUBLE AS magnitude FROM changes")
def change_events(spark, sf_dir):
    return _changes(spark, sf_dir).select("subject", F.date_format("at", "yyyy-MM-dd").alias("day"), "kind", "magnitude")


RULES = [(1, 10, "score_increased", 12.0, None, True), (2, 10, "risk_increased", None, 30.0, True), (3, 11, "score_increased", 20.0, 40.0, True), (4, 11, "state_changed", None, None, False)]


@query(f"""WITH {HISTORY} SELECT rule_id, user_id, subject, strftime(tick, '%Y-%m-%d') AS day, left(sha256(rule_id || '|' || subject || '|' || kind || '|' || strftime(tick, '%Y-%m-%d')), 48) AS dedupe_key FROM changes JOIN
(VALUES (1, 10, 'score_increased', 12, 0), (2, 10, 'risk_increased', 0, 30), (3, 11, 'score_increased', 20, 40)) r(rule_id, user_id, kind, m, s) USING (kind) WHERE magnitude >= m AND score >= s""")
def alert_match(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule_id int, user_id int, kind string, min_magnitude double, min_score double, enabled boolean").withColumn("cooldown_until", F.lit(None).cast("timestamp"))
    return M.match_alerts(_changes(spark, sf_dir), F.broadcast(rules)).select("rule_id", "user_id", "subject", F.date_format("at", "yyyy-MM-dd").alias("day"), "dedupe_key")  # a row for each rule


def _spend(lines):
    spend = lines.select(c("l_suppkey").alias("key"), c("l_shipdate").cast("timestamp").alias("at"), c("l_extendedprice").alias("amount"), "l_orderkey", c("l_linenumber").cast("bigint").alias("line"))
    return M.spend_window(spend, 30).select("key", "l_orderkey", "line", F.round("spent", 2).alias("spent"))


@query("SELECT l_suppkey AS key, l_orderkey, l_linenumber::BIGINT AS line, round(sum(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL '30 days' PRECEDING AND CURRENT ROW), 2) AS spent FROM lineitem")
def spend_window(spark, sf_dir):
    return _spend(B.table(spark, sf_dir, "lineitem"))


QUERIES["spend_window_all"], ORACLE["spend_window_all"] = spend_window, ORACLE["spend_window"]  # its name before
