"""Queries over markets: nations as countries, customers' segments as subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geography as G
from ..operators import markets as K
from ..sources import bindings as B

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


def facts(spark, sf_dir):
    """country, key, value, as_of, status, confidence: what nations' customers and suppliers say, and older figures."""
    buyers = B.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"), F.count("*").alias("buyers"))
    sellers = B.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("sellers"))
    n = B.table(spark, sf_dir, "nation").join(buyers, c("n_nationkey") == c("c_nationkey"), "left").join(sellers, c("n_nationkey") == c("s_nationkey"), "left")
    k = c("n_nationkey")
    figures = {
        "internet_penetration": c("balance") / 80,
        "payment_infrastructure": F.when(k % 2 == 0, c("buyers") % 120),
        "logistics_performance": 1 + c("sellers") / 4,
        "business_formation_days": F.when(k % 5 != 1, k * 6),
        "import_restrictions": k * 5 - 3,
        "regulatory_environment": F.when(k % 3 == 0, 90 - k * 2),
        "gdp_per_capita_ppp": c("balance") * 9,
        "population": c("buyers") * 1000,
    }
    rows = F.array(*[F.struct(F.lit(f).alias("key"), v.cast("double").alias("value")) for f, v in figures.items()])
    newest = n.select(c("n_name").alias("country"), "n_nationkey", F.explode(rows).alias("f")).select("country", "f.key", "f.value", F.lit("2000-01-01").cast("date").alias("as_of"), F.when(k % 6 == 5, "disputed").otherwise("measured").alias("status"), F.lit(0.8).alias("confidence"))
    older = newest.select("country", "key", (c("value") + 7).alias("value"), F.lit("1995-01-01").cast("date").alias("as_of"), F.lit("measured").alias("status"), "confidence")
    return newest.union(older)


def readings(spark, sf_dir):
    """A reading of each segment in each nation where it has customers."""
    sellers = B.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("sellers"))
    nations = B.table(spark, sf_dir, "nation").select("n_nationkey", c("n_name").alias("country"))
    seen = B.table(spark, sf_dir, "customer").groupBy(c("c_mktsegment").alias("subject"), "c_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"), F.max("c_custkey").alias("last"))
    rows = seen.join(nations, c("c_nationkey") == c("n_nationkey")).join(sellers, c("n_nationkey") == c("s_nationkey"), "left")
    k, status = c("n_nationkey"), F.when(c("n_nationkey") % 7 == 3, "no_data").when(c("last") % 5 == 0, "no_signal").otherwise("measured")
    return rows.select(
        "subject", "country", status.alias("status"),
        F.when(status == "measured", c("balance") / 60).alias("adoption_growth"),
        F.when(c("last") % 4 != 0, (c("last") % 90).cast("double")).alias("attention_growth"),
        F.when(k % 5 != 0, F.coalesce("sellers", F.lit(0))).alias("supplier_count"),
        F.when(k % 4 != 0, c("last") % 17).alias("competitor_count"),
        F.when(c("balance") > 0, c("balance") / 100).alias("unit_price"),
        F.get(F.array(F.lit("EUR"), F.lit("USD"), F.lit(None)), (k % 3).cast("int")).alias("price_currency"),
        F.when(k % 6 != 0, c("last") % 1000).alias("first_observed_days_ago"),
        (c("n") * 9 % 100).cast("double").alias("data_coverage"),
    )


FACTS = """figures AS (
    SELECT n_name AS country, n_nationkey AS k, (SELECT avg(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS balance,
        (SELECT nullif(count(*), 0) FROM customer WHERE c_nationkey = n_nationkey) AS buyers, (SELECT nullif(count(*), 0) FROM supplier WHERE s_nationkey = n_nationkey) AS sellers FROM nation
), newest AS (
    SELECT country, k, unnest(['internet_penetration', 'payment_infrastructure', 'logistics_performance', 'business_formation_days', 'import_restrictions', 'regulatory_environment', 'gdp_per_capita_ppp']) AS key,
        unnest([balance / 80, CASE WHEN k % 2 = 0 THEN buyers % 120 END::DOUBLE, 1 + sellers / 4, CASE WHEN k % 5 <> 1 THEN k * 6 END::DOUBLE, (k * 5 - 3)::DOUBLE, CASE WHEN k % 3 = 0 THEN 90 - k * 2 END::DOUBLE, balance * 9]) AS value FROM figures
), scales(key, attribute, low, high, better) AS (VALUES ('internet_penetration', 'internet_penetration', 0, 100, true), ('payment_infrastructure', 'payment_infrastructure', 0, 100, true), ('logistics_performance', 'logistics_performance', 1, 5, true),
    ('business_formation_days', 'business_formation_ease', 1, 120, false), ('import_restrictions', 'import_openness', 0, 100, false), ('regulatory_environment', 'regulatory_environment', 0, 100, true), ('gdp_per_capita_ppp', 'purchasing_power', 500, 80000, true)
), shares AS (
    SELECT country, attribute, round(CASE WHEN better THEN s ELSE 1 - s END + 1e-9, 4) AS share
    FROM (SELECT country, attribute, better, greatest(0, least(1, (value - low) / (high - low))) AS s FROM newest JOIN scales USING (key) WHERE k % 6 <> 5 AND value IS NOT NULL)
), facts AS (
    SELECT country, max(share) FILTER (attribute = 'internet_penetration') AS internet_penetration, max(share) FILTER (attribute = 'payment_infrastructure') AS payment_infrastructure,
        max(share) FILTER (attribute = 'logistics_performance') AS logistics_performance, NULL::DOUBLE AS electricity_reliability, max(share) FILTER (attribute = 'business_formation_ease') AS business_formation_ease,
        max(share) FILTER (attribute = 'import_openness') AS import_openness, max(share) FILTER (attribute = 'regulatory_environment') AS regulatory_environment, max(share) FILTER (attribute = 'purchasing_power') AS purchasing_power
    FROM shares GROUP BY country
)"""
READINGS = """seen AS (SELECT c_mktsegment AS subject, c_nationkey AS k, count(*) AS n, avg(c_acctbal) AS balance, max(c_custkey) AS last FROM customer GROUP BY ALL
), readings AS (
    SELECT subject, n_name AS country, status, CASE WHEN status = 'measured' THEN balance / 60 END AS growth, CASE WHEN last % 4 <> 0 THEN last % 90 END AS attention,
        CASE WHEN k % 5 <> 0 THEN (SELECT count(*) FROM supplier WHERE s_nationkey = k) END AS sellers, CASE WHEN k % 4 <> 0 THEN last % 17 END AS rivals, CASE WHEN balance > 0 THEN balance / 100 END AS price,
        list_value('EUR', 'USD', NULL)[k % 3 + 1] AS currency, CASE WHEN k % 6 <> 0 THEN last % 1000 END AS age, n * 9 % 100 AS covered
    FROM (SELECT *, CASE WHEN k % 7 = 3 THEN 'no_data' WHEN last % 5 = 0 THEN 'no_signal' ELSE 'measured' END AS status FROM seen) JOIN nation ON n_nationkey = k
), banded AS (SELECT *, CASE WHEN growth >= 60 THEN 4 WHEN growth >= 25 THEN 3 WHEN growth >= 8 THEN 2 WHEN growth > 0 THEN 1 WHEN growth <= 0 THEN 0 END AS band FROM readings)"""


def _led(counts: str) -> str:
    """Leaders by a plain join of every market with every other, unlike the operator."""
    return f"""led AS (SELECT t.*, count(o.country) AS leaders, avg(o.growth) AS l_growth, avg(o.band) AS l_band, avg(o.attention) AS l_attention, avg(o.rivals) AS l_rivals, avg(o.age) AS l_age,
        avg(o.price) FILTER (o.currency = t.currency) AS l_price FROM banded t LEFT JOIN banded o ON o.subject = t.subject AND o.country <> t.country AND {counts} GROUP BY ALL)"""


@query(f"WITH {FACTS} SELECT country, attribute, share FROM shares")
def fact_scales(spark, sf_dir):
    found = G.latest_facts(facts(spark, sf_dir)).filter("status = 'measured' and value is not null")
    return K.normalise(found).select("country", "attribute", "share")


@query(f"WITH {FACTS} SELECT * FROM facts")
def market_facts(spark, sf_dir):
    return K.market_facts(facts(spark, sf_dir))


@query(f"""WITH {FACTS}, {READINGS}, {_led("o.status = 'measured'")}, dims AS (
    SELECT subject, country, leaders, CASE status WHEN 'no_signal' THEN 22 * CASE WHEN l_band > 0 THEN l_band / 4 ELSE 0.5::DOUBLE END
            WHEN 'measured' THEN 22 * least(1, 0.65::DOUBLE * greatest(0, coalesce(l_band, 0) - coalesce(band, 0)) / 4 + 0.35::DOUBLE * least(1, coalesce(greatest(0, l_growth - growth) / 100, 0))) END AS adoption_gap,
        CASE WHEN sellers = 0 THEN 15 WHEN sellers <= 2 THEN 11.25 WHEN sellers <= 5 THEN 6 WHEN sellers <= 15 THEN 1.5 WHEN sellers > 15 THEN 0 END::DOUBLE AS supply_gap,
        CASE WHEN l_rivals IS NOT NULL AND rivals IS NOT NULL THEN least(13, greatest(0, l_rivals - rivals) * 1.2) END AS competition_gap,
        CASE WHEN l_attention IS NOT NULL AND attention IS NOT NULL THEN least(10, greatest(0, l_attention - attention) / 10) END AS attention_gap,
        CASE WHEN l_price > 0 AND price IS NOT NULL THEN least(8, greatest(0, (price / l_price - 1) * 12)) END AS price_gap,
        12 * list_avg([internet_penetration, payment_infrastructure, logistics_performance]) AS infrastructure_readiness, 10 * list_avg([business_formation_ease, import_openness, regulatory_environment]) AS regulatory_readiness,
        6 * purchasing_power AS affordability, CASE WHEN l_age IS NOT NULL AND age IS NOT NULL THEN least(4, greatest(0, l_age - age) / 150) END AS time_lag
    FROM led LEFT JOIN facts USING (country)
), cut AS (SELECT subject, country, leaders, {', '.join(f'CASE WHEN leaders > 0 THEN round({k} + 1e-9, 2) END AS {k}' for k in K.DIMENSIONS)} FROM dims)
SELECT *, CASE WHEN coalesce({', '.join(K.DIMENSIONS)}) IS NOT NULL THEN round(least(100, {' + '.join(f'coalesce({k}, 0)' for k in K.DIMENSIONS)}) + 1e-9, 1) END AS gap FROM cut""")
def gap_dimensions(spark, sf_dir):
    return K.gap_dimensions(readings(spark, sf_dir), K.market_facts(facts(spark, sf_dir)))


@query(f"""WITH {READINGS}, {_led("true")}, parts AS (
    SELECT subject, country, CASE WHEN l_growth IS NOT NULL THEN CASE WHEN growth IS NULL THEN 30 ELSE least(30, greatest(0, l_growth - growth) / 4) END END AS adoption,
        CASE WHEN l_attention IS NOT NULL AND attention IS NOT NULL THEN least(15, greatest(0, l_attention - attention) / 8) END AS attention,
        CASE WHEN sellers = 0 THEN 25 WHEN sellers <= 2 THEN 18 WHEN sellers <= 5 THEN 8 WHEN sellers > 5 THEN 0 END::DOUBLE AS supply,
        CASE WHEN l_rivals IS NOT NULL AND rivals IS NOT NULL THEN least(15, greatest(0, l_rivals - rivals) * 1.5) END AS competitors,
        CASE WHEN l_price > 0 AND price IS NOT NULL THEN least(10, greatest(0, (price / l_price - 1) * 20)) END AS price, CASE WHEN l_age IS NOT NULL AND age IS NOT NULL THEN least(5, greatest(0, l_age - age) / 100) END AS lag
    FROM led WHERE leaders > 0
), cut AS (SELECT subject, country, {', '.join(f'round({k} + 1e-9, 2) AS {k}' for k in ('adoption', 'attention', 'supply', 'competitors', 'price', 'lag'))} FROM parts)
SELECT *, CASE WHEN coalesce(adoption, attention, supply, competitors, price, lag) IS NOT NULL THEN round(least(100, coalesce(adoption, 0) + coalesce(attention, 0) + coalesce(supply, 0) + coalesce(competitors, 0) + coalesce(price, 0) + coalesce(lag, 0)) + 1e-9, 2) END AS gap FROM cut""")
def early_gap(spark, sf_dir):
    return K.early_gap(readings(spark, sf_dir))


@query(f"""WITH {READINGS} SELECT subject, count(*) FILTER (status = 'measured') AS measured, count(*) FILTER (status = 'no_signal') AS no_signal, count(*) FILTER (status = 'no_data') AS no_data, count(*) FILTER (covered < 40) AS low_coverage,
    round(least(30, 30 * (1 - count(*) FILTER (status = 'measured') / count(*)) + least(10, 2 * count(*) FILTER (covered < 40))) + 1e-9, 2) AS penalty FROM readings GROUP BY subject""")
def coverage_summary(spark, sf_dir):
    return K.coverage_summary(readings(spark, sf_dir))


@query("""WITH x AS (SELECT n_name AS country, count(*) % 37 AS coverage FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT country, coverage::DOUBLE AS coverage, coverage < 20 AS is_low, row_number() OVER (ORDER BY coverage DESC, country) AS place FROM x""")
def coverage_league(spark, sf_dir):
    nations = B.table(spark, sf_dir, "nation").join(B.table(spark, sf_dir, "customer"), c("n_nationkey") == c("c_nationkey"))
    held = nations.groupBy(c("n_name").alias("country")).agg((F.count("*") % 37).cast("double").alias("coverage"))
    return K.coverage_table(held.withColumn("is_low", c("coverage") < 20))


@query("""WITH rates AS (SELECT o_orderpriority AS base, o_orderstatus AS quote, CAST(o_orderdate AS TIMESTAMP) AS t, min(o_totalprice / 1000) AS rate FROM orders WHERE o_orderpriority < '3' GROUP BY ALL
), needs AS (SELECT l_orderkey, l_linenumber, o_orderpriority AS base, CASE WHEN l_linenumber = 7 THEN o_orderpriority ELSE o_orderstatus END AS quote, CAST(l_shipdate AS TIMESTAMP) + INTERVAL '200 days' AS t, l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), found AS (SELECT n.*, r.t AS rated, r.rate AS found FROM needs n ASOF LEFT JOIN rates r ON n.base = r.base AND n.quote = r.quote AND n.t >= r.t)
SELECT l_orderkey, l_linenumber, round(amount * CASE WHEN base = quote THEN 1 ELSE found END + 1e-9, 2) AS converted,
    CASE WHEN base = quote THEN NULL WHEN found IS NULL THEN 'no_rate' WHEN date_diff('day', CAST(rated AS DATE), CAST(t AS DATE)) > 90 THEN 'stale' END AS note FROM found""")
def fx_converted(spark, sf_dir):
    """Lines of all orders in another currency, by the rates of orders of high priority."""
    o = B.table(spark, sf_dir, "orders")
    rates = o.filter("o_orderpriority < '3'").select(c("o_orderpriority").alias("base"), c("o_orderstatus").alias("quote"), c("o_orderdate").cast("timestamp").alias("as_of"), (c("o_totalprice") / 1000).alias("rate"))
    lines = B.table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), c("l_orderkey") == c("o_orderkey"))
    quote = F.when(c("l_linenumber") == 7, c("o_orderpriority")).otherwise(c("o_orderstatus"))
    needs = lines.select("l_orderkey", "l_linenumber", c("o_orderpriority").alias("base"), quote.alias("quote"), (c("l_shipdate").cast("timestamp") + F.expr("interval 200 days")).alias("as_of"), c("l_extendedprice").alias("amount"))
    return K.converted(needs, rates).select("l_orderkey", "l_linenumber", "converted", "note")
