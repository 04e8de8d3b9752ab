"""Queries over findings: what speaks against candidates, facts, audits, alerts once, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as M
from ..operators import opportunities as O
from ..operators import reports as R
from ..operators import trends as T
from ..sources import bindings as B
from . import market_queries as MQ
from . import opportunity_queries as OQ
from . import trend_queries as TQ

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


@query(f"""{OQ.CANDIDATES}, d AS (
    SELECT *, k % 7 / 10 AS dup, CASE k % 4 WHEN 0 THEN 'extreme' WHEN 1 THEN 'not_assessed' END AS valuation, CASE WHEN k % 3 = 0 THEN 'unknown' END AS wtp, adoptions > 0 AND attention_growth > adoption_growth * 2.5 AND attention_growth > 30 AS loud FROM done
), m AS (SELECT *, greatest(CASE WHEN loud THEN 0.3 ELSE 0 END, CASE WHEN dup >= 0.4 THEN 0.4 ELSE 0 END) AS manip FROM d), r AS (
    SELECT *, least(60, CASE WHEN adoptions = 0 THEN 15 ELSE 0 END + CASE WHEN loud THEN 10 ELSE 0 END + CASE WHEN groups < 2 THEN 12 ELSE 0 END + CASE WHEN dup >= 0.4 THEN 8 ELSE 0 END + CASE WHEN rel < 0.55 THEN 8 ELSE 0 END + CASE WHEN stage IN ('mainstream', 'mature') THEN 8 ELSE 0 END
        + CASE WHEN n >= 15 THEN 6 ELSE 0 END + CASE valuation WHEN 'extreme' THEN 10 WHEN 'not_assessed' THEN 8 ELSE 0 END + CASE WHEN wtp = 'unknown' THEN 10 ELSE 0 END + CASE WHEN band = 'tiny' THEN 6 ELSE 0 END + CASE WHEN history_days < 120 THEN 8 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 6 ELSE 0 END) AS red FROM m)
SELECT subject, opportunity_type, round(manip, 2)::DOUBLE AS manipulation, red::DOUBLE AS confidence_reduction, CASE WHEN k % 2 = 0 AND adoptions = 0 THEN 'reject' WHEN adoptions = 0 THEN 'insufficient_evidence' WHEN red >= 40 THEN 'high_speculation'
    WHEN stage IN ('mainstream', 'mature') OR k % 3 = 2 OR n >= 15 THEN 'watch_only' WHEN red <= 12 AND groups >= 2 THEN 'strong_evidence' ELSE 'continue_research' END AS skeptic_status FROM r""")
def opp_skeptic(spark, sf_dir):
    k = F.substring_index("subject", "_", -1).cast("int")
    rows = OQ.scored(spark, sf_dir).withColumns({"duplication_ratio": k % 7 / 10, "valuation": F.when(k % 4 == 0, "extreme").when(k % 4 == 1, "not_assessed"), "willingness_to_pay": F.when(k % 3 == 0, "unknown"), "risk_level": F.when(k % 2 == 0, "very_high").otherwise("high")})
    return rows.withColumns(O.skeptic()).select("subject", "opportunity_type", "manipulation", "confidence_reduction", "skeptic_status")


@query(f"""{TQ.SIGNALS}, g AS (SELECT subject, avg(growth_30d) FILTER (signal_class IN ('commercial', 'trade')) AS u, avg(growth_30d) FILTER (signal_class = 'attention') AS t FROM sig GROUP BY subject)
SELECT subject, CASE WHEN u IS NOT NULL AND t IS NOT NULL THEN round((u + 1 + greatest(0, -least(u, t))) / nullif(t + 1 + greatest(0, -least(u, t)), 0), 3) END AS ratio FROM g""")
def adoption_attention(spark, sf_dir):
    p = TQ.profiles(spark, sf_dir)
    means = p.groupBy("subject").agg(F.avg(F.when(c("is_adoption"), c("growth_30d"))).alias("u"), F.avg(F.when(c("signal_class") == "attention", c("growth_30d"))).alias("t"))
    return means.select("subject", O.adoption_to_attention(c("u"), c("t")).alias("ratio"))


PARTS = " UNION ALL ".join(f"SELECT subject, subject || '/c_{k}' AS fact_id, round(c_{k}, 4)::DOUBLE AS value FROM trends WHERE c_{k} <> 0" for k in T.CAPS)


@query(f"{TQ.ROLLED} {PARTS}")
def fact_list(spark, sf_dir):
    return R.fact_list(TQ.trends(spark, sf_dir), "subject", "c_")


@query("""WITH claims AS (SELECT conv_id, text, CASE WHEN turn % 3 = 0 THEN [] WHEN turn % 3 = 1 THEN [conv_id % 50] ELSE [conv_id % 50, 1000 + conv_id] END AS ids FROM conversations), u AS (SELECT conv_id, count(DISTINCT i) AS unknown FROM (SELECT conv_id, unnest(ids) AS i FROM claims) WHERE i NOT IN (SELECT item_id FROM benchmark) GROUP BY conv_id),
f AS (SELECT conv_id, count(*) FILTER (regexp_matches(text, '[0-9]|(^|[^A-Za-z])[A-Z][a-z]{2,}([^A-Za-z]|$)|%|\\$|€')) AS factual, count(*) FILTER (regexp_matches(text, '[0-9]|(^|[^A-Za-z])[A-Z][a-z]{2,}([^A-Za-z]|$)|%|\\$|€') AND len(ids) > 0) AS cited FROM claims GROUP BY conv_id)
SELECT conv_id AS report, factual, cited, coalesce(unknown, 0) AS unknown, CASE WHEN factual = 0 THEN 1 ELSE round(cited / factual, 4) END AS density, coalesce(unknown, 0) = 0 AND (factual = 0 OR round(cited / factual, 4) >= 0.9) AS grounded FROM f LEFT JOIN u USING (conv_id)""")
def grounding_audit(spark, sf_dir):
    k, none = c("turn") % 3, F.array().cast("array<bigint>")
    ids = F.when(k == 0, none).when(k == 1, F.array(c("conv_id") % 50)).otherwise(F.array(c("conv_id") % 50, c("conv_id") + 1000))
    claims = B.table(spark, sf_dir, "conversations").select(c("conv_id").alias("report"), "text", ids.alias("evidence_ids"))
    return R.audit(claims, B.table(spark, sf_dir, "benchmark").select(c("item_id").alias("fact_id")))


@query("SELECT source, phrase, count(*) AS texts FROM documents, (SELECT unnest([" + ", ".join("'" + p.replace("'", "''") + "'" for p in R.FORBIDDEN) + "]) AS phrase) WHERE contains(lower(text), phrase) GROUP BY ALL")
def promo_sweep(spark, sf_dir):
    return R.forbidden(B.table(spark, sf_dir, "documents").select("source", "text"), "source", "text")


def _alerts(spark, sf_dir):
    return MQ.alert_match(spark, sf_dir)


@query(f"WITH {MQ.HISTORY}, fired AS ({MQ.ORACLE['alert_match'].split(MQ.HISTORY)[1]}) SELECT DISTINCT user_id, dedupe_key FROM fired WHERE day < '2001-01-01' OR day >= '2001-03-01'")
def delivery_ledger(spark, sf_dir):
    """Alerts found twice, less those that were delivered before."""
    alerts = _alerts(spark, sf_dir)
    ledger = alerts.filter("day >= '2001-01-01' and day < '2001-03-01'").select("user_id", "dedupe_key")
    return M.undelivered(alerts.unionByName(alerts), ledger).select("user_id", "dedupe_key")


@query(f"""WITH {MQ.HISTORY}, w AS (SELECT u AS user_id, n_name AS subject, n_nationkey % 5 = u AS is_watched FROM nation, range(0, 5) t(u)),
e AS (SELECT user_id, subject, kind, is_watched, row_number() OVER (PARTITION BY user_id, is_watched ORDER BY magnitude DESC, subject, kind) AS r FROM changes JOIN w USING (subject) WHERE tick >= TIMESTAMP '2001-06-01' AND tick < TIMESTAMP '2001-07-01')
SELECT user_id, count(*) FILTER (is_watched) AS n_watched, count(*) FILTER (NOT is_watched) AS n_other, coalesce(string_agg(subject || ':' || kind, '|' ORDER BY r) FILTER (is_watched), '') AS watched FROM e WHERE r <= 50 GROUP BY user_id""")
def digest_sections(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation")
    watched = n.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("u"), c("n_name").alias("subject"), "n_nationkey").withColumn("user_id", c("u").cast("bigint")).select("user_id", "subject", (c("n_nationkey") % 5 == c("user_id")).alias("is_watched"))
    return M.digest(MQ._changes(spark, sf_dir), F.broadcast(watched), "2001-06-01", "2001-07-01")  # five users a nation


HIGH, MEDIUM = (", ".join(f"'{k}'" for k, v in O.SEVERITY.items() if v == s) for s in ("high", "medium"))


@query(f"""{OQ.CANDIDATES}, r AS (SELECT *, len(list_filter(codes, lambda x: x IN ({HIGH}))) + CASE WHEN k % 9 = 1 THEN 1 ELSE 0 END AS hi, len(list_filter(codes, lambda x: x IN ({MEDIUM}))) + CASE WHEN stage IN ('weak_signal', 'emerging') THEN 1 ELSE 0 END AS me FROM done),
l AS (SELECT *, CASE WHEN k % 9 = 0 OR hi >= 3 THEN 'very_high' WHEN hi > 0 THEN 'high' WHEN me > 0 THEN 'moderate' ELSE 'low' END AS level FROM r)
SELECT subject, opportunity_type, CASE WHEN opportunity_type = 'crypto' AND level IN ('low', 'moderate') THEN 'high' ELSE level END AS risk_level FROM l""")
def opp_risk(spark, sf_dir):
    k = F.substring_index("subject", "_", -1).cast("int")
    hints = F.when(k % 9 == 0, F.array(F.lit("blocking"))).when(k % 9 == 1, F.array(F.lit("high"))).otherwise(F.array().cast("array<string>"))
    rows = OQ.scored(spark, sf_dir).withColumn("hints", hints)
    return rows.select("subject", "opportunity_type", O.risk_level(F.array_union("penalties", "flags")).alias("risk_level"))


@query(f"""WITH {MQ.MARKETS}, reading AS (SELECT region AS subject, country, CASE WHEN CAST(substr(country, 8) AS INT) % 4 = 0 THEN 'no_signal' WHEN CAST(substr(country, 8) AS INT) % 4 = 3 THEN 'no_data' ELSE 'measured' END AS status, CASE WHEN CAST(substr(country, 8) AS INT) % 4 = 1 THEN 60.0 WHEN CAST(substr(country, 8) AS INT) % 4 = 2 THEN 5.0 END::DOUBLE AS growth FROM markets),
sim AS (SELECT x.country, y.country AS other, 1 - abs(x.a - y.a) AS s FROM markets x JOIN markets y ON x.region = y.region AND x.country <> y.country), p AS (
    SELECT w.subject, w.country, other, s, g.growth - coalesce(w.growth, 0) AS gap, row_number() OVER (PARTITION BY w.subject, w.country ORDER BY s DESC, other DESC) AS r FROM reading w JOIN sim ON sim.country = w.country AND s >= 0.6
    JOIN reading g ON g.subject = w.subject AND g.country = other AND g.status = 'measured' AND g.growth >= 25 WHERE w.status = 'no_signal' OR w.status = 'measured' AND w.growth < 8)
SELECT subject, country, other AS model, round(s, 4) AS similarity, round(gap, 4) AS gap FROM p WHERE r = 1 AND gap >= 25""")
def localization(spark, sf_dir):
    m, k = MQ._markets(spark, sf_dir), F.substring_index("country", "_", -1).cast("int") % 4
    readings = m.select(c("region").alias("subject"), "country", F.when(k == 0, "no_signal").when(k == 3, "no_data").otherwise("measured").alias("status"), F.when(k == 1, 60.0).when(k == 2, 5.0).alias("growth"))
    x, y = m.select("region", "country", "a"), m.select("region", c("country").alias("other"), c("a").alias("b"))
    similar = x.join(y, "region").filter("country != other").select("country", "other", (1 - F.abs(c("a") - c("b"))).alias("similarity"))
    return MQ.G.localization(readings, similar)


@query(f"""WITH {MQ.MARKETS}, m AS (SELECT *, CASE WHEN CAST(substr(country, 8) AS INT) % 3 = 0 THEN a END AS reg, ['en', 'fr', 'de'][CAST(substr(country, 8) AS INT) % 3 + 1] AS lang FROM markets),
s AS (SELECT t.*, avg(o.a) AS sa, avg(o.b) AS sb, avg(o.reg) AS sr, list(DISTINCT o.lang) AS langs FROM m t JOIN m o ON o.region = t.region AND o.country <> t.country GROUP BY ALL),
p AS (SELECT country, CASE WHEN a IS NOT NULL AND sa IS NOT NULL THEN round(round(20 * CASE WHEN sa > 0 THEN least(1, a / sa) ELSE 0 END, 9), 2) ELSE 0 END AS p1, CASE WHEN b IS NOT NULL AND sb IS NOT NULL THEN round(round(20 * least(1, b / sb), 9), 2) ELSE 0 END AS p2,
    CASE WHEN reg IS NOT NULL AND sr IS NOT NULL THEN round(round(15 * CASE WHEN sr > 0 THEN least(1, reg / sr) ELSE 0 END, 9), 2) ELSE 0 END AS p3, CASE WHEN list_contains(langs, lang) THEN 10 ELSE 3 END AS p5, round(20 * 0.3::DOUBLE, 2) AS p6 FROM s)
SELECT country, CASE WHEN CAST(p1 > 0 AS INT) + CAST(p2 > 0 AS INT) + CAST(p3 > 0 AS INT) + 2 >= 3 THEN round(round(p1 + p2 + p3 + p5 + p6, 9), 1) END AS score FROM p""")
def transferability(spark, sf_dir):
    """Each market against the others of its region, their means from sums less its own row."""
    k = F.substring_index("country", "_", -1).cast("int") % 3
    m = MQ._markets(spark, sf_dir).withColumns({"purchasing_power": c("a"), "infrastructure": c("b"), "regulation": F.when(k == 0, c("a")), "logistics": F.lit(None).cast("double"), "language": F.get(F.array(*map(F.lit, ("en", "fr", "de"))), k), "gap": F.lit(30.0)})
    for name in ("purchasing_power", "infrastructure", "regulation", "logistics"):
        m = MQ.G.leader_gap(m.withColumnRenamed("region", "subject").withColumn("__gap", c("gap")), name).withColumn(f"s_{name}", c("leaders")).withColumn("gap", c("__gap")).drop("leaders", "__gap").withColumnRenamed("subject", "region")
    spoken = m.groupBy("region", "language").agg(F.count("*").alias("n"))
    s_languages = spoken.groupBy("region").agg(F.collect_list(F.struct("language", "n")).alias("spoken"))
    others = F.transform(F.filter("spoken", lambda x: (x["language"] != c("language")) | (x["n"] > 1)), lambda x: x["language"])
    return MQ.G.transferability(m.join(s_languages, "region").withColumn("s_languages", others)).select("country", "score")
