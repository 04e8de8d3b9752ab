"""Queries over opportunity candidates: nations as subjects, their context read off the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import opportunities as O
from ..sources import bindings as B
from ..sources.places import kept
from . import trend_queries as TQ
from .series_queries import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def _context(spark, sf_dir):
    """A row for each nation: what an analysis would record about it."""
    n = B.table(spark, sf_dir, "nation").select("n_nationkey", c("n_name").alias("subject"))
    s = B.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("competitor_count"))
    u = B.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("buyers"), F.round(F.avg("c_acctbal") * 100, 0).alias("capital_required"))
    k = c("n_nationkey")
    pick = lambda m, *names: F.get(F.array(*map(F.lit, names)), k % m)
    return n.join(s, c("n_nationkey") == c("s_nationkey"), "left").join(u, c("n_nationkey") == c("c_nationkey"), "left").select(
        "subject", c("competitor_count"), c("capital_required"),
        F.when(c("buyers") >= 65, "large").when(c("buyers") >= 58, "medium").when(c("buyers") >= 50, "small").otherwise("tiny").alias("market_size_band"),
        pick(4, "public_company", "product", "technology", "crypto_asset").alias("entity_type"), pick(3, "low", "medium", "high").alias("awareness"), pick(5, "none", "low", "medium", "high", "unknown").alias("local_penetration"),
        pick(3, "high", "low", "medium").alias("difficulty"), (k % 4).cast("int").alias("barriers"), (k % 5).cast("int").alias("markers"), F.when(k % 2 == 0, "event").alias("catalyst"), (k % 4 == 0).alias("catalyst_is_dated"), (k % 8 == 0).alias("catalyst_is_stored"),
        (k % 3).cast("int").alias("assumption_count"), F.when(k % 6 == 0, F.array(F.lit("single_supplier"), F.lit("unlisted"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(k % 2 == 0, F.array(*map(F.lit, ("adoption", "trade", "price", "revenue_growth")))).otherwise(F.array(F.lit("adoption"))).alias("evidence_kinds"),
    )


def candidates(spark, sf_dir, known=None):
    known = known or kept(TQ.profiles(spark, sf_dir), "profiles")  # a row a series, read by facts and trends
    p = known.select("subject", "signal_type", "signal_class", c("source_group"), "reliability", "is_proxy", "is_adoption", "growth_30d", F.datediff(F.lit(B.AS_OF).cast("date"), "last_at").alias("days_since_latest"))
    t = TQ.trends(spark, sf_dir, known).select("subject", "is_one_day_spike", "is_seasonal", "state", "stage", "trend_score", "confidence", "observation_count", "missing_count", "history_days")
    rows = O.facts_of(p).join(t, "subject").join(_context(spark, sf_dir), "subject")
    return O.candidate_types(rows.withColumn("entity_types", F.array("entity_type")))


def scored(spark, sf_dir):
    return O.scored(candidates(spark, sf_dir))


def _when(table, key, default):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default} END"


def _needs(sql):
    return "CASE opportunity_type " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in O.REQUIRED.items()) + " END" if sql else ""


POINTS = "CASE p " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.PENALTIES.items()) + " END"
ADOPT = "signal_class IN ('commercial', 'trade') AND NOT is_proxy"
CANDIDATES = f"""{TQ.ROLLED}, facts_by AS (
    SELECT subject, count(DISTINCT grp) AS groups, avg(CAST(is_proxy AS INT)) AS proxy, avg(reliability) AS rel, count(*) FILTER ({ADOPT}) AS adoptions, count(*) FILTER (signal_class = 'attention') AS attentions,
        avg(growth_30d) FILTER ({ADOPT}) AS adoption_growth, avg(growth_30d) FILTER (signal_class = 'attention') AS attention_growth, min(date_diff('day', CAST(last_at AS DATE), DATE '2001-08-01')) AS freshest,
        count(growth_30d) AS known, count(*) FILTER (growth_30d > 0) AS rising, max(CAST(signal_class = 'commercial' AS INT)) AS commercial, bool_or(signal_class = 'trade') AS traded FROM sig GROUP BY subject
), context AS (
    SELECT n_name AS subject, n_nationkey AS k, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS rivals, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS buyers,
        (SELECT round(avg(c_acctbal) * 100, 0) FROM customer WHERE c_nationkey = n_nationkey) AS capital FROM nation
), typed AS (
    SELECT *, CASE k % 4 WHEN 0 THEN ['public_investment'] WHEN 1 THEN CASE WHEN traded THEN ['import_distribution', 'business'] ELSE ['business'] END WHEN 2 THEN ['business'] ELSE ['crypto'] END AS kinds,
        CASE WHEN buyers >= 65 THEN 'large' WHEN buyers >= 58 THEN 'medium' WHEN buyers >= 50 THEN 'small' ELSE 'tiny' END AS band, nullif(rivals, 0) AS n, (list_value('high', 'low', 'medium')[k % 3 + 1]) AS difficulty
    FROM trends JOIN facts_by USING (subject) JOIN context USING (subject)
), cand AS (
    SELECT *, k % 4 >= 3 OR (k % 4 = 2 AND (capital >= 10000000 OR difficulty = 'high')) AS shut, {_needs(1)} AS required,
        CASE WHEN k % 2 = 0 THEN ['adoption', 'trade', 'price', 'revenue_growth'] ELSE ['adoption'] END AS kinds_present,
        list_filter([(list_value(1.0, 0.8, 0.4, 0.0, NULL)[k % 5 + 1])::DOUBLE, CASE WHEN n <= 1 THEN 1 WHEN n <= 3 THEN 0.75 WHEN n <= 8 THEN 0.45 WHEN n <= 20 THEN 0.2 WHEN n > 20 THEN 0.05 END::DOUBLE,
            (list_value(1.0, 0.5, 0.0)[k % 3 + 1])::DOUBLE, CASE WHEN stage IN ('weak_signal', 'emerging', 'early_adoption') THEN 0.8 WHEN stage IN ('mainstream', 'mature') THEN 0.05 END::DOUBLE], lambda x: x IS NOT NULL) AS entry
    FROM (SELECT * EXCLUDE (kinds), unnest(kinds) AS opportunity_type FROM typed)
), comps AS (
    SELECT *, round(round(20 * CASE WHEN adoptions = 0 THEN 0 WHEN adoption_growth IS NULL THEN 0.25 ELSE 0.6::DOUBLE * CASE WHEN adoption_growth >= 100 THEN 1 WHEN adoption_growth >= 50 THEN 0.85 WHEN adoption_growth >= 25 THEN 0.7
            WHEN adoption_growth >= 10 THEN 0.5 WHEN adoption_growth >= 3 THEN 0.3 WHEN adoption_growth >= 0 THEN 0.15 ELSE 0 END + 0.4::DOUBLE * least(1, adoptions / 3) END, 9), 2) AS c_real_adoption,
        round(15 * {_when({'large': 1.0, 'medium': 0.65, 'small': 0.35, 'tiny': 0.1}, 'band', 0)}, 2) AS c_market_potential,
        round(round(15 * (0.5::DOUBLE * least(1, non_proxy_classes / 4) + 0.3::DOUBLE * CASE WHEN groups > 1 THEN least(1, (groups - 1) / 3) ELSE 0 END + 0.2::DOUBLE * rel), 9), 2) AS c_evidence_diversity,
        round(round(15 * coalesce(list_avg(entry), 0), 9), 2) AS c_early_entry,
        CASE WHEN shut THEN 0 ELSE round(round(10 * greatest(0, 0.4::DOUBLE * CASE WHEN capital IS NULL THEN 0.5 WHEN capital <= 1e3 THEN 1 WHEN capital <= 1e4 THEN 0.85 WHEN capital <= 1e5 THEN 0.6 WHEN capital <= 1e6 THEN 0.35 ELSE 0.15 END
            + 0.35::DOUBLE * {_when({'low': 1.0, 'medium': 0.6, 'high': 0.25}, 'difficulty', 0.5)} + 0.25::DOUBLE - least(1, (k % 4) * 0.25::DOUBLE) * 0.25::DOUBLE), 9), 2) END AS c_accessibility,
        round(round(10 * least(1, (k % 5) / 3), 9), 2) AS c_defensibility, CASE WHEN k % 2 = 1 THEN 0 WHEN k % 8 = 0 THEN 10 WHEN k % 4 = 0 THEN 5 ELSE 3 END AS c_catalyst,
        round(5 * {_when(O.TIMING, 'stage', 0.3)}, 2) AS c_timing
    FROM cand
), fined AS (
    SELECT *, list_sort(list_filter([CASE WHEN c_real_adoption <= 0 THEN 'weak_adoption_evidence' END,
        CASE WHEN attentions > 0 AND adoptions > 0 AND attention_growth > 40 AND attention_growth > adoption_growth * 3 OR attentions > 0 AND adoptions = 0 THEN 'attention_without_adoption' END,
        CASE WHEN groups < 2 THEN 'single_source_dependence' END, CASE WHEN rel < 0.55 THEN 'low_quality_evidence' END, CASE WHEN band = 'tiny' THEN 'tiny_market' END, CASE WHEN stage IN ('mainstream', 'mature') THEN 'already_mainstream' END,
        CASE WHEN n >= 15 THEN 'extreme_competition' END, CASE WHEN k % 5 = 0 AND opportunity_type IN ('business', 'import_distribution') THEN 'easily_copied' END, CASE WHEN k % 6 = 0 THEN 'single_supplier' END], lambda x: x IS NOT NULL)) AS codes,
        list_filter([CASE WHEN is_one_day_spike THEN 'spike' END, CASE WHEN is_seasonal THEN 'seasonal' END, CASE WHEN state NOT IN ('active', 'confirmed', 'weakening') THEN 'state' END, CASE WHEN signal_types < 3 THEN 'signal_types' END,
            CASE WHEN signal_classes < 2 THEN 'signal_classes' END, CASE WHEN groups < 2 THEN 'sources' END, CASE WHEN trend_score < 30 THEN 'trend_score' END, CASE WHEN confidence < 35 THEN 'trend_confidence' END,
            CASE WHEN observation_count < 20 THEN 'observations' END, CASE WHEN history_days < 45 THEN 'history' END, CASE WHEN missing_count / observation_count > 0.35 THEN 'missing' END,
            CASE WHEN proxy > 0.75 OR non_proxy_classes = 0 THEN 'proxy' END], lambda x: x IS NOT NULL) AS reasons,
        round(c_real_adoption + c_market_potential + c_evidence_diversity + c_early_entry + c_accessibility + c_defensibility + c_catalyst + c_timing, 2) AS raw,
        len(list_filter(required, lambda x: NOT list_contains(kinds_present, x))) / len(required) AS lacking
    FROM comps
), final AS (
    SELECT *, least(65, coalesce(list_sum(list_transform(codes, lambda p: {POINTS})), 0))::DOUBLE AS fine,
        round(round(20 * least(1, observation_count / 120), 9), 2) AS k_volume, round(round(20 * rel, 9), 2) AS k_quality, round(round(CASE WHEN groups > 1 THEN 20 * least(1, (groups - 1) / 3) ELSE 0 END, 9), 2) AS k_independent,
        round(round(15 * exp(-freshest / 45), 9), 2) AS k_freshness, round(round(CASE WHEN known >= 2 THEN 15 * abs(rising / known - 0.5) * 2 ELSE 0 END, 9), 2) AS k_agreement, commercial * 10.0::DOUBLE AS k_commercial,
        0 - round(round(20 * lacking, 9), 2) AS k_missing, 0 - least(15, (k % 3) * 3) AS k_assumptions, CASE WHEN freshest > 90 THEN -15 ELSE 0 END AS k_stale
    FROM fined
), done AS (
    SELECT *, round(least(100, greatest(0, raw - fine)), 2) AS score, round(least(100, greatest(0, k_volume + k_quality + k_independent + k_freshness + k_agreement + k_commercial + k_missing + k_assumptions + k_stale)), 2) AS sure FROM final
)"""


def register(name, build, sql):
    QUERIES[name], ORACLE[name] = build, f"{CANDIDATES} {sql}"


register("opp_types", lambda s, d: candidates(s, d).select("subject", "opportunity_type"), "SELECT subject, opportunity_type FROM cand")
register("opp_gate", lambda s, d: scored(s, d).select("subject", "opportunity_type", (F.size("reasons") == 0).alias("passed"), F.array_join("reasons", "|").alias("reasons")), "SELECT subject, opportunity_type, len(reasons) = 0 AS passed, array_to_string(reasons, '|') AS reasons FROM done")
register("opp_components", lambda s, d: rounded(scored(s, d), "subject", "opportunity_type", *[f"c_{k}" for k in O.CAPS], "raw_score"), "SELECT subject, opportunity_type, " + ", ".join(f"c_{k}::DOUBLE AS c_{k}" for k in O.CAPS) + ", raw AS raw_score FROM done")
register("opp_penalties", lambda s, d: scored(s, d).select("subject", "opportunity_type", F.array_join("penalties", "|").alias("penalties"), "penalty_total"), "SELECT subject, opportunity_type, array_to_string(codes, '|') AS penalties, fine AS penalty_total FROM done")
register("opp_confidence", lambda s, d: rounded(scored(s, d), "subject", "opportunity_type", "k_volume", "k_quality", "k_freshness", "k_agreement", "k_missing", "opportunity_confidence"), "SELECT subject, opportunity_type, k_volume, k_quality, k_freshness, k_agreement, k_missing, sure AS opportunity_confidence FROM done")
register(
    "opp_disposition",
    lambda s, d: scored(s, d).select("subject", "opportunity_type", "opportunity_score", "disposition"),
    "SELECT subject, opportunity_type, score AS opportunity_score, CASE WHEN len(reasons) > 0 THEN 'gate' WHEN shut THEN 'closed' WHEN score < 22 AND NOT (trend_score >= 40 AND 1 - lacking >= 0.5) THEN 'score' WHEN sure < 30 THEN 'confidence' ELSE 'kept' END AS disposition FROM done",
)
