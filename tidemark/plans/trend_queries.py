"""Queries over subjects: corroboration, roll-up, trend scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.taxonomy import classified
from ..operators import corroboration as C
from ..operators import series as S
from ..operators import trends as T
from ..sources import bindings as B
from ..sources.places import kept
from . import text_queries as XQ
from .series_queries import ALL, profile, rounded

c = F.col

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SIGNALS = f"""WITH {ALL}, {profile('all_obs')}, dim AS (
    SELECT * FROM (VALUES ('orders', 'transaction_growth', 'commercial', 'order_book', 'orders', 0.90::DOUBLE, false), ('buyers', 'customer_count_growth', 'commercial', 'crm', 'orders', 0.85, false),
        ('trade', 'import_growth', 'trade', 'customs', 'lineitem', 0.80, false), ('attention', 'social_discussion_growth', 'attention', 'clicks', 'events', 0.40, true))
        v(family, signal_type, signal_class, source_id, grp, reliability, is_proxy)
), sig AS (
    SELECT *, reliability * CASE WHEN is_proxy THEN 0.6::DOUBLE ELSE 1 END AS weight,
        coalesce(month_index >= 1.15 AND abs(yoy_change_pct) < 15, false) AS is_seasonal
    FROM profile JOIN dim ON split_part(series, ':', 1) = family
), corro AS (
    SELECT subject, count(DISTINCT source_id) AS raw_sources, count(DISTINCT grp) AS independent_sources, count(DISTINCT signal_type) AS signal_types, count(DISTINCT signal_class) AS signal_classes,
        count(DISTINCT signal_class) FILTER (NOT is_proxy) AS non_proxy_classes, round(avg(reliability), 4) AS mean_reliability, round(avg(CAST(is_proxy AS INT)), 4) AS proxy_share
    FROM sig GROUP BY subject
), share AS (SELECT subject, round(max(o) / sum(o), 4) AS dominant_source_share FROM (SELECT subject, grp, sum(greatest(n, 1)) AS o FROM sig GROUP BY ALL) GROUP BY subject
), corroborated AS (SELECT * FROM corro JOIN share USING (subject))"""


def w(x: str) -> str:
    return f"round(sum({x} * weight) / sum(weight) FILTER ({x} IS NOT NULL), 4) AS {x}"


ROLLED = f"""{SIGNALS}, rolled AS (
    SELECT subject, {', '.join(map(w, ('growth_30d', 'growth_90d', 'acceleration_pp', 'persistence', 'momentum')))},
        CASE WHEN count(*) FILTER (direction = 'rising') > count(*) / 2 THEN 'rising' WHEN count(*) FILTER (direction = 'falling') > count(*) / 2 THEN 'falling'
            WHEN count(*) FILTER (direction = 'rising') > 0 AND count(*) FILTER (direction = 'falling') > 0 THEN 'flat' ELSE arg_min(direction, series) END AS direction,
        coalesce(sum(weight) FILTER (is_one_day_spike), 0) / sum(weight) >= 0.25 AS is_one_day_spike, coalesce(sum(weight) FILTER (is_seasonal), 0) / sum(weight) > 0.5 AS is_seasonal,
        sum(n)::BIGINT AS observation_count, sum(missing_count)::BIGINT AS missing_count, max(history_days) AS history_days, date_diff('day', CAST(max(last_at) AS DATE), DATE '2001-08-01') AS days_since_last,
        arg_min(baseline_value, (is_proxy, -weight, signal_type)) AS baseline_value, arg_min(latest_value, (is_proxy, -weight, signal_type)) AS latest_value,
        arg_min(absolute_growth_total, (is_proxy, -weight, signal_type)) AS absolute_growth_total, arg_min(prior_maximum, (is_proxy, -weight, signal_type)) AS prior_maximum
    FROM sig GROUP BY subject
), subjects AS (
    SELECT *, CAST(coalesce(nullif(growth_30d, 0), growth_90d, 0) > 0 AS INT) + CAST(coalesce(momentum, 0) > 0 AS INT) + CAST(coalesce(persistence, 0) >= 0.6 AS INT) AS agreeing,
        coalesce(growth_30d, growth_90d) AS g, missing_count / (observation_count + missing_count) AS gaps
    FROM rolled JOIN corroborated USING (subject)
), parts AS (
    SELECT *, CASE WHEN g > 0 THEN round(round(least(1, log10(1 + g / 10) / log10(11)) * 20, 9), 2) ELSE 0 END AS c_growth,
        CASE WHEN acceleration_pp > 0 THEN round(round(least(1, acceleration_pp / 60) * 18, 9), 2) ELSE 0 END AS c_acceleration, coalesce(round(round(persistence * 15, 9), 2), 0) AS c_persistence,
        CASE WHEN independent_sources > 1 THEN round(round(18 * (0.45::DOUBLE * least(1, (independent_sources - 1) / 3.0::DOUBLE) + 0.35::DOUBLE * least(1, (signal_classes - 1) / 2.0::DOUBLE) + 0.2::DOUBLE * mean_reliability), 9), 2) ELSE 0 END AS c_source_diversity,
        CASE WHEN latest_value > 0 THEN round(round(greatest(0, least(1, (log10(latest_value) - 1) / 3)) * 12, 9), 2) ELSE 0 END AS c_scale, round(1 / 3.0::DOUBLE * 7, 2) AS c_geographic_spread,
        CASE WHEN prior_maximum > 0 THEN CASE WHEN latest_value / prior_maximum >= 1.5 THEN 10 WHEN latest_value > prior_maximum THEN 6 WHEN latest_value / prior_maximum >= 0.9 THEN 3 ELSE 0 END ELSE 0 END AS c_novelty,
        CASE WHEN coalesce(baseline_value, 0) < 25 THEN CASE WHEN abs(coalesce(absolute_growth_total, 0)) < 15 THEN 15 ELSE 7.5 END ELSE 0 END AS p_tiny_baseline,
        CASE WHEN is_one_day_spike THEN 25 ELSE 0 END AS p_one_day_spike, CASE WHEN mean_reliability < 0.5 THEN 10 ELSE 0 END AS p_low_quality_sources,
        CASE WHEN history_days < 30 OR observation_count < 8 THEN 12 ELSE 0 END AS p_insufficient_history, CASE WHEN is_seasonal THEN 15 ELSE 0 END AS p_seasonality,
        CASE WHEN gaps > 0.2 THEN 8 ELSE 0 END AS p_missing_data, CASE WHEN non_proxy_classes = 0 THEN 10 ELSE 0 END AS p_proxy_only,
        CASE WHEN independent_sources <= 1 THEN 10 WHEN dominant_source_share > 0.75 THEN 5 ELSE 0 END AS p_single_source,
        round(least(1, history_days / 180.0::DOUBLE) * 25, 2) AS t_history, round(least(1, observation_count / 60.0::DOUBLE) * 20, 2) AS t_observations, round(mean_reliability * 20, 2) AS t_source_quality,
        round(greatest(0, least(1, (independent_sources - 1) / 3.0::DOUBLE)) * 20, 2) AS t_independent_sources_part, round(agreeing / 3.0::DOUBLE * 15, 2) AS t_method_agreement, 0 - round(least(1, gaps * 2) * 20, 2) AS t_missing_data_part,
        CASE WHEN days_since_last > 60 THEN -10 ELSE 0 END AS t_stale
    FROM subjects
), sums AS (
    SELECT *, round(c_growth + c_acceleration + c_persistence + c_source_diversity + c_scale + c_geographic_spread + c_novelty, 2) AS raw_score,
        round(least(60, p_tiny_baseline + p_one_day_spike + p_low_quality_sources + p_insufficient_history + p_seasonality + p_missing_data + p_proxy_only + p_single_source), 2) AS penalty_total,
        round(greatest(0, least(100, t_history + t_observations + t_source_quality + t_independent_sources_part + t_method_agreement + t_missing_data_part + t_stale)), 2) AS confidence
    FROM parts
), scores AS (
    SELECT *, round(greatest(0, least(100, raw_score - penalty_total)), 2) AS trend_score,
        CASE WHEN direction = 'falling' OR g < -10 THEN 'declining' WHEN observation_count < 8 OR history_days < 21 OR independent_sources < 2 OR is_one_day_spike THEN 'weak_signal'
            WHEN acceleration_pp > 15 AND g > 25 AND persistence >= 0.5 THEN 'accelerating' WHEN latest_value >= 10000 AND abs(coalesce(g, 0)) < 5 THEN 'mature'
            WHEN latest_value >= 10000 AND g >= 5 THEN 'mainstream' WHEN g >= 15 AND persistence >= 0.5 THEN 'early_adoption' ELSE 'emerging' END AS stage
    FROM sums
), trends AS (
    SELECT *, CASE WHEN days_since_last > 60 THEN 'ended' WHEN is_one_day_spike OR is_seasonal THEN 'candidate' WHEN trend_score >= 60 AND confidence >= 55 AND independent_sources >= 2 THEN 'confirmed'
        WHEN trend_score >= 35 AND confidence >= 25 THEN CASE WHEN independent_sources < 2 THEN 'candidate' ELSE 'active' END WHEN stage = 'declining' THEN 'weakening' ELSE 'candidate' END AS state
    FROM scores
)"""


def profiles(spark, sf_dir):
    signals = classified(B.signals(spark, sf_dir))
    return S.growth_profile(B.all_series(spark, sf_dir)).join(F.broadcast(signals), "series")  # four signals a nation


def trends(spark, sf_dir, known=None):
    # written once: corroboration and roll-up both read the profiles, a row a series
    return T.scored(T.rollup(known or kept(profiles(spark, sf_dir), "profiles"), B.AS_OF))


#: Nations by themselves, and as members of topics: their region, and the half of the nations by number.
BRIDGE = """bridge AS (SELECT n_name AS subject, 'entity/' || n_name AS level FROM nation UNION ALL SELECT n_name, 'topic/' || r_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT n_name, 'topic/half' || n_nationkey % 2 FROM nation UNION ALL SELECT 'nobody', 'topic/nothing')"""
LEVELS = ROLLED.replace("sig AS (\n    SELECT *, reliability", "own AS (\n    SELECT *, reliability", 1).replace("), corro AS (", f"), {BRIDGE}, sig AS (SELECT own.* REPLACE (level AS subject) FROM own JOIN bridge USING (subject) QUALIFY level LIKE 'entity/%' OR count(*) OVER (PARTITION BY level) >= 2\n), corro AS (", 1)
LEVELS = LEVELS.replace("-weight, signal_type)", "-weight, signal_type, series)").replace("round(1 / 3.0::DOUBLE * 7, 2) AS c_geographic_spread", "round(least(1, (SELECT count(*) FROM bridge WHERE level = subjects.subject) / 3.0::DOUBLE) * 7, 2) AS c_geographic_spread")


def levels(spark, sf_dir):
    """Trends of nations and of topics, from one pass over the profiles."""
    n, r = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "region")
    topic = n.join(r, n.n_regionkey == r.r_regionkey).select(c("n_name").alias("subject"), F.explode(F.array(c("r_name"), F.concat(F.lit("half"), (c("n_nationkey") % 2).cast("string")))).alias("topic"))
    return T.scored(T.rollup(kept(T.on_levels(profiles(spark, sf_dir), topic), "profiles"), B.AS_OF))


def register(name, build, sql, *columns, text=()):
    def run(spark, sf_dir):
        return rounded(build(spark, sf_dir), *columns)

    shown = ", ".join(c if c in text else f"round({c}, 4)::DOUBLE AS {c}" if c not in WHOLE else f"{c}::BIGINT AS {c}" for c in columns)
    QUERIES[name], ORACLE[name] = run, sql.format(shown)


WHOLE = "raw_sources independent_sources signal_types signal_classes non_proxy_classes observation_count missing_count history_days days_since_last".split()
corroborated = lambda spark, sf_dir: C.corroborate(profiles(spark, sf_dir))
register("corroboration", corroborated, SIGNALS + " SELECT {} FROM corroborated", "subject", "raw_sources", "independent_sources", "signal_types", "signal_classes", "non_proxy_classes", "mean_reliability", text=("subject",))
register("dominant_share", corroborated, SIGNALS + " SELECT {} FROM corroborated", "subject", "dominant_source_share", text=("subject",))
register("proxy_share", corroborated, SIGNALS + " SELECT {} FROM corroborated", "subject", "proxy_share", text=("subject",))
register("subject_rollup", trends, ROLLED + " SELECT {} FROM trends", "subject", "growth_30d", "growth_90d", "acceleration_pp", "persistence", "momentum", "direction", "is_one_day_spike", "is_seasonal", "observation_count", "missing_count", "history_days", "days_since_last", "baseline_value", "latest_value", "prior_maximum", text=("subject", "direction", "is_one_day_spike", "is_seasonal"))
register("trend_components", trends, ROLLED + " SELECT {} FROM trends", "subject", *[f"c_{k}" for k in T.CAPS], "raw_score", text=("subject",))
register("trend_penalties", trends, ROLLED + " SELECT {} FROM trends", "subject", *[f"p_{k}" for k in T.PENALTIES if k != "duplicate_information"], "penalty_total", text=("subject",))
register("trend_confidence", trends, ROLLED + " SELECT {} FROM trends", "subject", "t_history", "t_observations", "t_source_quality", "t_independent_sources_part", "t_method_agreement", "t_missing_data_part", "t_stale", "confidence", text=("subject",))
register("trend_stage", trends, ROLLED + " SELECT {} FROM trends", "subject", "trend_score", "stage", "state", text=("subject", "stage", "state"))
register("trend_levels", levels, LEVELS + " SELECT {} FROM trends", "subject", "growth_30d", "is_seasonal", "observation_count", "history_days", "raw_score", "penalty_total", "trend_score", "confidence", "stage", "state", text=("subject", "is_seasonal", "stage", "state"))


def copied(spark, sf_dir):
    """Trends of nations with the duplication among the documents of the source of the same number."""
    n = B.table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), c("n_nationkey").cast("string")).alias("source_id"), c("n_name").alias("subject"))
    ratio = XQ.dup_ratio(spark, sf_dir).join(F.broadcast(n), "source_id").select("subject", "duplication_ratio")  # a row a nation
    return T.scored(T.rollup(kept(profiles(spark, sf_dir), "profiles"), B.AS_OF, ratio))


COPIED = "WITH RECURSIVE " + ROLLED.removeprefix("WITH ") + ", " + XQ.LABELS + """, ratio AS (SELECT n_name AS subject, CASE WHEN count(*) >= 2 THEN round(1 - count(DISTINCT story) / count(*), 4) ELSE 0 END AS duplication_ratio
    FROM told JOIN nation ON source_id = 'src' || n_nationkey GROUP BY n_name), fined AS (
    SELECT * REPLACE (round(least(60, p_tiny_baseline + p_one_day_spike + p_low_quality_sources + p_insufficient_history + p_seasonality + p_missing_data + p_proxy_only + p_single_source + p_duplicate_information), 2) AS penalty_total)
    FROM (SELECT t.*, coalesce(duplication_ratio, 0) AS duplication_ratio, CASE WHEN duplication_ratio >= 0.4 THEN 12 ELSE 0 END AS p_duplicate_information FROM trends t LEFT JOIN ratio USING (subject)))
SELECT subject, round(duplication_ratio, 4)::DOUBLE AS duplication_ratio, p_duplicate_information::DOUBLE AS p_duplicate_information, round(penalty_total, 4)::DOUBLE AS penalty_total, round(greatest(0, least(100, raw_score - penalty_total)), 2)::DOUBLE AS trend_score FROM fined"""
QUERIES["trend_duplication"] = lambda spark, sf_dir: rounded(copied(spark, sf_dir), "subject", "duplication_ratio", "p_duplicate_information", "penalty_total", "trend_score")
ORACLE["trend_duplication"] = COPIED
register("trend_page", lambda spark, sf_dir: T.page(trends(spark, sf_dir), "score", 10, 5), ROLLED + " SELECT {}, (SELECT count(*) FROM trends) AS total FROM trends ORDER BY trend_score DESC, subject LIMIT 10 OFFSET 5", "subject", "trend_score", "confidence", text=("subject",))
QUERIES["trend_page"] = lambda spark, sf_dir: rounded(T.page(trends(spark, sf_dir), "score", 10, 5), "subject", "trend_score", "confidence", "total")
QUERIES["class_growth"] = lambda spark, sf_dir: C.class_growth(profiles(spark, sf_dir).select("subject", "signal_class", "growth_30d"))
ORACLE["class_growth"] = SIGNALS + " SELECT subject, signal_class, round(avg(growth_30d), 1) AS mean_growth FROM sig WHERE growth_30d IS NOT NULL GROUP BY ALL"


def source_reliability(spark, sf_dir):
    """Sources of documents: a source's class and failed runs are read off its documents."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    kinds = F.element_at(F.array(*map(F.lit, C.PRIORS)), (F.length("source") + F.ascii(F.substring("source", 4, 1))) % len(C.PRIORS) + 1)
    runs = d.select(F.col("source").alias("source_id"), kinds.alias("source_class"), (F.col("n_chars") < 200).alias("failed"))
    precision = d.join(labels, "doc_id").groupBy(F.col("source").alias("source_id")).agg(F.avg("quality").alias("precision"))
    return C.source_reliability(runs, precision)


QUERIES["source_reliability"] = source_reliability
ORACLE["source_reliability"] = """WITH prior AS (SELECT unnest([0.95, 0.95, 0.90, 0.80, 0.60, 0.40, 0.25, 0.70, 0.50]::DOUBLE[]) AS p, unnest(range(0, 9)) AS k),
rates AS (SELECT source, avg(CAST(n_chars < 200 AS INT)) AS f FROM documents GROUP BY source), prec AS (SELECT source, avg(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source AS source_id, round(least(1, greatest(0, CASE WHEN q IS NULL THEN 0.7::DOUBLE * p + 0.3::DOUBLE * (1 - f) ELSE 0.5::DOUBLE * p + 0.3::DOUBLE * (1 - f) + 0.2::DOUBLE * q END)), 4) AS reliability
FROM rates LEFT JOIN prec USING (source) JOIN prior ON k = (length(source) + ascii(substr(source, 4, 1))) % 9"""
