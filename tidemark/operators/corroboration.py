"""Independent corroboration of subjects by their signals. Independence is by source group: sources
that share one count once. Input: a row for each signal of a subject (subject, signal_type,
signal_class, source_id, source_group, reliability, is_proxy, observation_count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def independent_group():
    return F.coalesce(F.nullif(F.col("source_group"), F.lit("")), F.col("source_id"))


def corroborate(signals: DataFrame) -> DataFrame:
    """raw and independent sources, types, classes, non-proxy classes, mean reliability, the share of
    observations that the largest group supplies, the proxy share, and warnings, by subject."""
    rows = signals.withColumn("grp", independent_group()).withColumn("obs", F.greatest("observation_count", F.lit(1)))
    groups = rows.groupBy("subject", "grp").agg(F.sum("obs").alias("obs")).groupBy("subject").agg(F.round(F.max("obs") / F.sum("obs"), 4).alias("dominant_source_share"))
    proxy = F.col("is_proxy") | F.coalesce(F.col("taxonomy_proxy"), F.lit(False)) if "taxonomy_proxy" in signals.columns else F.col("is_proxy")
    found = rows.groupBy("subject").agg(
        F.countDistinct("source_id").alias("raw_sources"), F.countDistinct("grp").alias("independent_sources"),
        F.countDistinct("signal_type").alias("signal_types"), F.countDistinct("signal_class").alias("signal_classes"),
        F.countDistinct(F.when(~F.col("is_proxy"), F.col("signal_class"))).alias("non_proxy_classes"),
        F.round(F.avg("reliability"), 4).alias("mean_reliability"), F.round(F.avg(proxy.cast("int")), 4).alias("proxy_share"),
    ).join(groups, "subject")
    c = F.col
    warnings = F.array_compact(F.array(
        F.when(c("raw_sources") > c("independent_sources"), "shared_owner"),
        F.when(c("independent_sources") < 2, "single_source"),
        F.when((c("dominant_source_share") > 0.7) & (c("independent_sources") > 1), "dominant_source"),
        F.when(c("non_proxy_classes") == 0, "all_proxy").when(c("signal_classes") == 1, "one_kind"),
    ))
    return found.withColumn("warnings", F.array_join(warnings, "|"))


def class_growth(profiles: DataFrame) -> DataFrame:
    """Mean 30-day growth of each class of signals of a subject."""
    return profiles.filter(F.col("growth_30d").isNotNull()).groupBy("subject", "signal_class").agg(F.round(F.avg("growth_30d"), 1).alias("mean_growth"))


# Prior reliability by class of source.
PRIORS = {"official": 0.95, "government": 0.95, "regulated_filing": 0.90, "primary_api": 0.80, "aggregator": 0.60, "forum_social": 0.40, "anonymous_blog": 0.25, "manual_import": 0.70, "demo": 0.50}


def source_reliability(runs: DataFrame, precision: DataFrame) -> DataFrame:
    """Blend of the class prior, the share of runs that didn't fail, and past precision if known.
    runs: source_id, source_class, failed; precision: source_id, precision."""
    prior = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORS.items() for x in kv])[F.col("source_class")], F.lit(0.5))
    rates = runs.groupBy("source_id", "source_class").agg(F.avg(F.col("failed").cast("int")).alias("failure_rate")).join(precision, "source_id", "left")
    kept = 1 - F.least(F.greatest("failure_rate", F.lit(0.0)), F.lit(1.0))
    score = F.when(F.col("precision").isNull(), 0.7 * prior + 0.3 * kept).otherwise(0.5 * prior + 0.3 * kept + 0.2 * F.col("precision"))
    return rates.select("source_id", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("reliability"))
