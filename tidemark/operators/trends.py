"""Trend scoring: series profiles are rolled up by subject, then scored by expressions.

Two shuffles: by series for the profiles, by subject for the roll-up. Every component, penalty and
part of the confidence stays a column of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import corroboration

VERSION = "1.0.0"
# Most points of components, and points of penalties.
CAPS = {"growth": 20, "acceleration": 18, "persistence": 15, "source_diversity": 18, "scale": 12, "geographic_spread": 7, "novelty": 10}
PENALTIES = {"tiny_baseline": 15, "one_day_spike": 25, "low_quality_sources": 10, "duplicate_information": 12, "insufficient_history": 12, "seasonality": 15, "missing_data": 8, "proxy_only": 10, "single_source": 10}
MOST_PENALTY, STALE_DAYS = 60, 60
c = F.col


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def weighted(value: str) -> Column:
    known = c(value).isNotNull() & (c("weight") > 0)
    return F.round(F.sum(F.when(known, c(value) * c("weight"))) / F.sum(F.when(known, c("weight"))), 4)


def rollup(profiles: DataFrame, as_of: str, duplication: DataFrame | None = None) -> DataFrame:
    """One row for each subject from its series' profiles joined with their signals. Levels are read
    from one representative series (non-proxy, heaviest, first type); rates are weighted means."""
    p = profiles.withColumn("weight", c("reliability") * F.when(c("is_proxy"), 0.6).otherwise(1.0))
    order = F.struct("is_proxy", (-c("weight")).alias("w"), "signal_type", "series")
    rep = F.min_by(F.struct("baseline_value", "latest_value", "absolute_growth_total", "prior_maximum", "signal_type"), order)
    rising, falling, n = F.count_if(c("direction") == "rising"), F.count_if(c("direction") == "falling"), F.count("*")
    spike = F.sum(F.when(c("is_one_day_spike"), c("weight")).otherwise(0.0)) / F.sum("weight")
    seasonal = F.sum(F.when(c("is_seasonal"), c("weight")).otherwise(0.0)) / F.sum("weight")
    out = p.groupBy("subject").agg(
        weighted("growth_30d").alias("growth_30d"), weighted("growth_90d").alias("growth_90d"), weighted("acceleration_pp").alias("acceleration_pp"),
        weighted("persistence").alias("persistence"), weighted("momentum").alias("momentum"),
        F.when(rising > n / 2, "rising").when(falling > n / 2, "falling").when((rising > 0) & (falling > 0), "flat").otherwise(F.min_by("direction", "series")).alias("direction"),
        rep.alias("rep"), F.coalesce(spike >= 0.25, F.lit(False)).alias("is_one_day_spike"), F.coalesce(seasonal > 0.5, F.lit(False)).alias("is_seasonal"),
        F.sum("observation_count").alias("observation_count"), F.sum("missing_count").alias("missing_count"), F.max("history_days").alias("history_days"),
        F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.max("last_at")), F.lit(999)).alias("days_since_last"),
        F.countDistinct(F.when((c("geo_scope") != "global") & (c("geo_scope") != ""), c("geo_scope"))).alias("places"),
        F.max(F.when(c("geo_scope") != "", 1).otherwise(0)).alias("has_scope"),
    )
    out = out.join(corroboration.corroborate(p), "subject")
    agreeing = (F.coalesce(F.when(c("growth_30d") != 0, c("growth_30d")), c("growth_90d"), F.lit(0.0)) > 0).cast("int") + (F.coalesce(c("momentum"), F.lit(0.0)) > 0).cast("int") + (F.coalesce(c("persistence"), F.lit(0.0)) >= 0.6).cast("int")
    out = out.select("*", "rep.baseline_value", "rep.latest_value", "rep.absolute_growth_total", "rep.prior_maximum", c("rep.signal_type").alias("representative"), agreeing.alias("agreeing_methods")).drop("rep")
    if duplication is None:
        return out.withColumn("duplication_ratio", F.lit(0.0))
    return out.join(duplication, "subject", "left").fillna({"duplication_ratio": 0.0})


def on_levels(profiles: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """Profiles as rows of their subject (entity/...) and of each topic (topic/...) that it is a member of (members:
    subject, topic), so that one roll-up gives the trends of both. Topics with fewer than `least` series have none."""
    topics = members.select("subject", F.concat(F.lit("topic/"), "topic").alias("level")).distinct()
    entities = profiles.select("subject").distinct().withColumn("level", F.concat(F.lit("entity/"), "subject"))
    rows = profiles.join(entities.unionByName(topics), "subject").withColumn("subject", c("level")).drop("level")
    few = rows.groupBy("subject").agg(F.count("*").alias("n")).filter((c("n") < least) & c("subject").startswith("topic/")).select("subject")
    return rows.join(few, "subject", "left_anti")


def components() -> dict[str, Column]:
    growth = F.coalesce("growth_30d", "growth_90d")
    none = F.lit(0.0)
    # rounded twice, so that the last bits of a logarithm don't decide a half cent
    cap = lambda name, share: F.round(F.round(share * CAPS[name], 9), 2)
    diversity = 0.45 * clamp((c("independent_sources") - 1) / 3.0) + 0.35 * clamp((c("signal_classes") - 1) / 2.0) + 0.20 * clamp(c("mean_reliability"))
    high = c("latest_value") / c("prior_maximum")
    return {
        "growth": F.when(growth > 0, cap("growth", clamp(F.log10(1 + growth / 10) / F.log10(F.lit(11.0))))).otherwise(none),
        "acceleration": F.when(c("acceleration_pp") > 0, cap("acceleration", clamp(c("acceleration_pp") / 60))).otherwise(none),
        "persistence": F.coalesce(cap("persistence", c("persistence")), none),
        "source_diversity": F.when(c("independent_sources") > 1, cap("source_diversity", diversity)).otherwise(none),
        "scale": F.when(c("latest_value") > 0, cap("scale", clamp((F.log10("latest_value") - 1) / 3))).otherwise(none),
        "geographic_spread": F.when(c("places") > 0, cap("geographic_spread", clamp(c("places") / 3.0))).when(c("has_scope") == 1, F.lit(CAPS["geographic_spread"] * 0.4)).otherwise(none),
        "novelty": F.when(c("prior_maximum") > 0, F.when(high >= 1.5, 10.0).when(high > 1, 6.0).when(high >= 0.9, 3.0).otherwise(0.0)).otherwise(none),
    }


def missing_share() -> Column:
    return F.coalesce(c("missing_count") / F.nullif(c("observation_count") + c("missing_count"), F.lit(0)), F.lit(0.0))


def penalties() -> dict[str, Column]:
    tiny = F.coalesce(c("baseline_value"), F.lit(0.0)) < 25
    still = F.abs(F.coalesce(c("absolute_growth_total"), F.lit(0.0))) < 15
    points = lambda name, when: F.when(when, float(PENALTIES[name])).otherwise(0.0)
    return {
        "tiny_baseline": F.when(tiny & still, 15.0).when(tiny, 7.5).otherwise(0.0),
        "one_day_spike": points("one_day_spike", c("is_one_day_spike")),
        "low_quality_sources": points("low_quality_sources", (c("mean_reliability") < 0.5) & (c("independent_sources") > 0)),
        "duplicate_information": points("duplicate_information", c("duplication_ratio") >= 0.4),
        "insufficient_history": points("insufficient_history", (c("history_days") < 30) | (c("observation_count") < 8)),
        "seasonality": points("seasonality", c("is_seasonal")),
        "missing_data": points("missing_data", missing_share() > 0.2),
        "proxy_only": points("proxy_only", (c("signal_classes") > 0) & (c("non_proxy_classes") == 0)),
        "single_source": F.when(c("independent_sources") <= 1, 10.0).when(c("dominant_source_share") > 0.75, 5.0).otherwise(0.0),
    }


def confidence_parts() -> dict[str, Column]:
    part = lambda share, most: F.round(clamp(share) * most, 2)
    return {
        "history": part(c("history_days") / 180.0, 25),
        "observations": part(c("observation_count") / 60.0, 20),
        "source_quality": part(c("mean_reliability"), 20),
        "independent_sources_part": part((c("independent_sources") - 1) / 3.0, 20),
        "method_agreement": part(c("agreeing_methods") / 3.0, 15),
        "missing_data_part": F.lit(0.0) - part(missing_share() * 2, 20),
        "stale": F.when(c("days_since_last") > STALE_DAYS, -10.0).otherwise(0.0),
    }


def stage() -> Column:
    growth, zero = F.coalesce("growth_30d", "growth_90d"), F.lit(0.0)
    up, held, accel, level = F.coalesce(growth, zero), F.coalesce(c("persistence"), zero), F.coalesce(c("acceleration_pp"), zero), F.coalesce(c("latest_value"), zero)
    thin = (c("observation_count") < 8) | (c("history_days") < 21) | (c("independent_sources") < 2) | c("is_one_day_spike")
    return (
        F.when((c("direction") == "falling") | F.coalesce(growth < -10, F.lit(False)), "declining").when(thin, "weak_signal")
        .when((accel > 15) & (up > 25) & (held >= 0.5), "accelerating").when((level >= 10_000) & (F.abs(up) < 5), "mature")
        .when((level >= 10_000) & (up >= 5), "mainstream").when((up >= 15) & (held >= 0.5), "early_adoption").otherwise("emerging")
    )


def next_state() -> Column:
    """From previous_state and peak_score (null: none) and the scored columns."""
    promoted = F.coalesce(c("previous_state").isin("active", "confirmed"), F.lit(False))
    score, sure, sources = c("trend_score"), c("confidence"), c("independent_sources")
    return (
        F.when(c("days_since_last") > STALE_DAYS, "ended")
        .when(c("is_one_day_spike") | c("is_seasonal"), F.when(promoted, "invalidated").otherwise("candidate"))
        .when((c("peak_score") - score >= 20) & promoted, "weakening")
        .when((score >= 60) & (sure >= 55) & (sources >= 2), "confirmed")
        .when((score >= 35) & (sure >= 25), F.when(sources < 2, "candidate").otherwise("active"))
        .when(c("stage") == "declining", "weakening").otherwise("candidate")
    )


def scored(subjects: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Components, penalties, confidence parts, scores, stage and lifecycle state of each subject.
    previous: subject, previous_state, peak_score."""
    parts, fines, trust = components(), penalties(), confidence_parts()
    add = lambda names: sum((c(n) for n in names), F.lit(0.0))
    out = subjects.withColumns({f"c_{k}": v for k, v in parts.items()} | {f"p_{k}": v for k, v in fines.items()} | {f"t_{k}": v for k, v in trust.items()})
    out = out.withColumn("raw_score", F.round(add(f"c_{k}" for k in parts), 2)).withColumn("penalty_total", F.round(F.least(add(f"p_{k}" for k in fines), F.lit(float(MOST_PENALTY))), 2))
    out = out.withColumn("trend_score", F.round(clamp(c("raw_score") - c("penalty_total"), 0.0, 100.0), 2)).withColumn("confidence", F.round(clamp(add(f"t_{k}" for k in trust), 0.0, 100.0), 2))
    out = out.withColumn("stage", stage()).withColumn("formula_version", F.lit(VERSION))
    out = out.join(previous, "subject", "left") if previous is not None else out.withColumns({"previous_state": F.lit(None).cast("string"), "peak_score": F.lit(None).cast("double")})
    out = out.withColumn("peak_score", F.greatest(F.coalesce("peak_score", F.lit(0.0)), "trend_score"))
    return out.withColumn("state", next_state())


def page(trends: DataFrame, order: str = "score", limit: int = 50, offset: int = 0, **equal: str) -> DataFrame:
    """A page of trends with the total: equal filters, one of the orders, ties by subject."""
    orders = {"score": c("trend_score"), "confidence": c("confidence"), "acceleration": c("acceleration_pp"), "growth": c("growth_30d")}
    found = trends
    for name, value in equal.items():
        found = found.filter(c(name) == value)
    ranked = found.orderBy(orders[order].desc_nulls_last(), "subject").offset(offset).limit(limit)
    return ranked.crossJoin(found.agg(F.count("*").alias("total")))  # one row


def running_peak(history: DataFrame) -> DataFrame:
    """history: subject, evaluated_at, score; with the peak so far and the drop from it."""
    peak = F.max("score").over(Window.partitionBy("subject").orderBy("evaluated_at").rowsBetween(Window.unboundedPreceding, 0))
    return history.withColumn("peak", peak).withColumn("drop", peak - c("score"))
