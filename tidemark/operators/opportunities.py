"""Opportunities under trends: candidate types, the gate, score components, penalties, confidence and
lifecycle, as expressions over one row for each candidate.

Facts are the signals of a subject (signal_type, signal_class, source_group, reliability, is_proxy,
is_adoption, growth_30d, days_since_latest); facts_of() folds them to one row by subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
# Fixed values of the formula: most points of components, points of penalties, evidence that a type needs.
CAPS = {"real_adoption": 20, "market_potential": 15, "evidence_diversity": 15, "early_entry": 15, "accessibility": 10, "defensibility": 10, "catalyst": 10, "timing": 5}
PENALTIES = {
    "extreme_valuation": 15, "weak_adoption_evidence": 15, "attention_without_adoption": 15, "tiny_market": 10, "extreme_competition": 10, "easily_copied": 8, "regulatory_uncertainty": 10,
    "supply_chain_fragility": 8, "single_supplier": 8, "single_customer": 10, "poor_liquidity": 10, "concentrated_ownership": 12, "anonymous_team": 12, "promotional_manipulation": 15,
    "low_quality_evidence": 10, "single_source_dependence": 10, "already_mainstream": 12, "difficult_local_execution": 8, "poor_economics": 10, "excessive_capital": 8,
}
REQUIRED = {
    "business": ("adoption", "demand_pain", "competition", "willingness_to_pay"),
    "import_distribution": ("trade", "local_availability", "supplier", "shipping_economics", "price"),
    "public_investment": ("financial", "revenue_growth", "valuation", "competitive_position"),
    "crypto": ("adoption", "developer", "liquidity", "token_distribution", "audit", "team"),
}
MOST_PENALTY = 65.0
TIMING = {"weak_signal": 0.6, "emerging": 1.0, "early_adoption": 0.9, "accelerating": 0.7, "mainstream": 0.2, "mature": 0.0, "declining": 0.0}


def lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def candidate_types(subjects: DataFrame) -> DataFrame:
    """A row for each type that a subject (entity_types, classes: arrays) can be examined as."""
    has = lambda *names: F.arrays_overlap("entity_types", F.array(*map(F.lit, names)))
    usual = F.array_compact(F.array(
        F.when(has("public_company"), "public_investment"),
        F.when(F.array_contains("classes", "trade") & has("product", "commodity"), "import_distribution"),
        F.when(has("technology", "product", "software_project", "problem", "skill", "industry"), "business"),
    ))
    types = F.when(has("crypto_asset", "token"), F.array(F.lit("crypto"))).otherwise(usual)
    return subjects.withColumn("opportunity_type", F.explode(types))


def facts_of(facts: DataFrame) -> DataFrame:
    adoption, attention = c("is_adoption") & ~c("is_proxy"), c("signal_class") == "attention"
    g = c("growth_30d")
    return facts.groupBy("subject").agg(
        F.countDistinct("signal_type").alias("types"), F.countDistinct("signal_class").alias("n_classes"), F.countDistinct("source_group").alias("groups"),
        F.countDistinct(F.when(~c("is_proxy"), c("signal_class"))).alias("direct_classes"), F.avg(c("is_proxy").cast("int")).alias("proxy_share"), F.avg("reliability").alias("reliability"),
        F.count_if(adoption).alias("adoptions"), F.count_if(attention).alias("attentions"), F.avg(F.when(adoption, g)).alias("adoption_growth"), F.avg(F.when(attention, g)).alias("attention_growth"),
        F.min("days_since_latest").alias("freshest"), F.count(g).alias("known"), F.count_if(g > 0).alias("rising"), F.max((c("signal_class") == "commercial").cast("int")).alias("commercial"),
        F.sort_array(F.collect_set("signal_class")).alias("classes"),
    )


def gate_reasons() -> Column:
    """Codes of what speaks against examining a trend at all; empty: passed."""
    missing = F.when(c("observation_count") > 0, c("missing_count") / c("observation_count")).otherwise(1.0)
    return F.array_compact(F.array(
        F.when(c("is_one_day_spike"), "spike"), F.when(c("is_seasonal"), "seasonal"), F.when(~c("state").isin("active", "confirmed", "weakening"), "state"),
        F.when(c("types") < 3, "signal_types"), F.when(c("n_classes") < 2, "signal_classes"), F.when(c("groups") < 2, "sources"), F.when(c("trend_score") < 30, "trend_score"),
        F.when(c("confidence") < 35, "trend_confidence"), F.when(c("observation_count") < 20, "observations"), F.when(c("history_days") < 45, "history"), F.when(missing > 0.35, "missing"),
        F.when((c("proxy_share") > 0.75) | (c("direct_classes") == 0), "proxy"),
    ))


def closed() -> Column:
    """No way in, by recorded barriers; capital or difficulty only reinforce them."""
    hard = F.coalesce(c("capital_required") >= 10_000_000, F.lit(False)) | F.coalesce(c("difficulty") == "high", F.lit(False))
    return (c("barriers") >= 3) | ((c("barriers") >= 2) & hard)


def components() -> dict[str, Column]:
    part = lambda name, share: F.round(F.round(share * CAPS[name], 9), 2)
    g, n = c("adoption_growth"), c("competitor_count")
    rate = F.when(g >= 100, 1.0).when(g >= 50, 0.85).when(g >= 25, 0.7).when(g >= 10, 0.5).when(g >= 3, 0.3).when(g >= 0, 0.15).otherwise(0.0)
    adoption = F.when(c("adoptions") == 0, 0.0).when(g.isNull(), 0.25).otherwise(0.6 * rate + 0.4 * F.least(F.lit(1.0), c("adoptions") / 3))
    groups = F.when(c("groups") > 1, F.least(F.lit(1.0), (c("groups") - 1) / 3)).otherwise(0.0)
    entry = F.array_compact(F.array(
        F.create_map(F.lit("none"), F.lit(1.0), F.lit("low"), F.lit(0.8), F.lit("medium"), F.lit(0.4), F.lit("high"), F.lit(0.0))[c("local_penetration")],
        F.when(n <= 1, 1.0).when(n <= 3, 0.75).when(n <= 8, 0.45).when(n <= 20, 0.2).when(n > 20, 0.05),
        F.create_map(F.lit("low"), F.lit(1.0), F.lit("medium"), F.lit(0.5), F.lit("high"), F.lit(0.0))[c("awareness")],
        F.when(c("stage").isin("weak_signal", "emerging", "early_adoption"), 0.8).when(c("stage").isin("mainstream", "mature"), 0.05),
    ))
    mean = F.when(F.size(entry) > 0, F.aggregate(entry, F.lit(0.0), lambda s, x: s + x) / F.size(entry)).otherwise(0.0)
    capital = c("capital_required")
    openness = F.when(capital.isNull(), 0.5).when(capital <= 1e3, 1.0).when(capital <= 1e4, 0.85).when(capital <= 1e5, 0.6).when(capital <= 1e6, 0.35).otherwise(0.15)
    access = F.greatest(F.lit(0.0), 0.4 * openness + 0.35 * lookup({"low": 1.0, "medium": 0.6, "high": 0.25}, c("difficulty"), 0.5) + 0.25 - F.least(F.lit(1.0), c("barriers") * 0.25) * 0.25)
    return {
        "real_adoption": part("real_adoption", adoption),
        "market_potential": part("market_potential", lookup({"large": 1.0, "medium": 0.65, "small": 0.35, "tiny": 0.1}, c("market_size_band"), 0.0)),
        "evidence_diversity": part("evidence_diversity", 0.5 * F.least(F.lit(1.0), c("direct_classes") / 4) + 0.3 * groups + 0.2 * c("reliability")),
        "early_entry": part("early_entry", mean),
        "accessibility": F.when(closed(), 0.0).otherwise(part("accessibility", access)),
        "defensibility": part("defensibility", F.least(F.lit(1.0), c("markers") / 3)),
        "catalyst": F.when(c("catalyst").isNull(), 0.0).when(c("catalyst_is_dated") & c("catalyst_is_stored"), 10.0).when(c("catalyst_is_dated"), 5.0).otherwise(3.0),
        "timing": part("timing", lookup(TIMING, c("stage"), 0.3)),
    }


def penalty_codes() -> Column:
    """Codes of the penalties that apply: from the evidence, then flags (array) of an analysis."""
    talk, use = c("attention_growth"), c("adoption_growth")
    loud = F.when((c("attentions") > 0) & (c("adoptions") > 0), F.coalesce((talk > 40) & (talk > use * 3), F.lit(False))).otherwise((c("attentions") > 0) & (c("adoptions") == 0))
    found = F.array_compact(F.array(
        F.when(c("c_real_adoption") <= 0, "weak_adoption_evidence"), F.when(loud, "attention_without_adoption"), F.when(c("groups") < 2, "single_source_dependence"),
        F.when(c("reliability") < 0.55, "low_quality_evidence"), F.when(c("market_size_band") == "tiny", "tiny_market"), F.when(c("stage").isin("mainstream", "mature"), "already_mainstream"),
        F.when(c("competitor_count") >= 15, "extreme_competition"), F.when((c("markers") == 0) & c("opportunity_type").isin("business", "import_distribution"), "easily_copied"),
    ))
    return F.array_union(found, F.array_intersect("flags", F.array(*map(F.lit, PENALTIES))))


def confidence_parts() -> dict[str, Column]:
    required = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[c("opportunity_type")]
    lacking = F.size(F.array_except(required, "evidence_kinds")) / F.size(required)
    agree = F.when(c("known") >= 2, F.abs(c("rising") / c("known") - 0.5) * 2).otherwise(0.0)
    two = lambda x: F.round(F.round(x, 9), 2)
    return {
        "volume": two(20 * F.least(F.lit(1.0), c("observation_count") / 120)), "quality": two(20 * c("reliability")), "independent": two(F.when(c("groups") > 1, 20 * F.least(F.lit(1.0), (c("groups") - 1) / 3)).otherwise(0.0)),
        "freshness": two(F.when(c("freshest") < 999, 15 * F.exp(-c("freshest") / 45)).otherwise(0.0)), "agreement": two(15 * agree), "commercial": c("commercial") * 10.0,
        "missing": 0.0 - two(20 * F.coalesce(lacking, F.lit(0.0))), "assumptions": 0.0 - F.least(F.lit(15.0), c("assumption_count") * 3.0), "stale": F.when(c("freshest") > 90, -15.0).otherwise(0.0),
    }


def scored(candidates: DataFrame) -> DataFrame:
    """Components (c_), penalties, score, confidence (k_ parts), gate reasons and disposition."""
    out = candidates.withColumns({f"c_{k}": v for k, v in components().items()})
    out = out.withColumn("penalties", F.array_sort(penalty_codes()))
    points = F.aggregate("penalties", F.lit(0.0), lambda s, p: s + F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in (kv[0], float(kv[1]))])[p])
    raw = sum((c(f"c_{k}") for k in CAPS), F.lit(0.0))
    out = out.withColumns({"raw_score": F.round(raw, 2), "penalty_total": F.least(F.lit(MOST_PENALTY), points)} | {f"k_{k}": v for k, v in confidence_parts().items()})
    out = out.withColumn("opportunity_score", F.round(F.least(F.greatest(c("raw_score") - c("penalty_total"), F.lit(0.0)), F.lit(100.0)), 2))
    total = sum((c(f"k_{k}") for k in confidence_parts()), F.lit(0.0))
    out = out.withColumn("opportunity_confidence", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2)).withColumn("reasons", gate_reasons())
    score, sure = c("opportunity_score"), c("opportunity_confidence")
    complete = 1 - F.size(F.array_except(F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[c("opportunity_type")], "evidence_kinds")) / lookup({k: len(v) for k, v in REQUIRED.items()}, c("opportunity_type"), 1)
    return out.withColumn("disposition", F.when(F.size("reasons") > 0, "gate").when(closed(), "closed").when((score < 22) & ~((c("trend_score") >= 40) & (complete >= 0.5)), "score").when(sure < 30, "confidence").otherwise("kept"))


def next_state(score: Column, confidence: Column, peak: Column, previous: Column, risk: Column, skeptic: Column, days: Column) -> Column:
    strong = F.coalesce(previous.isin("watchlist", "promising", "strong_evidence"), F.lit(False))
    return (
        F.when(skeptic == "reject", "invalidated").when(days > 120, "archived").when((peak - score >= 18) & strong, "weakening")
        .when((score >= 70) & (confidence >= 65) & (risk != "very_high"), "strong_evidence").when((score >= 55) & (confidence >= 45), "promising").when(score >= 35, "watchlist").otherwise("candidate")
    )


def skeptic() -> dict[str, Column]:
    """What speaks against a scored candidate: points off the confidence (never more than 60, never
    below nothing), the probability of manipulation, and a status. Columns valuation and
    willingness_to_pay hold an analysis's finding, duplication_ratio the share of copied coverage."""
    use, talk, hit = c("adoption_growth"), c("attention_growth"), lambda when, points: F.when(F.coalesce(when, F.lit(False)), float(points)).otherwise(0.0)
    flagged = lambda name: F.array_contains("flags", name)
    loud = (c("adoptions") > 0) & (talk > use * 2.5) & (talk > 30)
    manipulation = F.greatest(hit(loud, 0.3), hit(c("duplication_ratio") >= 0.4, 0.4), hit(flagged("promotional_manipulation"), 0.6), hit(flagged("anonymous_team"), 0.5))
    late = c("stage").isin("mainstream", "mature") | (c("awareness") == "high") | F.coalesce(c("competitor_count") >= 15, F.lit(False))
    points = (
        hit(c("adoptions") == 0, 15) + hit(loud, 10) + hit(c("groups") < 2, 12) + hit(c("duplication_ratio") >= 0.4, 8) + hit(c("reliability") < 0.55, 8) + hit(c("stage").isin("mainstream", "mature"), 8)
        + hit(c("competitor_count") >= 15, 6) + hit(c("valuation") == "extreme", 10) + hit(c("valuation") == "not_assessed", 8) + hit(c("willingness_to_pay") == "unknown", 10)
        + hit(F.coalesce("market_size_band", F.lit("unknown")).isin("tiny", "unknown"), 6) + hit(c("history_days") < 120, 8) + hit(c("markers") == 0, 6) + hit(flagged("regulatory_uncertainty"), 6) + hit(manipulation >= 0.5, 12)
    )
    reduction = F.least(F.lit(60.0), points)
    status = (
        F.when(manipulation >= 0.6, "possible_manipulation").when((c("risk_level") == "very_high") & (c("adoptions") == 0), "reject").when(c("adoptions") == 0, "insufficient_evidence")
        .when(reduction >= 40, "high_speculation").when(late, "watch_only").when((reduction <= 12) & (c("groups") >= 2), "strong_evidence").otherwise("continue_research")
    )
    return {"manipulation": manipulation, "confidence_reduction": reduction, "skeptic_status": status}


def adoption_to_attention(use: Column, talk: Column) -> Column:
    """How much faster use grows than talk; both are shifted so that falling ones keep the sense."""
    shift = 1 + F.greatest(F.lit(0.0), -F.least(use, talk))
    return F.when(use.isNotNull() & talk.isNotNull(), F.round((use + shift) / F.nullif(talk + shift, F.lit(0.0)), 3))


# Severity of the risk that stands behind a flag.
SEVERITY = {
    "attention_without_adoption": "high", "weak_adoption_evidence": "high", "extreme_valuation": "high", "extreme_competition": "high", "easily_copied": "medium", "regulatory_uncertainty": "high",
    "supply_chain_fragility": "high", "single_supplier": "high", "single_customer": "high", "poor_liquidity": "high", "concentrated_ownership": "high", "anonymous_team": "high",
    "promotional_manipulation": "high", "poor_economics": "high", "excessive_capital": "medium", "difficult_local_execution": "medium", "already_mainstream": "medium", "tiny_market": "medium",
}


def risk_level(codes: Column) -> Column:
    """The worst finding dominates, nothing is averaged: blocking, or three high risks, are very high, one
    high risk is high, any medium one moderate. An early stage is a medium risk itself; a crypto asset
    is never below high. `hints` of an analysis are an array of severities."""
    of = lambda severity: F.size(F.array_intersect(codes, F.array(*[F.lit(k) for k, v in SEVERITY.items() if v == severity])))
    hinted = lambda severity: F.size(F.filter("hints", lambda x: x == severity))
    high = of("high") + hinted("high")
    medium = of("medium") + hinted("medium") + c("stage").isin("weak_signal", "emerging").cast("int")
    level = F.when((hinted("blocking") > 0) | (high >= 3), "very_high").when(high > 0, "high").when(medium > 0, "moderate").otherwise("low")
    return F.when((c("opportunity_type") == "crypto") & level.isin("low", "moderate"), "high").otherwise(level)
