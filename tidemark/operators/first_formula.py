"""The earlier opportunity formula, kept so that old scores can be recomputed: eight components, thirteen penalties.

A row is one opportunity: category, adoption_growths and reliabilities (arrays of doubles, nulls in them count for nothing), acceleration_pp, market_size_usd,
sources, dominant_share, accessibility, liquidity, capital_usd, most_capital_usd, markers, satisfied, signal_types (arrays of strings), catalyst_dated, catalyst_stored,
agreement, newest_days, manipulation, risks (array of structs code, severity), is_crypto, is_meme. Unknown numbers are null and score nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .opportunities import lookup

c = F.col
# Fixed values of the formula: most points of components, points of penalties, bands and ratings.
CAPS = {"adoption": 20, "market_size": 15, "acceleration": 15, "sources": 15, "entry": 10, "defensibility": 10, "catalyst": 10, "liquidity": 5}
PENALTIES = {
    "manipulation_risk": 25, "anonymous_team": 10, "concentrated_ownership": 10, "thin_liquidity": 10, "extreme_valuation": 10, "no_working_product": 10, "paid_promotion_dependence": 10, "weak_evidence": 10,
    "regulatory_danger": 10, "single_source_dependence": 8, "unsustainable_growth": 8, "high_competition": 6, "operational_difficulty": 6,
}
PENALTY_OF_RISK = {
    "anonymous_founders": "anonymous_team", "concentrated_ownership": "concentrated_ownership", "thin_liquidity": "thin_liquidity", "extreme_valuation": "extreme_valuation", "no_working_product": "no_working_product",
    "paid_influencer_promotion": "paid_promotion_dependence", "active_enforcement": "regulatory_danger", "import_ban_risk": "regulatory_danger", "single_regulation_dependence": "regulatory_danger",
    "unsustainable_growth": "unsustainable_growth", "dominant_incumbent": "high_competition", "local_competitor_exists": "high_competition", "operational_difficulty": "operational_difficulty", "certification_required": "operational_difficulty",
}
SIZES = ((10_000_000_000, 15), (1_000_000_000, 12), (100_000_000, 9), (10_000_000, 6), (1_000_000, 3), (0, 1))
MARKERS = {"patent": 3, "network_effect": 3, "switching_cost": 2, "exclusive_distribution": 3, "regulatory_licence": 2, "proprietary_data": 3, "brand": 1, "capital_barrier": 2}
ACCESS = {"buildable_solo": 10, "importable": 8, "partnerable": 6, "publicly_tradable": 6, "restricted": 2, "unknown": 0}
LIQUIDITY = {"high": 5, "medium": 3, "low": 1, "illiquid": 0, "not_applicable": 3, "unknown": 0}
BLOCKING = ("confirmed_fraud", "honeypot_behaviour", "delisted", "sanctions_exposure")
ESCALATING = ("anonymous_founders", "missing_audit", "unverified_contract", "concentrated_ownership", "honeypot_behaviour", "no_working_product")
REQUIRED = {
    "technology": ("adoption_metric", "developer_activity", "who_is_building", "timeline"),
    "public_investment": ("revenue", "margins", "valuation", "insider_or_institutional", "competitive_position"),
    "business": ("problem_evidence", "existing_solutions", "willingness_to_pay", "market_size", "acquisition_channel"),
    "import_distribution": ("demand_evidence", "local_availability", "supplier_evidence", "landed_cost_inputs", "certification_requirements"),
}
MOST_PENALTY, MOST_MEME = 60.0, 25.0


def _bound(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    # greatest and least pass over nulls; what isn't known stays null
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def _even(x: Column, digits: int = 2) -> Column:
    """Rounded as old scores were: ties go to the even digit."""
    return F.bround(F.round(x, 9), digits)


def _mean(values: str, otherwise: float) -> Column:
    have = F.array_compact(values)
    return F.coalesce(F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have)), F.lit(otherwise))


def _median(values: str) -> Column:
    """Of an array; null for an empty one."""
    have, n = F.array_sort(F.array_compact(values)), F.size(F.array_compact(values))
    at = lambda i: F.get(have, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def components() -> dict[str, Column]:
    """Points of the parts; see CAPS for their most."""
    none, speed, size = F.lit(0.0), c("acceleration_pp"), c("market_size_usd")
    bands = F.when(F.lit(False), none)
    for least, points in SIZES:
        bands = bands.when(size >= least, float(points))
    access = lookup({k: float(v) for k, v in ACCESS.items()}, c("accessibility"), 0.0) / max(ACCESS.values()) * CAPS["entry"]
    headroom = 1 - c("capital_usd") / F.greatest(c("most_capital_usd"), F.lit(1.0))
    entry = F.when(c("capital_usd").isNull() | c("most_capital_usd").isNull(), access * 0.6).when(c("capital_usd") > c("most_capital_usd"), none).otherwise(access * (0.6 + 0.4 * headroom))
    moat = F.aggregate(F.coalesce("markers", F.array().cast("array<string>")), none, lambda s, m: s + lookup({k: float(v) for k, v in MARKERS.items()}, m, 0.0))
    return {
        "adoption": F.coalesce(_even(_bound(_median("adoption_growths") / 100) * CAPS["adoption"]), none),
        "market_size": F.coalesce(bands, none),
        "acceleration": F.when(speed > 0, _even(_bound(speed / 40) * CAPS["acceleration"])).otherwise(none),
        "sources": F.when(c("sources") > 1, _even(_bound((c("sources") - 1) / 3) * _mean("reliabilities", 0.5) * CAPS["sources"])).otherwise(none),
        "entry": _even(entry),
        "defensibility": F.least(moat, F.lit(float(CAPS["defensibility"]))),
        "catalyst": F.when(c("catalyst_dated") & c("catalyst_stored"), float(CAPS["catalyst"])).when(c("catalyst_dated"), CAPS["catalyst"] * 0.3).otherwise(none),
        "liquidity": F.least(lookup({k: float(v) for k, v in LIQUIDITY.items()}, c("liquidity"), 0.0), F.lit(float(CAPS["liquidity"]))),
    }


def completeness() -> Column:
    """Share of what the category needs; 0 for a category that isn't known."""
    needed = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), _strings(v))])[c("category")]
    have = F.size(F.array_intersect(needed, F.coalesce("satisfied", F.array().cast("array<string>"))))
    return F.when(needed.isNull(), 0.0).otherwise(F.round(have / F.size(needed), 4))


def confidence() -> Column:
    days = c("newest_days")
    recency = F.when(days <= 7, 1.0).when(days < 90, 1 - (days - 7) / 83).otherwise(0.0)
    parts = 0.40 * _mean("reliabilities", 0.0) + 0.25 * c("completeness") + 0.20 * _bound(F.coalesce("agreement", F.lit(0.0))) + 0.15 * recency
    return _even(_bound(parts), 4)


def penalty_codes() -> Column:
    """Codes of the penalties, each once, by name."""
    found = F.array_compact(F.array(
        F.when(c("manipulation") > 0, "manipulation_risk"), F.when(c("completeness") < 0.4, "weak_evidence"), F.when((F.coalesce("sources", F.lit(0)) <= 1) | (c("dominant_share") > 0.7), "single_source_dependence"),
    ))
    of_risk = F.create_map(*[F.lit(x) for kv in PENALTY_OF_RISK.items() for x in kv])
    return F.array_sort(F.array_union(found, F.array_compact(F.transform("risks", lambda r: of_risk[r["code"]]))))


def risk_level() -> Column:
    """The level by penalties, confidence and severities; crypto is never below high, and escalating codes or anything that
    blocks make it very high."""
    severe = lambda *names: F.exists("risks", lambda r: r["severity"].isin(*names))
    fine = c("penalty_total")
    level = (
        F.when((fine <= 5) & (c("confidence") >= 0.75) & ~severe("medium", "high", "blocking"), "low").when((fine <= 20) & ~severe("high", "blocking"), "medium")
        .when((fine <= 40) | severe("high"), "high").otherwise("very_high")
    )
    escalated = F.coalesce("is_crypto", F.lit(False)) & F.exists("risks", lambda r: r["code"].isin(*ESCALATING))
    worst = c("blocked") | F.coalesce(c("manipulation") > 0.5, F.lit(False)) | escalated
    return F.when(worst, "very_high").when(F.coalesce("is_crypto", F.lit(False)) & level.isin("low", "medium"), "high").otherwise(level)


def scored(rows: DataFrame) -> DataFrame:
    """Adds c_ components, raw_score, completeness, confidence, penalties, penalty_total, adjusted_score, blocked, risk_level and
    notes (codes: penalties_capped, meme, blocked, few_signal_types). Expressions over one row: no shuffle.

    A risk without a code or severity counts as medium and nothing else; null arrays are empty ones."""
    risk = "array<struct<code:string,severity:string>>"
    clean = F.transform(F.coalesce(c("risks").cast(risk), F.array().cast(risk)), lambda r: F.struct(F.coalesce(r["code"], F.lit("")).alias("code"), F.coalesce(r["severity"], F.lit("medium")).alias("severity")))
    out = rows.withColumn("risks", clean).withColumns({f"c_{k}": v for k, v in components().items()} | {"completeness": completeness()})
    out = out.withColumns({
        "raw_score": F.round(sum((c(f"c_{k}") for k in CAPS), F.lit(0.0)), 2), "confidence": confidence(), "penalties": penalty_codes(),
        "blocked": F.exists("risks", lambda r: r["code"].isin(*BLOCKING) | (r["severity"] == "blocking")),
    })
    points = F.create_map(*[F.lit(x) for k, v in PENALTIES.items() for x in (k, float(v))])
    of = lambda p: F.when(p == "manipulation_risk", _even(_bound(c("manipulation")) * PENALTIES["manipulation_risk"])).otherwise(points[p])
    out = out.withColumn("_fines", F.aggregate("penalties", F.lit(0.0), lambda s, p: s + of(p))).withColumn("penalty_total", F.round(F.least("_fines", F.lit(MOST_PENALTY)), 2))
    left = F.round(_bound(c("raw_score") - c("penalty_total"), 0.0, 100.0), 2)
    meme = F.coalesce("is_meme", F.lit(False)) & (left > MOST_MEME)
    few = F.size(F.array_distinct(F.array_compact(F.coalesce("signal_types", F.array().cast("array<string>"))))) < 3
    notes = F.array_compact(F.array(F.when(c("_fines") > MOST_PENALTY, "penalties_capped"), F.when(meme, "meme"), F.when(c("blocked"), "blocked"), F.when(few, "few_signal_types")))
    return out.withColumns({"adjusted_score": F.when(c("blocked"), 0.0).when(meme, MOST_MEME).otherwise(left), "risk_level": risk_level(), "notes": notes}).drop("_fines")
