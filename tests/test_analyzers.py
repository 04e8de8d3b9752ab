"""Analyzers and the earlier formula against results written out by hand."""

import json

import pytest

from tidemark.operators import analyzers as A
from tidemark.operators import first_formula as V

COLUMNS = "id int, opportunity_type string, " + ", ".join(f"{k} {t}" for k, t in A.CONTEXT.items())
GOODS = dict(local_availability="low", local_competitor_count=2, supplier_count=30, manufacturing_concentration="single_country", unit_weight_kg=18.0, unit_cbm=0.09, margin_evidence="22-30% before shipping", price_evidence="local retail listings")


def examined(spark, *contexts):
    rows = [json.dumps({"id": i, "opportunity_type": kind} | context) for i, (kind, context) in enumerate(contexts)]
    df = spark.createDataFrame([(r,) for r in rows], "j string").selectExpr(f"from_json(j, '{COLUMNS}') as r").select("r.*")
    return A.analysed(df).orderBy("id").collect()


def test_business(spark):
    nothing, stated, busy = examined(
        spark, ("business", {}), ("business", {"willingness_to_pay": "40 USD/month, 6 of 15", "classes": ["developer"]}),
        ("business", {"competitor_count": 15, "capital_required": 250001, "defensibility_markers": ["brand"], "classes": ["commercial", "demand_pain"], "class_growth": {"demand_pain": 12.34}}),
    )
    assert nothing.willingness == "unknown" and nothing.missing == ["competitor_count", "demand_pain", "willingness_to_pay"]
    assert nothing.analysis_flags == ["easily_copied", "weak_adoption_evidence"] and nothing.evidence_kinds == [] and nothing.assumptions == ["capital_required"]
    assert "customer" in nothing.unknown and "shipping_difficulty" not in nothing.unknown
    assert stated.willingness == "stated" and stated.evidence_kinds == ["adoption", "willingness_to_pay"] and stated.analysis_flags == ["easily_copied"]
    assert busy.evidence_kinds == ["adoption", "commercial", "competition", "demand_pain"] and busy.analysis_flags == ["excessive_capital", "extreme_competition"] and busy.evidence_growth == 12.3
    assert busy.missing == ["willingness_to_pay"]


def test_import(spark):
    full, poor, lone, unchecked, heavy = examined(
        spark, ("import_distribution", GOODS | {"classes": ["trade"]}), ("import_distribution", {k: v for k, v in GOODS.items() if k != "margin_evidence"}), ("import_distribution", GOODS | {"supplier_count": 1, "certification": "CE", "market_education_needed": "High"}),
        ("import_distribution", {k: v for k, v in GOODS.items() if k != "local_availability"}), ("import_distribution", GOODS | {"unit_cbm": 0.6, "certification": "none"}),
    )
    assert full.shipping_difficulty == "medium" and full.assumptions == ["shipping_difficulty"] and full.analysis_flags == ["supply_chain_fragility"]
    assert full.evidence_kinds == ["adoption", "local_availability", "price", "shipping_economics", "supplier", "trade"] and full.why_early == ["local_availability", "local_competitor_count"]
    assert poor.analysis_flags == ["poor_economics", "supply_chain_fragility"] and poor.missing == ["margin_evidence"] and poor.assumption_count == 2
    assert lone.analysis_flags == ["difficult_local_execution", "regulatory_uncertainty", "single_supplier", "supply_chain_fragility"]
    assert unchecked.missing == ["local_availability"] and unchecked.why_early == ["local_competitor_count"] and "local_availability" in unchecked.unknown
    assert heavy.shipping_difficulty == "high" and "regulatory_uncertainty" not in heavy.analysis_flags


def test_public_company(spark):
    stale, none, fresh, weak = examined(
        spark, ("public_investment", {"price_age_days": 40, "valuation_band": "extreme"}), ("public_investment", {}), ("public_investment", {"price_age_days": 5, "valuation_band": "Extreme", "trend_exposure": 0.1, "revenue_growth": -3.0}),
        ("public_investment", {"price_age_days": 0, "debt_to_equity": 2.1, "operating_margin": -0.1, "customer_concentration": 0.31, "gross_margin": 0.4, "free_cash_flow": 0.0, "revenue_growth": 1.0}),
    )
    assert stale.valuation == none.valuation == "not_assessed" and stale.analysis_flags == [] and none.missing == ["debt_to_equity", "free_cash_flow", "gross_margin", "price", "revenue_growth", "trend_exposure"]
    assert fresh.valuation == "extreme" and fresh.analysis_flags == ["extreme_valuation"] and fresh.evidence_kinds == ["competitive_position", "financial", "revenue_growth", "valuation"]
    assert weak.analysis_flags == ["poor_economics", "single_customer"] and weak.hint_codes == ["customer_concentration", "high_leverage", "unprofitable"] and weak.hints == ["high"] * 3 and weak.missing == ["trend_exposure"]


def test_crypto(spark):
    nothing, talked, risky, edge = examined(
        spark, ("crypto", {}), ("crypto", {"classes": ["attention"], "active_users": 0, "utility": "none", "audits": []}),
        ("crypto", {"classes": ["attention", "developer"], "founders_identified": False, "liquidity_usd": 249999, "top10_share": 0.51, "bot_activity_share": 0.41, "influencer_promotion": True, "returns_depend_on_inflow": True, "audits": ["one"]}),
        ("crypto", {"founders_identified": True, "liquidity_usd": 250000, "top10_share": 0.5, "insider_share": 0.3, "bot_activity_share": 0.4, "exchange_concentration": 0.71, "utility": "payments", "audits": ["one"], "active_users": 5, "classes": ["attention"]}),
    )
    assert nothing.risk_floor == "high" and nothing.hint_codes == ["meme_coin", "no_product", "unverified_contract"] and nothing.missing == ["active_users", "audits", "liquidity_usd", "token_distribution"]
    assert talked.analysis_flags == ["attention_without_adoption"] and talked.evidence_kinds == ["adoption"] and "audits" in talked.unknown
    assert risky.analysis_flags == ["anonymous_team", "concentrated_ownership", "poor_liquidity", "promotional_manipulation"]
    assert risky.hint_codes == ["anonymous_team", "concentrated_ownership", "low_liquidity", "ponzi_like_incentives", "promotional_hype", "suspicious_volume"] and risky.hints == ["high", "high", "high", "blocking", "high", "high"]
    assert risky.evidence_kinds == ["audit", "developer", "liquidity", "team", "token_distribution"]
    assert edge.analysis_flags == ["poor_liquidity"] and edge.hint_codes == [] and edge.missing == []


def test_other_types_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "other", ""), (3, "business", "")], "id int, opportunity_type string, customer string")
    found = {r.id: r for r in A.analysed(df).collect()}
    assert all(found[i][part] == [] for i in (1, 2) for part in A.PARTS) and found[2].unknown == [] and "customer" in found[3].unknown
    assert A.analysed(df.limit(0)).count() == 0
    paths = A.conditions(A.analysed(df)).collect()
    assert {r.opportunity_type for r in paths} == {"business"} and {r.code for r in paths if r.kind == "path"} == {"build", "provide_service", "learn_skill"} and len(paths) == 9
    assert [r.measure for r in paths if r.code == "build"] == ["unknown"]


FIRST = (
    "name string, category string, adoption_growths array<double>, acceleration_pp double, market_size_usd double, reliabilities array<double>, sources int, dominant_share double, signal_types array<string>, accessibility string, liquidity string, "
    "capital_usd double, most_capital_usd double, markers array<string>, catalyst_dated boolean, catalyst_stored boolean, satisfied array<string>, agreement double, newest_days int, manipulation double, is_crypto boolean, is_meme boolean, "
    "risks array<struct<code:string,severity:string>>"
)
STRONG = dict(
    category="technology", adoption_growths=[60, 80], acceleration_pp=30, market_size_usd=2e9, reliabilities=[0.8, 0.9, 0.7], sources=3, dominant_share=0.4, signal_types=["a", "b", "c"], accessibility="buildable_solo", liquidity="not_applicable",
    capital_usd=5000, most_capital_usd=15000, markers=["network_effect", "proprietary_data"], catalyst_dated=True, catalyst_stored=True, satisfied=["adoption_metric", "developer_activity", "who_is_building", "timeline"], agreement=0.8, newest_days=3,
)
# Rows and what the formula gives for them (raw, penalty, adjusted, confidence, completeness, level).
GOLDEN = {
    "strong": (STRONG, (72.92, 0.0, 72.92, 0.88, 1.0, "low")),
    "thin": (dict(category="import_distribution", adoption_growths=[15], acceleration_pp=2, reliabilities=[0.5], sources=1, dominant_share=1.0, signal_types=["a"], accessibility="importable", liquidity="low", capital_usd=8000, most_capital_usd=15000,
                  satisfied=["demand_evidence"], agreement=0.1, newest_days=45), (11.04, 18.0, 0.0, 0.3513, 0.2, "medium")),
    "hyped": (dict(category="public_investment", adoption_growths=[400], acceleration_pp=90, market_size_usd=5e7, reliabilities=[0.4, 0.35], sources=2, dominant_share=0.8, signal_types=["a", "b", "c"], accessibility="publicly_tradable", liquidity="low",
                   capital_usd=1000, most_capital_usd=15000, satisfied=["valuation"], agreement=0.3, newest_days=1, manipulation=0.7, is_crypto=True, risks=[{"code": "anonymous_founders", "severity": "high"}, {"code": "thin_liquidity", "severity": "high"}]),
              (49.72, 55.5, 0.0, 0.41, 0.2, "very_high")),
    "solid": (dict(category="business", adoption_growths=[35, 40], acceleration_pp=12, market_size_usd=1.2e8, reliabilities=[0.7, 0.75], sources=2, dominant_share=0.55, signal_types=["a", "b", "c"], accessibility="buildable_solo", liquidity="not_applicable",
                   capital_usd=2000, most_capital_usd=15000, markers=["switching_cost"], catalyst_dated=False, satisfied=["problem_evidence", "existing_solutions", "market_size"], agreement=0.6, newest_days=10,
                   risks=[{"code": "dominant_incumbent", "severity": "medium"}]), (39.09, 6.0, 33.09, 0.7046, 0.6, "medium")),
}


def scored(spark, **rows):
    df = spark.createDataFrame([(json.dumps({"name": k} | v),) for k, v in rows.items()], "j string").selectExpr(f"from_json(j, '{FIRST}') as r").select("r.*")
    return {r["name"]: r for r in V.scored(df).collect()}


def test_golden(spark):
    got = scored(spark, **{k: v[0] for k, v in GOLDEN.items()})
    for name, (_, want) in GOLDEN.items():
        r = got[name]
        assert (r.raw_score, r.penalty_total, r.adjusted_score, r.confidence, r.completeness, r.risk_level) == want, name


def test_rules_of_the_earlier_formula(spark):
    risk = lambda code, severity="high": {"code": code, "severity": severity}
    many = [risk(x) for x in ("anonymous_founders", "concentrated_ownership", "thin_liquidity", "extreme_valuation", "no_working_product", "paid_influencer_promotion", "active_enforcement")] + [risk("dominant_incumbent", "medium"), risk("operational_difficulty", "medium")]
    r = scored(
        spark, plain=STRONG, unsized=STRONG | {"market_size_usd": None}, talk=STRONG | {"adoption_growths": []}, single=STRONG | {"sources": 1, "reliabilities": [0.9], "dominant_share": 1.0}, slower=STRONG | {"acceleration_pp": -15},
        dear=STRONG | {"capital_usd": 100_000}, capped=STRONG | {"risks": many, "manipulation": 0.9}, blocked=STRONG | {"risks": [risk("honeypot_behaviour", "blocking")]}, crypto=STRONG | {"is_crypto": True, "category": "public_investment"},
        escalated=STRONG | {"is_crypto": True, "risks": [risk("anonymous_founders", "medium")]}, meme=STRONG | {"is_meme": True}, few=STRONG | {"satisfied": ["timeline"], "signal_types": ["a", "b", "b", None]}, old=STRONG | {"newest_days": 120}, empty={},
    )
    assert r["unsized"].c_market_size == r["talk"].c_adoption == r["single"].c_sources == r["slower"].c_acceleration == r["dear"].c_entry == 0
    assert r["single"].penalties == ["single_source_dependence"] and r["capped"].penalty_total == 60 and r["capped"].notes == ["penalties_capped"]
    assert r["blocked"].blocked and r["blocked"].adjusted_score == 0 and r["blocked"].risk_level == "very_high" and r["blocked"].notes == ["blocked"]
    assert r["crypto"].risk_level == "high" and r["escalated"].risk_level == "very_high" and r["meme"].adjusted_score == 25 and r["meme"].notes == ["meme"]
    assert r["few"].completeness == 0.25 and r["few"].penalties == ["weak_evidence"] and r["few"].notes == ["few_signal_types"] and r["old"].confidence < r["plain"].confidence
    e = r["empty"]
    assert (e.raw_score, e.confidence, e.completeness, e.adjusted_score) == (0, 0, 0, 0) and e.penalties == ["single_source_dependence", "weak_evidence"] and e.risk_level == "medium"


@pytest.mark.parametrize("name", ["risks", "markers"])
def test_null_entries(spark, name):
    r = scored(spark, x=STRONG | {name: [None] if name == "markers" else [{"code": None, "severity": None}]})["x"]
    assert r.adjusted_score is not None and r.risk_level in ("low", "medium")
