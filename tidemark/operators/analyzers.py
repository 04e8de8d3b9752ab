"""What the evidence says about a candidate of each type, and what it leaves open.

A candidate is a row with its opportunity_type, the signal classes of its facts and a context: what has been established
about it, null where nothing has. A rule is a row of RULES; the rules of a type become one array expression for each part, so
that a whole table is examined in one projection. What isn't known is said to be missing and counts for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: Columns of a context and their types; a table may leave any of them out.
CONTEXT = {
    "classes": "array<string>", "class_growth": "map<string,double>", "problem": "string", "customer": "string", "competitor_count": "bigint", "willingness_to_pay": "string", "capital_required": "double", "defensibility_markers": "array<string>",
    "existing_alternatives": "array<string>", "mvp_difficulty": "string", "acquisition_difficulty": "string", "recurring_revenue_potential": "string", "retention_potential": "string", "local_relevance": "string",
    "local_availability": "string", "local_competitor_count": "bigint", "supplier_count": "bigint", "manufacturing_concentration": "string", "likely_moq": "string", "unit_weight_kg": "double", "unit_cbm": "double", "fragility": "string",
    "shipping_difficulty": "string", "customs_requirements": "string", "certification": "string", "warranty_expectation": "string", "after_sales_need": "string", "seasonality": "string", "market_education_needed": "string",
    "wholesale_potential": "string", "retail_potential": "string", "margin_evidence": "string", "price_evidence": "string",
    "revenue_growth": "double", "segment_growth": "double", "gross_margin": "double", "operating_margin": "double", "free_cash_flow": "double", "debt_to_equity": "double", "capex_ratio": "double", "customer_concentration": "double",
    "competitive_position": "string", "trend_exposure": "double", "price_age_days": "bigint", "valuation_band": "string",
    "active_users": "bigint", "network_activity": "double", "utility": "string", "protocol_revenue": "double", "insider_share": "double", "top10_share": "double", "unlock_schedule": "string", "liquidity_usd": "double",
    "exchange_concentration": "double", "audits": "array<string>", "founders_identified": "boolean", "governance": "string", "bot_activity_share": "double", "influencer_promotion": "boolean", "returns_depend_on_inflow": "boolean",
}
#: Fields of a type's record that read UNKNOWN while nothing is established.
RECORD = {
    "business": "problem customer existing_alternatives competitor_count willingness_to_pay mvp_difficulty capital_required acquisition_difficulty recurring_revenue_potential retention_potential local_relevance",
    "import_distribution": "local_availability local_competitor_count supplier_count manufacturing_concentration likely_moq unit_weight_kg unit_cbm fragility shipping_difficulty customs_requirements certification "
    "warranty_expectation after_sales_need seasonality market_education_needed wholesale_potential retail_potential margin_evidence price_evidence",
    "public_investment": "revenue_growth segment_growth gross_margin operating_margin free_cash_flow debt_to_equity capex_ratio customer_concentration competitive_position trend_exposure",
    "crypto": "active_users network_activity utility protocol_revenue token_distribution unlock_schedule liquidity_usd exchange_concentration audits founders_identified governance bot_activity_share influencer_promotion",
}

#: The class of facts whose mean growth a type's record shows.
GROWTH_OF = {"business": "demand_pain", "import_distribution": "trade", "crypto": "developer"}

_OF = "array_contains(classes, '{}')".format
_STALE = "price_age_days is null or price_age_days > 5"
_HELD = "top10_share > 0.5 or insider_share > 0.3"
_UNUSED = f"(utility is null or utility = 'none') and not {_OF('developer')}"
#: Fixed values: (type, part, code, condition). A condition that is null doesn't hold.
RULES = (
    ("business", "evidence_kinds", "demand_pain", _OF("demand_pain")),
    ("business", "evidence_kinds", "willingness_to_pay", "willingness_to_pay is not null"),
    ("business", "evidence_kinds", "adoption", f"{_OF('developer')} or {_OF('commercial')}"),
    ("business", "evidence_kinds", "commercial", _OF("commercial")),
    ("business", "evidence_kinds", "competition", "competitor_count is not null"),
    ("business", "missing", "demand_pain", f"not {_OF('demand_pain')}"),
    ("business", "missing", "competitor_count", "competitor_count is null"),
    ("business", "missing", "willingness_to_pay", "willingness_to_pay is null"),
    ("business", "assumptions", "capital_required", "capital_required is null"),
    ("business", "analysis_flags", "weak_adoption_evidence", f"willingness_to_pay is null and not {_OF('commercial')}"),
    ("business", "analysis_flags", "easily_copied", "defensibility_markers is null or size(defensibility_markers) = 0"),
    ("business", "analysis_flags", "extreme_competition", "competitor_count >= 15"),
    ("business", "analysis_flags", "excessive_capital", "capital_required > 250000"),
    ("import_distribution", "evidence_kinds", "trade", _OF("trade")),
    ("import_distribution", "evidence_kinds", "adoption", _OF("trade")),
    ("import_distribution", "evidence_kinds", "supplier", "supplier_count is not null"),
    ("import_distribution", "evidence_kinds", "local_availability", "local_availability is not null"),
    ("import_distribution", "evidence_kinds", "shipping_economics", "margin_evidence is not null"),
    ("import_distribution", "evidence_kinds", "price", "price_evidence is not null"),
    ("import_distribution", "missing", "supplier_count", "supplier_count is null"),
    ("import_distribution", "missing", "local_availability", "local_availability is null"),
    ("import_distribution", "missing", "margin_evidence", "margin_evidence is null"),
    ("import_distribution", "missing", "price_evidence", "price_evidence is null"),
    ("import_distribution", "assumptions", "margin_evidence", "margin_evidence is null"),
    ("import_distribution", "assumptions", "shipping_difficulty", "shipping_inferred"),
    ("import_distribution", "analysis_flags", "supply_chain_fragility", "manufacturing_concentration in ('single_country', 'single_factory')"),
    ("import_distribution", "analysis_flags", "single_supplier", "supplier_count <= 1"),
    ("import_distribution", "analysis_flags", "regulatory_uncertainty", "certification not in ('none', 'not_required')"),
    ("import_distribution", "analysis_flags", "poor_economics", "margin_evidence is null"),
    ("import_distribution", "analysis_flags", "difficult_local_execution", "lower(market_education_needed) = 'high'"),
    ("import_distribution", "why_early", "local_availability", "local_availability in ('none', 'low')"),
    ("import_distribution", "why_early", "local_competitor_count", "local_competitor_count <= 2"),
    ("public_investment", "evidence_kinds", "financial", "revenue_growth is not null"),
    ("public_investment", "evidence_kinds", "revenue_growth", "revenue_growth is not null"),
    ("public_investment", "evidence_kinds", "competitive_position", "trend_exposure is not null"),
    ("public_investment", "evidence_kinds", "valuation", f"not ({_STALE})"),
    ("public_investment", "missing", "revenue_growth", "revenue_growth is null"),
    ("public_investment", "missing", "gross_margin", "gross_margin is null"),
    ("public_investment", "missing", "free_cash_flow", "free_cash_flow is null"),
    ("public_investment", "missing", "debt_to_equity", "debt_to_equity is null"),
    ("public_investment", "missing", "trend_exposure", "trend_exposure is null"),
    ("public_investment", "missing", "price", _STALE),
    ("public_investment", "assumptions", "valuation", _STALE),
    ("public_investment", "analysis_flags", "extreme_valuation", f"not ({_STALE}) and lower(valuation_band) = 'extreme'"),
    ("public_investment", "analysis_flags", "poor_economics", "debt_to_equity > 2 or operating_margin < 0"),
    ("public_investment", "analysis_flags", "single_customer", "customer_concentration > 0.3"),
    ("public_investment", "hint_codes", "high_leverage", "debt_to_equity > 2"),
    ("public_investment", "hint_codes", "unprofitable", "operating_margin < 0"),
    ("public_investment", "hint_codes", "customer_concentration", "customer_concentration > 0.3"),
    ("crypto", "evidence_kinds", "developer", _OF("developer")),
    ("crypto", "evidence_kinds", "adoption", "active_users is not null"),
    ("crypto", "evidence_kinds", "liquidity", "liquidity_usd is not null"),
    ("crypto", "evidence_kinds", "token_distribution", "token_distribution is not null"),
    ("crypto", "evidence_kinds", "audit", "size(audits) > 0"),
    ("crypto", "evidence_kinds", "team", "founders_identified is not null"),
    ("crypto", "missing", "active_users", "active_users is null"),
    ("crypto", "missing", "liquidity_usd", "liquidity_usd is null"),
    ("crypto", "missing", "token_distribution", "token_distribution is null"),
    ("crypto", "missing", "audits", "audits is null or size(audits) = 0"),
    ("crypto", "analysis_flags", "anonymous_team", "not founders_identified"),
    ("crypto", "analysis_flags", "poor_liquidity", "liquidity_usd < 250000 or exchange_concentration > 0.7"),
    ("crypto", "analysis_flags", "concentrated_ownership", _HELD),
    ("crypto", "analysis_flags", "promotional_manipulation", "bot_activity_share > 0.4 or influencer_promotion"),
    ("crypto", "analysis_flags", "attention_without_adoption", f"{_OF('attention')} and coalesce(active_users, 0) = 0 and not {_OF('developer')}"),
    ("crypto", "hint_codes", "meme_coin", _UNUSED),
    ("crypto", "hint_codes", "no_product", _UNUSED),
    ("crypto", "hint_codes", "anonymous_team", "not founders_identified"),
    ("crypto", "hint_codes", "low_liquidity", "liquidity_usd < 250000"),
    ("crypto", "hint_codes", "concentrated_ownership", _HELD),
    ("crypto", "hint_codes", "unverified_contract", "audits is null or size(audits) = 0"),
    ("crypto", "hint_codes", "suspicious_volume", "bot_activity_share > 0.4"),
    ("crypto", "hint_codes", "promotional_hype", "influencer_promotion"),
    ("crypto", "hint_codes", "ponzi_like_incentives", "returns_depend_on_inflow"),
)
PARTS = ("evidence_kinds", "missing", "assumptions", "analysis_flags", "hint_codes", "why_early")
#: The one hint that blocks; all others are high risks.
BLOCKING = "ponzi_like_incentives"
#: What would confirm a candidate of a type or speak against it, and the ways to take part:
#: (type, kind, code, measure, comparator, value, window in days).
CONDITIONS = (
    ("business", "confirms", "customers_name_a_price", "interviews", "gte", 5.0, None),
    ("business", "confirms", "adoption_keeps_rising", "developer", "gte", 0.0, 90),
    ("business", "confirms", "customer_signs_early", "contracts", "gte", 1.0, None),
    ("business", "refutes", "no_price_named", "interviews", "lt", 2.0, None),
    ("business", "refutes", "adoption_falls", "developer", "lt", 0.0, 90),
    ("business", "refutes", "incumbent_gives_it_away", "competitive_event", None, None, None),
    ("business", "path", "build", None, None, None, None),
    ("business", "path", "provide_service", "low", None, None, None),
    ("business", "path", "learn_skill", "low", None, None, None),
    ("import_distribution", "confirms", "imports_rise", "import_growth", "gt", 0.0, 180),
    ("import_distribution", "confirms", "landed_cost_leaves_margin", "margin", "gte", 0.25, None),
    ("import_distribution", "confirms", "few_distributors", "supplier_count_change", "lte", 0.0, 180),
    ("import_distribution", "refutes", "large_distributor_enters", "supplier_count_change", "gt", 50.0, 180),
    ("import_distribution", "refutes", "certification_fails", "certification", None, None, None),
    ("import_distribution", "refutes", "margin_erased", "margin", "lt", 0.10, None),
    ("import_distribution", "refutes", "imports_fall", "import_growth", "lt", 0.0, 90),
    ("import_distribution", "path", "import", "medium", None, None, None),
    ("import_distribution", "path", "distribute", "medium", None, None, None),
    ("import_distribution", "path", "partner", "low", None, None, None),
    ("public_investment", "confirms", "segment_revenue_grows", "revenue_acceleration", "gt", 0.0, 180),
    ("public_investment", "confirms", "margin_holds", "margin", "gte", None, None),
    ("public_investment", "confirms", "cash_flow_turns", "cash_flow", "gt", 0.0, None),
    ("public_investment", "refutes", "revenue_stalls", "revenue_acceleration", "lte", 0.0, 180),
    ("public_investment", "refutes", "margin_collapses", "margin", "lt", 0.15, None),
    ("public_investment", "refutes", "largest_customer_leaves", "contract_event", None, None, None),
    ("public_investment", "refutes", "price_war", "competitive_event", None, None, None),
    ("public_investment", "path", "investigate_public_company", "low", None, None, None),
    ("public_investment", "path", "watch", "low", None, None, None),
    ("crypto", "confirms", "users_grow_without_price", "users", "gt", 0.0, 90),
    ("crypto", "confirms", "audit_published", "audit", "gte", 1.0, None),
    ("crypto", "confirms", "wallets_spread", "top10_share", "lt", 0.3, None),
    ("crypto", "refutes", "liquidity_too_thin", "liquidity_usd", "lt", 250000.0, None),
    ("crypto", "refutes", "large_unlock", "unlock_event", None, None, None),
    ("crypto", "refutes", "development_stops", "developer", "lte", 0.0, 60),
    ("crypto", "path", "watch", "low", None, None, None),
    ("crypto", "path", "investigate_public_company", "low", None, None, None),
)


def found(part: str) -> Column:
    """Codes of the rules of `part` that hold for the row's type, in order of their names."""
    none = F.array().cast("array<string>")
    out = none
    for kind in RECORD:
        rules = [F.when(F.expr(f"({when})"), F.lit(code)) for t, p, code, when in RULES if (t, p) == (kind, part)]
        out = F.when(c("opportunity_type") == kind, F.array_sort(F.array_compact(F.array(*rules))) if rules else none).otherwise(out)
    return out


def known(rows: DataFrame) -> DataFrame:
    """`rows` with every column of a context in its type: null where the table has none; empty texts are null."""
    have = set(rows.columns)
    typed = {k: (c(k) if k in have else F.lit(None)).cast(t) for k, t in CONTEXT.items()}
    typed |= {k: F.nullif(v, F.lit("")) for k, v in typed.items() if CONTEXT[k] == "string"}
    return rows.withColumns(typed | {"classes": F.coalesce(typed["classes"], F.array().cast("array<string>"))})


def analysed(rows: DataFrame) -> DataFrame:
    """Adds to candidates with their context: evidence_kinds, missing, assumptions (and assumption_count), analysis_flags,
    hint_codes and hints (their severities), why_early as arrays of codes; unknown, the fields of the type's record that read
    UNKNOWN; shipping_difficulty, inferred from weight and volume where nobody stated it; valuation (not_assessed without a
    price of the last five days), willingness (unknown or stated), evidence_growth (30-day growth of the class a type asks for) and risk_floor. A type without an analyzer has empty arrays.

    One projection without a shuffle. Any context column may be missing or null."""
    out = known(rows)
    measured = c("unit_weight_kg").isNotNull() | c("unit_cbm").isNotNull()
    heavy = F.coalesce(c("unit_weight_kg") > 30, F.lit(False)) | F.coalesce(c("unit_cbm") > 0.5, F.lit(False))
    out = out.withColumns({
        "shipping_inferred": c("shipping_difficulty").isNull() & measured,
        "shipping_difficulty": F.coalesce("shipping_difficulty", F.when(measured, F.when(heavy, "high").otherwise("medium"))),
        "token_distribution": F.when(c("insider_share").isNotNull() | c("top10_share").isNotNull(), F.struct("insider_share", "top10_share")),
    })
    out = out.withColumns({part: found(part) for part in PARTS})
    unknown = F.array().cast("array<string>")
    for kind, fields in RECORD.items():
        # an empty list says as little as none
        empty = lambda f: c(f).isNull() | (F.size(f) <= 0) if CONTEXT.get(f, "").startswith("array") else c(f).isNull()
        unknown = F.when(c("opportunity_type") == kind, F.array_compact(F.array(*[F.when(empty(f), F.lit(f)) for f in sorted(fields.split())]))).otherwise(unknown)
    priced = F.array_contains("evidence_kinds", "valuation")
    return out.withColumns({
        "unknown": unknown, "assumption_count": F.size("assumptions"),
        "hints": F.transform("hint_codes", lambda x: F.when(x == BLOCKING, "blocking").otherwise("high")),
        "valuation": F.when(c("opportunity_type") == "public_investment", F.when(~priced, "not_assessed").otherwise(F.lower(F.coalesce("valuation_band", F.lit("unknown"))))),
        "willingness": F.when(c("opportunity_type") == "business", F.when(c("willingness_to_pay").isNull(), "unknown").otherwise("stated")),
        "evidence_growth": F.round(c("class_growth")[F.create_map(*[F.lit(x) for kv in GROWTH_OF.items() for x in kv])[c("opportunity_type")]], 1),
        "risk_floor": F.when(c("opportunity_type") == "crypto", "high"),
    }).drop("shipping_inferred")


def conditions(analysed_rows: DataFrame) -> DataFrame:
    """A row for each candidate and condition or path of its type; a public company's margin is to hold at what it is now, a
    first version is as hard to build as was established (unknown otherwise). The table of conditions has fixed rows."""
    spark = analysed_rows.sparkSession
    dim = spark.createDataFrame(CONDITIONS, "opportunity_type string, kind string, code string, measure string, comparator string, value double, window_days int")
    out = analysed_rows.join(F.broadcast(dim), "opportunity_type")  # 36 rows
    built = F.when(c("code") == "build", F.coalesce(F.lower("mvp_difficulty"), F.lit("unknown"))).otherwise(c("measure"))
    holds = F.when(c("code") == "margin_holds", F.coalesce("gross_margin", F.lit(0.0))).otherwise(c("value"))
    return out.withColumns({"measure": built, "value": holds})
