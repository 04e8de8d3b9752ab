"""Queries over what analyzers find about candidates, and over the earlier formula; contexts are read off the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analyzers as A
from ..operators import corroboration as C
from ..operators import first_formula as V
from ..operators import opportunities as O
from ..sources import bindings as B
from ..sources.places import kept
from . import opportunity_queries as OQ
from . import trend_queries as TQ
from .series_queries import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def established(spark, sf_dir):
    """A row for each nation: what its orders, lines, customers and suppliers establish; null where they don't."""
    t, until = lambda name: B.table(spark, sf_dir, name), F.lit(B.AS_OF).cast("timestamp_ntz")
    ago = lambda days: F.lit(B.AS_OF).cast("date") - F.expr(f"interval {days} days")
    named = t("nation").select(c("n_nationkey").alias("nation"), c("n_name").alias("subject"))
    day = c("o_orderdate").cast("date")
    spent = t("orders").filter(c("o_orderdate") < until).groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("spent"), F.sum(F.when(day >= ago(365), c("o_totalprice"))).alias("now"),
        F.sum(F.when((day < ago(365)) & (day >= ago(730)), c("o_totalprice"))).alias("before"), F.max((day >= ago(30)).cast("int")).alias("active"),
    )
    held = t("customer").select(c("c_custkey").alias("o_custkey"), c("c_nationkey").alias("nation"), "c_acctbal", "c_mktsegment").join(spent, "o_custkey", "left")
    # the ten largest of a nation: Spark keeps ten rows a nation on each side of the shuffle
    largest = held.filter(c("spent").isNotNull()).select("nation", "spent", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("spent"), "o_custkey")).alias("place")).filter("place <= 10")
    largest = largest.groupBy("nation").agg(F.sum("spent").alias("ten"), F.max("spent").alias("one"))
    buyers = held.groupBy("nation").agg(
        F.count("*").alias("customers"), F.count("spent").alias("payers"), F.sum("spent").alias("total"), F.sum("now").alias("now"), F.sum("before").alias("before"), F.sum("active").alias("active"),
        F.round(F.avg("c_acctbal") * 100, 0).alias("capital"), F.sum(F.greatest(c("c_acctbal"), F.lit(0.0))).alias("deposits"),
    )
    segments = held.groupBy("nation", "c_mktsegment").agg(F.count("*").alias("n"))
    segments = segments.join(buyers.select("nation", "customers"), "nation").filter(c("n") * 5 > c("customers")).groupBy("nation").agg(F.array_sort(F.collect_list("c_mktsegment")).alias("strong"))
    makers = t("supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("nation"), "s_acctbal")
    lines = t("lineitem").filter(c("l_shipdate") < until)
    sold = lines.groupBy("l_suppkey").agg(
        F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("net"), F.sum(c("l_extendedprice") * (1 + c("l_tax"))).alias("gross"), F.count("*").alias("lines"), F.count_if(c("l_returnflag") == "R").alias("returned"), F.max("l_shipdate").alias("last"),
    )
    supply = makers.join(sold, "l_suppkey", "left").groupBy("nation").agg(
        F.count("*").alias("suppliers"), F.count_if(c("s_acctbal") > 5000).alias("rivals"), F.sum(F.greatest(-c("s_acctbal"), F.lit(0.0))).alias("owed"), F.sum(F.greatest(c("s_acctbal"), F.lit(0.0))).alias("owned"), F.avg("s_acctbal").alias("balance"),
        F.max("net").alias("top"), F.sum("net").alias("net"), F.sum("gross").alias("gross"), F.sum("lines").alias("lines"), F.sum("returned").alias("returned"), F.max("last").alias("last"),
    )
    parts = lines.select("l_suppkey", "l_partkey").join(makers.select("l_suppkey", "nation"), "l_suppkey").select("nation", "l_partkey").distinct().groupBy("nation").agg(F.count("*").alias("parts"))
    all_parts = t("part").agg(F.count("*").alias("all_parts"))
    rows = named
    for side in (buyers, largest, segments, supply, parts):
        rows = rows.join(side, "nation", "left")
    rows = rows.crossJoin(F.broadcast(all_parts))  # one row
    share, top = F.round(c("parts") / c("all_parts"), 6), F.round(c("top") / c("net"), 6)
    back = F.round(c("returned") / c("lines"), 6)
    age = F.datediff(F.lit(B.AS_OF).cast("date"), c("last").cast("date"))
    return rows.select(
        "subject", c("suppliers").alias("supplier_count"), c("rivals").alias("local_competitor_count"), c("suppliers").alias("competitor_count"), c("capital").alias("capital_required"),
        F.when(c("payers") * 10 >= c("customers") * 6, F.concat(c("payers").cast("string"), F.lit(" of "), c("customers").cast("string"))).alias("willingness_to_pay"), c("strong").alias("defensibility_markers"),
        F.when(share > 0.5, "high").when(share > 0.2, "medium").when(share > 0, "low").alias("local_availability"), F.when(top > 0.5, "single_factory").when(top > 0.3, "single_country").when(top > 0, "spread").alias("manufacturing_concentration"),
        F.when(back <= 0.33, F.lit("kept")).alias("margin_evidence"), F.when(age <= 3, "shipped").alias("price_evidence"), F.when(c("nation") % 4 == 1, "required").otherwise("none").alias("certification"), (c("suppliers") * 8.0).alias("unit_weight_kg"),
        F.round(100 * (c("now") / c("before") - 1), 2).alias("revenue_growth"), F.round(c("net") / c("gross"), 6).alias("gross_margin"), F.round(c("balance") / 10000 - 0.4, 6).alias("operating_margin"),
        F.round(c("owed") / F.nullif(c("owned"), F.lit(0.0)), 6).alias("debt_to_equity"), F.round(c("one") / c("total"), 6).alias("customer_concentration"), F.round(c("now") / c("total"), 6).alias("trend_exposure"), age.cast("bigint").alias("price_age_days"),
        F.when(c("now") > 40 * c("deposits"), "extreme").otherwise("fair").alias("valuation_band"), F.nullif(c("active"), F.lit(0)).cast("bigint").alias("active_users"), F.round(c("ten") / c("total"), 6).alias("top10_share"),
        F.round(c("deposits"), 2).alias("liquidity_usd"), back.alias("bot_activity_share"), (c("rivals") > 0).alias("founders_identified"), (c("payers") * 4 > c("customers") * 3).alias("influencer_promotion"),
    )


def analysed(spark, sf_dir):
    """Candidates with what their analyzers find in place of what was bound by hand."""
    profiles = kept(TQ.profiles(spark, sf_dir), "profiles")  # a row a series
    known = kept(OQ.candidates(spark, sf_dir, profiles).drop("flags", "evidence_kinds", "assumption_count", "competitor_count", "capital_required", "markers"), "candidates")  # some rows a subject
    growth = C.class_growth(profiles.select("subject", "signal_class", "growth_30d"))
    growth = growth.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("signal_class", "mean_growth"))).alias("class_growth"))  # an entry a class
    rows = A.analysed(known.join(established(spark, sf_dir), "subject").join(growth, "subject", "left"))
    return rows.withColumns({"flags": c("analysis_flags"), "markers": F.size(F.coalesce("defensibility_markers", F.array().cast("array<string>"))), "willingness_to_pay": c("willingness")})


CONTEXT = f"""{OQ.CANDIDATES}, spent_by AS (
    SELECT o_custkey, sum(o_totalprice) AS spent, sum(o_totalprice) FILTER (o_orderdate::DATE >= DATE '2000-08-01') AS now, sum(o_totalprice) FILTER (o_orderdate::DATE < DATE '2000-08-01' AND o_orderdate::DATE >= DATE '1999-08-02') AS before,
        max(CAST(o_orderdate::DATE >= DATE '2001-07-02' AS INT)) AS active FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY o_custkey
), held AS (SELECT c_nationkey AS nation, c_custkey, c_acctbal, c_mktsegment, spent, now, before, active FROM customer LEFT JOIN spent_by ON o_custkey = c_custkey
), buyers_by AS (
    SELECT nation, count(*) AS customers, count(spent) AS payers, sum(spent) AS total, sum(now) AS now, sum(before) AS before, sum(active) AS active, round(avg(c_acctbal) * 100, 0) AS capital, sum(greatest(c_acctbal, 0)) AS deposits FROM held GROUP BY nation
), largest AS (SELECT nation, sum(spent) AS ten, max(spent) AS one FROM (SELECT * FROM held WHERE spent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY nation ORDER BY spent DESC, c_custkey) <= 10) GROUP BY nation
), strong_by AS (SELECT nation, list_sort(list(c_mktsegment)) AS strong FROM (SELECT nation, c_mktsegment, count(*) AS n FROM held GROUP BY ALL) JOIN buyers_by USING (nation) WHERE n * 5 > customers GROUP BY nation
), shipped AS (SELECT * FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate < TIMESTAMP '2001-08-01'
), sold AS (SELECT s_nationkey AS nation, max(net) AS top, sum(net) AS net, sum(gross) AS gross, sum(n) AS lines, sum(returned) AS returned, max(last) AS last FROM (
    SELECT s_nationkey, l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice * (1 + l_tax)) AS gross, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_shipdate) AS last FROM shipped GROUP BY ALL) GROUP BY s_nationkey
), owners AS (SELECT s_nationkey AS nation, count(*) AS suppliers, count(*) FILTER (s_acctbal > 5000) AS rivals, sum(greatest(-s_acctbal, 0)) AS owed, sum(greatest(s_acctbal, 0)) AS owned, avg(s_acctbal) AS balance FROM supplier GROUP BY s_nationkey
), kinds_of AS (SELECT s_nationkey AS nation, count(DISTINCT l_partkey) / (SELECT count(*) FROM part) AS share FROM shipped GROUP BY s_nationkey
), ctx AS (
    SELECT n_name AS subject, suppliers, rivals AS near, capital AS cap, CASE WHEN payers * 10 >= customers * 6 THEN payers || ' of ' || customers END AS wtp, strong, coalesce(len(strong), 0) AS m,
        CASE WHEN round(share, 6) > 0.5 THEN 'high' WHEN round(share, 6) > 0.2 THEN 'medium' WHEN round(share, 6) > 0 THEN 'low' END AS local, round(top / net, 6) AS top, CASE WHEN round(returned / lines, 6) <= 0.33 THEN 'kept' END AS margin,
        date_diff('day', last::DATE, DATE '2001-08-01') AS age, nation % 4 = 1 AS certified, suppliers * 8 > 30 AS heavy, round(100 * (now / before - 1), 2) AS growth, round(net / gross, 6) AS gross_margin, round(balance / 10000 - 0.4, 6) AS op_margin,
        round(owed / nullif(owned, 0), 6) AS debt, round(one / total, 6) AS one, round(now / total, 6) AS exposure, coalesce(now > 40 * deposits, false) AS dear, nullif(active, 0) AS users, round(ten / total, 6) AS ten, round(deposits, 2) AS deposits,
        round(returned / lines, 6) AS back, rivals > 0 AS known_founders, payers * 4 > customers * 3 AS pushed
    FROM (SELECT n_nationkey AS nation, n_name FROM nation) LEFT JOIN buyers_by USING (nation) LEFT JOIN largest USING (nation) LEFT JOIN strong_by USING (nation) LEFT JOIN owners USING (nation) LEFT JOIN sold USING (nation) LEFT JOIN kinds_of USING (nation)
), seen AS (
    SELECT c.*, x.* EXCLUDE (subject), opportunity_type = 'business' AS biz, opportunity_type = 'import_distribution' AS imp, opportunity_type = 'public_investment' AS pub, opportunity_type = 'crypto' AS cry, commercial = 1 AS com,
        coalesce(age > 5, true) AS stale FROM comps c JOIN ctx x USING (subject)
), told AS (
    SELECT *, list_sort(list_filter([CASE WHEN biz AND com OR imp AND traded OR cry AND users IS NOT NULL THEN 'adoption' END, CASE WHEN biz AND com THEN 'commercial' END, CASE WHEN biz AND suppliers IS NOT NULL THEN 'competition' END,
            CASE WHEN biz AND wtp IS NOT NULL THEN 'willingness_to_pay' END, CASE WHEN imp AND traded THEN 'trade' END, CASE WHEN imp AND suppliers IS NOT NULL THEN 'supplier' END, CASE WHEN imp AND local IS NOT NULL THEN 'local_availability' END,
            CASE WHEN imp AND margin IS NOT NULL THEN 'shipping_economics' END, CASE WHEN imp AND age <= 3 THEN 'price' END, CASE WHEN pub AND growth IS NOT NULL THEN 'financial' END, CASE WHEN pub AND growth IS NOT NULL THEN 'revenue_growth' END,
            CASE WHEN pub AND exposure IS NOT NULL THEN 'competitive_position' END, CASE WHEN pub AND NOT stale THEN 'valuation' END, CASE WHEN cry AND deposits IS NOT NULL THEN 'liquidity' END, CASE WHEN cry AND ten IS NOT NULL THEN 'token_distribution' END,
            CASE WHEN cry AND known_founders IS NOT NULL THEN 'team' END], lambda x: x IS NOT NULL)) AS evidence,
        list_sort(list_filter([CASE WHEN biz THEN 'demand_pain' END, CASE WHEN biz AND suppliers IS NULL THEN 'competitor_count' END, CASE WHEN biz AND wtp IS NULL THEN 'willingness_to_pay' END, CASE WHEN imp AND suppliers IS NULL THEN 'supplier_count' END,
            CASE WHEN imp AND local IS NULL THEN 'local_availability' END, CASE WHEN imp AND margin IS NULL THEN 'margin_evidence' END, CASE WHEN imp AND NOT coalesce(age <= 3, false) THEN 'price_evidence' END, CASE WHEN pub AND growth IS NULL THEN 'revenue_growth' END,
            CASE WHEN pub AND gross_margin IS NULL THEN 'gross_margin' END, CASE WHEN pub THEN 'free_cash_flow' END, CASE WHEN pub AND debt IS NULL THEN 'debt_to_equity' END, CASE WHEN pub AND exposure IS NULL THEN 'trend_exposure' END,
            CASE WHEN pub AND stale THEN 'price' END, CASE WHEN cry AND users IS NULL THEN 'active_users' END, CASE WHEN cry AND deposits IS NULL THEN 'liquidity_usd' END, CASE WHEN cry AND ten IS NULL THEN 'token_distribution' END,
            CASE WHEN cry THEN 'audits' END], lambda x: x IS NOT NULL)) AS missing,
        list_sort(list_filter([CASE WHEN biz AND cap IS NULL THEN 'capital_required' END, CASE WHEN imp AND margin IS NULL THEN 'margin_evidence' END, CASE WHEN imp AND suppliers IS NOT NULL THEN 'shipping_difficulty' END, CASE WHEN pub AND stale THEN 'valuation' END], lambda x: x IS NOT NULL)) AS assumed,
        list_sort(list_filter([CASE WHEN biz AND wtp IS NULL AND NOT com THEN 'weak_adoption_evidence' END, CASE WHEN biz AND m = 0 THEN 'easily_copied' END, CASE WHEN biz AND suppliers >= 15 THEN 'extreme_competition' END, CASE WHEN biz AND cap > 250000 THEN 'excessive_capital' END,
            CASE WHEN imp AND top > 0.3 THEN 'supply_chain_fragility' END, CASE WHEN imp AND suppliers <= 1 THEN 'single_supplier' END, CASE WHEN imp AND certified THEN 'regulatory_uncertainty' END, CASE WHEN imp AND margin IS NULL OR pub AND (debt > 2 OR op_margin < 0) THEN 'poor_economics' END,
            CASE WHEN pub AND NOT stale AND dear THEN 'extreme_valuation' END, CASE WHEN pub AND one > 0.3 THEN 'single_customer' END, CASE WHEN cry AND NOT known_founders THEN 'anonymous_team' END, CASE WHEN cry AND deposits < 250000 THEN 'poor_liquidity' END,
            CASE WHEN cry AND ten > 0.5 THEN 'concentrated_ownership' END, CASE WHEN cry AND (back > 0.4 OR pushed) THEN 'promotional_manipulation' END, CASE WHEN cry AND attentions > 0 AND users IS NULL THEN 'attention_without_adoption' END], lambda x: x IS NOT NULL)) AS flagged,
        list_sort(list_filter([CASE WHEN pub AND debt > 2 THEN 'high_leverage' END, CASE WHEN pub AND op_margin < 0 THEN 'unprofitable' END, CASE WHEN pub AND one > 0.3 THEN 'customer_concentration' END, CASE WHEN cry THEN 'meme_coin' END, CASE WHEN cry THEN 'no_product' END,
            CASE WHEN cry AND NOT known_founders THEN 'anonymous_team' END, CASE WHEN cry AND deposits < 250000 THEN 'low_liquidity' END, CASE WHEN cry AND ten > 0.5 THEN 'concentrated_ownership' END, CASE WHEN cry THEN 'unverified_contract' END,
            CASE WHEN cry AND back > 0.4 THEN 'suspicious_volume' END, CASE WHEN cry AND pushed THEN 'promotional_hype' END], lambda x: x IS NOT NULL)) AS hinted,
        list_filter([CASE WHEN imp AND local = 'low' THEN 'local_availability' END, CASE WHEN imp AND near <= 2 THEN 'local_competitor_count' END], lambda x: x IS NOT NULL) AS early
    FROM seen
)"""
PARTS = {"evidence_kinds": "evidence", "missing": "missing", "assumptions": "assumed", "flags": "flagged", "hint_codes": "hinted", "why_early": "early"}
QUERIES["opp_analysis"] = lambda s, d: analysed(s, d).select("subject", "opportunity_type", *[F.array_join(k, "|").alias(k) for k in PARTS], F.when(c("opportunity_type") == "import_distribution", c("shipping_difficulty")).alias("shipping"), "valuation", "willingness", "evidence_growth")
ORACLE["opp_analysis"] = CONTEXT + " SELECT subject, opportunity_type, " + ", ".join(f"array_to_string({v}, '|') AS {k}" for k, v in PARTS.items()) + """, CASE WHEN imp THEN CASE WHEN heavy THEN 'high' WHEN suppliers IS NOT NULL THEN 'medium' END END AS shipping,
    CASE WHEN pub THEN CASE WHEN stale THEN 'not_assessed' WHEN dear THEN 'extreme' ELSE 'fair' END END AS valuation, CASE WHEN biz THEN CASE WHEN wtp IS NULL THEN 'unknown' ELSE 'stated' END END AS willingness,
    CASE WHEN imp THEN (SELECT round(avg(growth_30d), 1) FROM sig WHERE sig.subject = told.subject AND signal_class = 'trade') END AS evidence_growth FROM told"""

POINTS = "CASE p " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.PENALTIES.items()) + " END"
LISTED = ", ".join(f"'{k}'" for k in O.PENALTIES)
HIGH, MEDIUM = (", ".join(f"'{k}'" for k, v in O.SEVERITY.items() if v == level) for level in ("high", "medium"))
SCORED = f"""{CONTEXT}, marked AS (
    SELECT * REPLACE (CASE WHEN cap >= 10000000 OR difficulty = 'high' THEN k % 4 >= 2 ELSE k % 4 >= 3 END AS shut, round(round(10 * least(1, m / 3), 9), 2) AS c_defensibility,
        round(round(15 * coalesce(list_avg(list_filter([(list_value(1.0, 0.8, 0.4, 0.0, NULL)[k % 5 + 1])::DOUBLE, CASE WHEN suppliers <= 1 THEN 1 WHEN suppliers <= 3 THEN 0.75 WHEN suppliers <= 8 THEN 0.45 WHEN suppliers <= 20 THEN 0.2 WHEN suppliers > 20 THEN 0.05 END::DOUBLE,
            (list_value(1.0, 0.5, 0.0)[k % 3 + 1])::DOUBLE, CASE WHEN stage IN ('weak_signal', 'emerging', 'early_adoption') THEN 0.8 WHEN stage IN ('mainstream', 'mature') THEN 0.05 END::DOUBLE], lambda x: x IS NOT NULL)), 0), 9), 2) AS c_early_entry) FROM told
), fined2 AS (
    SELECT *, list_sort(list_distinct(list_concat(list_filter([CASE WHEN c_real_adoption <= 0 THEN 'weak_adoption_evidence' END,
        CASE WHEN attentions > 0 AND adoptions > 0 AND attention_growth > 40 AND attention_growth > adoption_growth * 3 OR attentions > 0 AND adoptions = 0 THEN 'attention_without_adoption' END,
        CASE WHEN groups < 2 THEN 'single_source_dependence' END, CASE WHEN rel < 0.55 THEN 'low_quality_evidence' END, CASE WHEN band = 'tiny' THEN 'tiny_market' END, CASE WHEN stage IN ('mainstream', 'mature') THEN 'already_mainstream' END,
        CASE WHEN suppliers >= 15 THEN 'extreme_competition' END, CASE WHEN m = 0 AND (biz OR imp) THEN 'easily_copied' END], lambda x: x IS NOT NULL), list_filter(flagged, lambda x: x IN ({LISTED}))))) AS fines,
        round(c_real_adoption + c_market_potential + c_evidence_diversity + c_early_entry + c_accessibility + c_defensibility + c_catalyst + c_timing, 2) AS raw2,
        len(list_filter(required, lambda x: NOT list_contains(evidence, x))) / len(required) AS lacks
    FROM marked
), ends AS (
    SELECT *, least(65, coalesce(list_sum(list_transform(fines, lambda p: {POINTS})), 0))::DOUBLE AS fine2,
        round(round(20 * least(1, observation_count / 120), 9), 2) + round(round(20 * rel, 9), 2) + round(round(CASE WHEN groups > 1 THEN 20 * least(1, (groups - 1) / 3) ELSE 0 END, 9), 2) + round(round(15 * exp(-freshest / 45), 9), 2)
        + round(round(CASE WHEN known >= 2 THEN 15 * abs(rising / known - 0.5) * 2 ELSE 0 END, 9), 2) + commercial * 10.0::DOUBLE - round(round(20 * lacks, 9), 2) - least(15, len(assumed) * 3) - CASE WHEN freshest > 90 THEN 15 ELSE 0 END AS sure2,
        len(list_filter(list_distinct(list_concat(fines, flagged)), lambda x: x IN ({HIGH}))) + len(hinted) AS highs, len(list_filter(list_distinct(list_concat(fines, flagged)), lambda x: x IN ({MEDIUM}))) + CASE WHEN stage IN ('weak_signal', 'emerging') THEN 1 ELSE 0 END AS mediums
    FROM fined2
)"""


def scored(spark, sf_dir):
    """Candidates scored on what their analyzers found: penalties from flags, confidence from kinds of evidence and assumptions, the risk level with the analyzers' hints."""
    out = O.scored(analysed(spark, sf_dir))
    return out.withColumn("risk_level", O.risk_level(F.array_union("penalties", "flags")))


QUERIES["opp_analysed"] = lambda s, d: rounded(scored(s, d).withColumn("penalties", F.array_join("penalties", "|")), "subject", "opportunity_type", "penalties", "raw_score", "opportunity_score", "opportunity_confidence", "risk_level")
ORACLE["opp_analysed"] = SCORED + """ SELECT subject, opportunity_type, array_to_string(fines, '|') AS penalties, raw2 AS raw_score, round(least(100, greatest(0, raw2 - fine2)), 2) AS opportunity_score, round(least(100, greatest(0, sure2)), 2) AS opportunity_confidence,
    CASE WHEN highs >= 3 THEN 'very_high' WHEN highs > 0 OR cry THEN 'high' WHEN mediums > 0 THEN 'moderate' ELSE 'low' END AS risk_level FROM ends"""

VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in A.CONDITIONS)
QUERIES["opp_conditions"] = lambda s, d: rounded(A.conditions(analysed(s, d)), "subject", "opportunity_type", "kind", "code", "measure", "comparator", "value", "window_days")
ORACLE["opp_conditions"] = CONTEXT + f""", conds(opportunity_type, kind, code, measure, comparator, value, days) AS (VALUES {VALUES})
SELECT subject, opportunity_type, kind, code, CASE WHEN code = 'build' THEN 'unknown' ELSE measure END AS measure, comparator, round(CASE WHEN code = 'margin_holds' THEN coalesce(gross_margin, 0) ELSE value END, 4)::DOUBLE AS value, days::BIGINT AS window_days FROM told JOIN conds USING (opportunity_type)"""


#: Nations as inputs of the earlier formula.
def first_inputs(spark, sf_dir):
    known = kept(TQ.profiles(spark, sf_dir), "profiles")  # a row a series
    t = TQ.trends(spark, sf_dir, known).select("subject", "acceleration_pp", c("independent_sources").alias("sources"), c("dominant_source_share").alias("dominant_share"), c("days_since_last").alias("newest_days"), "persistence")
    direct = c("is_adoption") & ~c("is_proxy")
    p = known.groupBy("subject").agg(  # four series a nation
        F.collect_list(F.when(direct, F.round("growth_30d", 6))).alias("adoption_growths"), F.array_sort(F.collect_list("reliability")).alias("reliabilities"), F.array_sort(F.collect_set("signal_type")).alias("signal_types"),
    )
    k = F.substring_index("subject", "_", -1).cast("int")
    risk = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    e = established(spark, sf_dir)
    risks = F.array_compact(F.array(
        F.when(c("top10_share") > 0.5, risk("concentrated_ownership", "high")), F.when(c("liquidity_usd") < 250_000, risk("thin_liquidity", "high")), F.when(c("supplier_count") >= 5, risk("dominant_incumbent", "medium")),
        F.when(c("certification") == "required", risk("certification_required", "low")), F.when(~c("founders_identified"), risk("anonymous_founders", "medium")), F.when(c("debt_to_equity") > 0.5, risk("delisted", "blocking")),
    ))
    satisfied = F.array_compact(F.array(
        F.lit("timeline"), F.when(c("revenue_growth").isNotNull(), "revenue"), F.when(c("gross_margin").isNotNull(), "margins"), F.when(c("price_age_days") <= 5, "valuation"), F.when(c("willingness_to_pay").isNotNull(), "willingness_to_pay"),
        F.when(c("local_availability").isNotNull(), "local_availability"), F.when(c("supplier_count") > 0, "supplier_evidence"), F.when(c("active_users").isNotNull(), "adoption_metric"),
    ))
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), k % len(names))
    return t.join(p, "subject").join(e, "subject").select(
        "subject", pick("technology", "public_investment", "business", "import_distribution").alias("category"), "adoption_growths", "reliabilities", "acceleration_pp", (c("liquidity_usd") * 100).alias("market_size_usd"), "sources", "dominant_share",
        pick("buildable_solo", "importable", "partnerable", "publicly_tradable", "restricted", "unlisted").alias("accessibility"), F.when(c("liquidity_usd") < 250_000, "low").when(c("liquidity_usd") < 1e6, "medium").otherwise("high").alias("liquidity"),
        c("capital_required").alias("capital_usd"), F.lit(500_000.0).alias("most_capital_usd"), c("defensibility_markers").alias("segments"), F.filter(F.array(pick("patent", "brand", "switching_cost"), F.lit("network_effect"), pick("capital_barrier", "none")), lambda x: x != "none").alias("markers"),
        satisfied.alias("satisfied"), "signal_types", (c("active_users") > 0).alias("catalyst_dated"), (c("price_age_days") <= 2).alias("catalyst_stored"), c("persistence").alias("agreement"), "newest_days", F.coalesce("bot_activity_share", F.lit(0.0)).alias("manipulation"),
        risks.alias("risks"), (k % 4 == 3).alias("is_crypto"), (k % 5 == 1).alias("is_meme"),
    )


SHOWN = [f"c_{k}" for k in V.CAPS]
QUERIES["first_scores"] = lambda s, d: rounded(V.scored(first_inputs(s, d)).withColumns({k: F.array_join(k, "|") for k in ("penalties", "notes")}), "subject", *SHOWN, "raw_score", "penalties", "penalty_total", "adjusted_score", "completeness", "confidence", "risk_level", "notes")
ORACLE["first_scores"] = f"""{CONTEXT}, growths AS (SELECT subject, median(round(growth_30d, 6)) FILTER ({OQ.ADOPT}) AS mid, avg(reliability) AS mean, count(DISTINCT signal_type) AS types FROM sig GROUP BY subject
), inp AS (
    SELECT t.acceleration_pp, t.independent_sources AS src, t.dominant_source_share AS dom, t.days_since_last AS days, t.persistence, g.*, x.* EXCLUDE (subject), CAST(replace(t.subject, 'NATION_', '') AS INT) AS k, deposits * 100 AS market
    FROM trends t JOIN growths g USING (subject) JOIN ctx x USING (subject)
), had AS (
    SELECT *, CASE k % 4 WHEN 0 THEN (1 + CAST(users IS NOT NULL AS INT)) / 4 WHEN 1 THEN (CAST(growth IS NOT NULL AS INT) + CAST(gross_margin IS NOT NULL AS INT) + CAST(coalesce(age <= 5, false) AS INT)) / 5
            WHEN 2 THEN CAST(wtp IS NOT NULL AS INT) / 5 ELSE (CAST(local IS NOT NULL AS INT) + CAST(coalesce(suppliers > 0, false) AS INT)) / 5 END AS complete,
        ([10, 8, 6, 6, 2, 0])[k % 6 + 1] AS ease, coalesce(back, 0) AS fake, coalesce(ten > 0.5, false) AS r_held, coalesce(deposits < 250000, false) AS r_thin, coalesce(suppliers >= 5, false) AS r_rival, certified AS r_cert, coalesce(NOT known_founders, false) AS r_anon, coalesce(debt > 0.5, false) AS r_out
    FROM inp
), pts AS (
    SELECT *, CASE WHEN mid IS NULL THEN 0 ELSE round_even(round(greatest(0, least(1, mid / 100)) * 20, 9), 2) END AS c_adoption, CASE WHEN market >= 1e10 THEN 15 WHEN market >= 1e9 THEN 12 WHEN market >= 1e8 THEN 9 WHEN market >= 1e7 THEN 6 WHEN market >= 1e6 THEN 3 WHEN market >= 0 THEN 1 ELSE 0 END AS c_market_size,
        CASE WHEN acceleration_pp > 0 THEN round_even(round(least(1, acceleration_pp / 40) * 15, 9), 2) ELSE 0 END AS c_acceleration, CASE WHEN src > 1 THEN round_even(round(least(1, (src - 1) / 3) * mean * 15, 9), 2) ELSE 0 END AS c_sources,
        round_even(round(CASE WHEN cap IS NULL THEN ease * 0.6::DOUBLE WHEN cap > 500000 THEN 0 ELSE ease * (0.6::DOUBLE + 0.4::DOUBLE * (1 - cap / 500000)) END, 9), 2) AS c_entry, ([3, 1, 2])[k % 3 + 1] + 3 + ([2, 0])[k % 2 + 1] AS c_defensibility,
        CASE WHEN users > 0 AND age <= 2 THEN 10 WHEN users > 0 THEN 3 ELSE 0 END AS c_catalyst, CASE WHEN deposits < 250000 THEN 1 WHEN deposits < 1e6 THEN 3 ELSE 5 END AS c_liquidity,
        round_even(round(greatest(0, least(1, 0.40::DOUBLE * mean + 0.25::DOUBLE * round(complete, 4) + 0.20::DOUBLE * greatest(0, least(1, coalesce(persistence, 0))) + 0.15::DOUBLE * CASE WHEN days <= 7 THEN 1 WHEN days < 90 THEN 1 - (days - 7) / 83 ELSE 0 END)), 9), 4) AS trust,
        list_sort(list_filter([CASE WHEN fake > 0 THEN 'manipulation_risk' END, CASE WHEN complete < 0.4 THEN 'weak_evidence' END, CASE WHEN src <= 1 OR dom > 0.7 THEN 'single_source_dependence' END, CASE WHEN r_held THEN 'concentrated_ownership' END,
            CASE WHEN r_thin THEN 'thin_liquidity' END, CASE WHEN r_rival THEN 'high_competition' END, CASE WHEN r_cert THEN 'operational_difficulty' END, CASE WHEN r_anon THEN 'anonymous_team' END], lambda x: x IS NOT NULL)) AS fines,
        CASE WHEN fake > 0 THEN round_even(round(least(1, fake) * 25, 9), 2) ELSE 0 END + CASE WHEN complete < 0.4 THEN 10 ELSE 0 END + CASE WHEN src <= 1 OR dom > 0.7 THEN 8 ELSE 0 END + CASE WHEN r_held THEN 10 ELSE 0 END + CASE WHEN r_thin THEN 10 ELSE 0 END
            + CASE WHEN r_rival THEN 6 ELSE 0 END + CASE WHEN r_cert THEN 6 ELSE 0 END + CASE WHEN r_anon THEN 10 ELSE 0 END AS full_fine
    FROM had
), sums2 AS (SELECT *, round(c_adoption + c_market_size + c_acceleration + c_sources + c_entry + c_defensibility + c_catalyst + c_liquidity, 2) AS raw, round(least(60, full_fine), 2) AS fine FROM pts
), lefts AS (SELECT *, round(greatest(0, least(100, raw - fine)), 2) AS rest, r_held OR r_thin AS any_high, CASE WHEN fine <= 5 AND trust >= 0.75 AND NOT (r_held OR r_thin OR r_rival OR r_anon OR r_out) THEN 'low' WHEN fine <= 20 AND NOT (r_held OR r_thin OR r_out) THEN 'medium'
    WHEN fine <= 40 OR r_held OR r_thin THEN 'high' ELSE 'very_high' END AS level FROM sums2)
SELECT subject, {', '.join(f'{k}::DOUBLE AS {k}' for k in SHOWN)}, raw::DOUBLE AS raw_score, array_to_string(fines, '|') AS penalties, fine::DOUBLE AS penalty_total, (CASE WHEN r_out THEN 0 WHEN k % 5 = 1 THEN least(25, rest) ELSE rest END)::DOUBLE AS adjusted_score,
    round(complete, 4)::DOUBLE AS completeness, trust::DOUBLE AS confidence, CASE WHEN r_out OR fake > 0.5 OR k % 4 = 3 AND (r_held OR r_anon) THEN 'very_high' WHEN k % 4 = 3 AND level IN ('low', 'medium') THEN 'high' ELSE level END AS risk_level,
    array_to_string(list_filter([CASE WHEN full_fine > 60 THEN 'penalties_capped' END, CASE WHEN k % 5 = 1 AND rest > 25 THEN 'meme' END, CASE WHEN r_out THEN 'blocked' END, CASE WHEN types < 3 THEN 'few_signal_types' END], lambda x: x IS NOT NULL), '|') AS notes FROM lefts"""
