"""Countries: data coverage, adoption levels, similarity of markets, gaps to leaders, exchange rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the facts that a profile is complete with.
FACTS = {"population": 1.0, "gdp_per_capita_ppp": 1.5, "currency": 0.5, "internet_penetration": 1.0, "ecommerce_maturity": 1.0, "digital_adoption": 1.0, "business_formation_days": 1.0, "import_restrictions": 1.5, "customs_environment": 1.0, "relevant_taxes": 1.0, "logistics_performance": 1.0, "payment_infrastructure": 1.0, "regulatory_environment": 1.0, "key_industries": 1.0, "labour_cost_index": 1.0, "electricity_reliability": 1.0, "trade_partners": 1.0}


def latest_facts(facts: DataFrame) -> DataFrame:
    """The newest fact of each country and key, by partial aggregates."""
    return facts.groupBy("country", "key").agg(F.max_by(F.struct(*facts.columns), "as_of").alias("f")).select("f.*")


def coverage(facts: DataFrame, series: DataFrame, as_of: str) -> DataFrame:
    """country, coverage 0-100: half what the facts (country, key, as_of, confidence, status) are worth,
    the rest how many series and sources (country, series, source_id) there are."""
    weights = facts.sparkSession.createDataFrame(list(FACTS.items()), "key string, weight double")
    fresh = F.when(F.datediff(F.lit(as_of).cast("date"), "as_of") <= 1095, 1.0).otherwise(0.5)
    worth = F.col("weight") * fresh * F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("confidence")))
    earned = latest_facts(facts).filter("status = 'measured'").join(F.broadcast(weights), "key").groupBy("country").agg((F.sum(worth) / sum(FACTS.values())).alias("share"))  # 17 weights
    seen = series.groupBy("country").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))
    both = earned.join(seen, "country", "full")
    part = lambda c, most: F.least(F.lit(1.0), F.coalesce(c, F.lit(0)) / most)
    value = 100 * (0.5 * F.coalesce("share", F.lit(0.0)) + 0.3 * part(F.col("n"), 20) + 0.2 * part(F.col("sources"), 5))
    return both.select("country", F.round(F.least(F.lit(100.0), F.round(value, 9)), 1).alias("coverage")).withColumn("is_low", F.col("coverage") < 40)


def level(growth: Column, measured: Column) -> Column:
    """Band of an adoption growth; null where nothing was measured, which is not 'none'."""
    return F.when(measured & growth.isNotNull(), F.when(growth >= 60, "high").when(growth >= 25, "growing").when(growth >= 8, "emerging").when(growth > 0, "low").otherwise("none"))


def confidence_penalty(readings: DataFrame, low: float = 40.0) -> DataFrame:
    """subject, penalty up to 30 for markets that weren't measured or have low coverage."""
    n, seen, poor = F.count("*"), F.count_if(F.col("status") == "measured"), F.count_if(F.col("data_coverage") < low)
    return readings.groupBy("subject").agg(F.round(F.least(F.lit(30.0), 30 * (1 - seen / n) + F.least(F.lit(10.0), 2.0 * poor)), 2).alias("penalty"))


def market_similarity(markets: DataFrame, keys: list[str], target: str) -> DataFrame:
    """country, similarity to the target: mean of 1 - |a - b| over the facts that both have."""
    t = markets.filter(F.col("country") == target).select(*[F.col(k).alias(f"t_{k}") for k in keys]).limit(1)
    gaps = F.array_compact(F.array(*[1 - F.abs(F.col(k) - F.col(f"t_{k}")) for k in keys]))
    near = F.when(F.size(gaps) > 0, F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(gaps))
    return markets.filter(F.col("country") != target).crossJoin(F.broadcast(t)).select("country", F.round(near, 4).alias("similarity"))  # one row


def leader_gap(readings: DataFrame, measure: str) -> DataFrame:
    """For each market of a subject, its measure against the mean of all other measured markets: the
    subject's sum and count less its own row, so no market is paired with every other."""
    w = Window.partitionBy("subject")
    total, known = F.sum(measure).over(w), F.count(measure).over(w)
    own = F.col(measure)
    others = (total - F.coalesce(own, F.lit(0.0))) / F.nullif(known - own.isNotNull().cast("int"), F.lit(0))
    return readings.withColumn("leaders", F.round(others, 4)).withColumn("gap", F.round(others - own, 4) + 0.0)


def rate_as_of(needs: DataFrame, rates: DataFrame) -> DataFrame:
    """rates_at() for each id: where several needs have one id, they get the newest of their rates."""
    best = F.max_by("rate", F.struct(-F.col("inverse"), F.col("rated")))
    hits = rates_at(needs, rates).filter("rated is not null").groupBy("id").agg(best.alias("rate"))
    return needs.join(hits, "id", "left").withColumn("rate", F.when(F.col("base") == F.col("quote"), 1.0).otherwise(F.col("rate")))


def rates_at(needs: DataFrame, rates: DataFrame) -> DataFrame:
    """Every row of needs (base, quote, as_of) with the newest rate then: direct, else the inverse, 1 for
    equal currencies, null without any; rated is its time, inverse is 1 if it was turned. Of several rates
    of a pair at one time, the least.

    Rates and needs are ordered together, so that no need meets all rates of its pair; a pair is split by
    days, and what a day starts with is carried over from the last rates of the days before."""
    known = rates.filter(F.col("as_of").isNotNull()).groupBy("base", "quote", "as_of").agg(F.min("rate").cast("double").alias("rate")).withColumn("rated", F.col("as_of").cast("timestamp"))
    some, none = lambda turn: F.struct("rate", F.col("rated"), F.lit(turn).alias("inverse")), F.lit(None).cast("struct<rate:double,rated:timestamp,inverse:int>")
    need = F.lit(None).cast(needs.select(F.struct(*needs.columns).alias("need")).schema["need"].dataType)
    direct = known.select("base", "quote", "as_of", need.alias("need"), some(0).alias("direct"), none.alias("inverse"))
    turned = known.withColumn("rate", (1 / F.nullif("rate", F.lit(0.0))).cast("double")).select(F.col("quote").alias("base"), F.col("base").alias("quote"), "as_of", need.alias("need"), none.alias("direct"), some(1).alias("inverse"))
    asked = needs.select("base", "quote", "as_of", F.struct(*needs.columns).alias("need"), none.alias("direct"), none.alias("inverse"))
    rows = asked.union(direct).union(turned).withColumn("day", F.to_date("as_of"))
    keys, kinds = ["base", "quote", "day"], ("direct", "inverse")
    at = Window.partitionBy(*keys).orderBy("as_of").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("base", "quote").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select(*keys, "need", *(F.last(k, True).over(at).alias(k) for k in kinds)).filter("need is not null")
    closing = rows.groupBy(*keys).agg(*(F.max_by(k, F.when(F.col(k).isNotNull(), F.col("as_of"))).alias(k) for k in kinds))
    carried = closing.select(*keys, *(F.last(k, True).over(before).alias(f"{k}_before") for k in kinds))
    hit = F.coalesce("direct", "direct_before", "inverse", "inverse_before")
    return inside.join(carried, keys, "left").select("need.*", hit["rate"].alias("rate"), hit["rated"].alias("rated"), hit["inverse"].alias("inverse")).withColumn("rate", F.when(F.col("base") == F.col("quote"), 1.0).otherwise(F.col("rate")))


def localization(readings: DataFrame, similar: DataFrame, least_similar: float = 0.6, least_gap: float = 25.0) -> DataFrame:
    """Markets that a subject is weak in though it is strong in similar ones.

    readings: subject, country, status, growth (null: not measured); similar: country, other, similarity.
    Weak is checked and empty, or growing under 8; a market without data is no candidate. Of the similar
    strong markets the most similar is named."""
    strong = readings.filter((F.col("status") == "measured") & (F.col("growth") >= 25)).select("subject", F.col("country").alias("other"), F.col("growth").alias("other_growth"))
    weak = readings.filter((F.col("status") == "no_signal") | ((F.col("status") == "measured") & (F.col("growth") < 8))).select("subject", "country", F.coalesce("growth", F.lit(0.0)).alias("growth"))
    pairs = weak.join(similar.filter(F.col("similarity") >= least_similar), "country").join(strong, ["subject", "other"])
    best = pairs.groupBy("subject", "country").agg(F.max_by(F.struct("other", "similarity", (F.col("other_growth") - F.col("growth")).alias("gap")), F.struct("similarity", "other")).alias("b"))
    return best.filter(F.col("b.gap") >= least_gap).select("subject", "country", F.col("b.other").alias("model"), F.round("b.similarity", 4).alias("similarity"), F.round("b.gap", 4).alias("gap"))


# Most points of what carries over from one market to another.
TRANSFER = {"purchasing_power": 20, "infrastructure": 20, "regulation": 15, "logistics": 15, "language": 10, "headroom": 20}


def transferability(targets: DataFrame) -> DataFrame:
    """targets: one row for each subject and country with source means (s_*), own facts (purchasing_power,
    infrastructure, regulation, logistics; null: not stored), language, s_languages and gap. score is
    null where fewer than three dimensions have evidence: then nothing can be said."""
    parts = []
    for name in ("purchasing_power", "infrastructure", "regulation", "logistics"):
        own, source = F.col(name), F.col(f"s_{name}")
        share = F.when(source > 0, F.least(F.lit(1.0), own / source)).otherwise(0.0)
        parts.append(F.when(own.isNotNull() & source.isNotNull(), F.round(F.round(TRANSFER[name] * share, 9), 2)).otherwise(0.0))
    known = F.col("language").isNotNull() & (F.size("s_languages") > 0)
    parts.append(F.when(known, F.when(F.array_contains("s_languages", F.col("language")), 10.0).otherwise(3.0)).otherwise(0.0))
    parts.append(F.round(F.round(TRANSFER["headroom"] * F.least(F.lit(1.0), F.col("gap") / 100), 9), 2))
    total = sum(parts, F.lit(0.0))
    seen = sum(((p > 0).cast("int") for p in parts), F.lit(0))
    return targets.withColumn("evidenced", seen).withColumn("score", F.when(seen >= 3, F.round(F.least(F.lit(100.0), F.round(total, 9)), 1)))
