"""Markets against each other: facts on one scale, gaps to leading markets, tables of coverage.

Leaders of a market are all other markets of the same subject. Their means come from the subject's sums
and counts less the market's own row, so no market is paired with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geography import latest_facts, level, rates_at

c = F.col

# Fact, name on the common scale, its range, whether more is better.
SCALES = {
    "internet_penetration": ("internet_penetration", 0.0, 100.0, True),
    "payment_infrastructure": ("payment_infrastructure", 0.0, 100.0, True),
    "logistics_performance": ("logistics_performance", 1.0, 5.0, True),
    "electricity_reliability": ("electricity_reliability", 0.0, 100.0, True),
    "business_formation_days": ("business_formation_ease", 1.0, 120.0, False),
    "import_restrictions": ("import_openness", 0.0, 100.0, False),
    "regulatory_environment": ("regulatory_environment", 0.0, 100.0, True),
    "gdp_per_capita_ppp": ("purchasing_power", 500.0, 80_000.0, True),
}
# What each dimension of a gap is worth.
DIMENSIONS = {
    "adoption_gap": 22,
    "supply_gap": 15,
    "competition_gap": 13,
    "attention_gap": 10,
    "price_gap": 8,
    "infrastructure_readiness": 12,
    "regulatory_readiness": 10,
    "affordability": 6,
    "time_lag": 4,
}
INFRASTRUCTURE = ("internet_penetration", "payment_infrastructure", "logistics_performance", "electricity_reliability")
REGULATION = ("business_formation_ease", "import_openness", "regulatory_environment")
LEVELS = ("none", "low", "emerging", "growing", "high")


def _round(x: Column, digits: int) -> Column:
    return F.round(x + 1e-9, digits)


def normalise(facts: DataFrame) -> DataFrame:
    """Facts (key, value) that have a scale, with attribute and share: 0 to 1, 1 the better end; a figure
    out of its range counts as the range's end."""
    rows = [(k, name, low, high, better) for k, (name, low, high, better) in SCALES.items()]
    scales = facts.sparkSession.createDataFrame(rows, "key string, attribute string, low double, high double, better boolean")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("value") - c("low")) / (c("high") - c("low"))))
    found = facts.join(F.broadcast(scales), "key")  # eight scales
    return found.withColumn("share", _round(F.when(c("better"), share).otherwise(1 - share), 4)).drop("low", "high", "better")


def market_facts(facts: DataFrame) -> DataFrame:
    """country and a column for each attribute: the newest measured fact on its scale, null where there is none."""
    newest = latest_facts(facts).filter("status = 'measured' and value is not null")
    return normalise(newest).groupBy("country").pivot("attribute", [v[0] for v in SCALES.values()]).agg(F.first("share"))


def coverage_summary(readings: DataFrame, low: float = 40.0) -> DataFrame:
    """subject, how many of its markets were measured, checked in vain, never measured, poorly covered, and
    the penalty up to 30 for what could not be seen."""
    n, seen, poor = F.count("*"), F.count_if(c("status") == "measured"), F.count_if(c("data_coverage") < low)
    empty = F.count_if(c("status") == "no_signal")
    penalty = F.least(F.lit(30.0), 30 * (1 - seen / n) + F.least(F.lit(10.0), 2.0 * poor))
    return readings.groupBy("subject").agg(
        seen.alias("measured"),
        empty.alias("no_signal"),
        (n - seen - empty).alias("no_data"),
        poor.alias("low_coverage"),
        _round(penalty, 2).alias("penalty"),
    )


def coverage_table(coverage: DataFrame) -> DataFrame:
    """Countries with their place by coverage, the best first; ties by name. A row for each country of the world."""
    return coverage.withColumn("place", F.row_number().over(Window.orderBy(F.desc("coverage"), "country")))


def _others(measure: Column, counts: Column, *keys: str) -> Column:
    """The mean of `measure` over the other rows of the same keys for which `counts` holds."""
    w = Window.partitionBy(*keys)
    own = F.when(counts, measure)
    n = F.count(own).over(w) - own.isNotNull().cast("int")
    return (F.sum(own).over(w) - F.coalesce(own, F.lit(0.0))) / F.nullif(n, F.lit(0).cast("long"))


def _leaders(readings: DataFrame, counts: Column) -> DataFrame:
    """Readings with the means of their leaders, l_*. Prices are compared within a currency only."""
    priced = counts & c("price_currency").isNotNull()
    return readings.withColumns({
        "l_growth": _others(c("adoption_growth"), counts, "subject"),
        "l_level": _others(F.array_position(F.array(*map(F.lit, LEVELS)), level(c("adoption_growth"), c("status") == "measured")) - 1.0, counts, "subject"),
        "l_attention": _others(c("attention_growth"), counts, "subject"),
        "l_competitors": _others(c("competitor_count").cast("double"), counts, "subject"),
        "l_price": _others(c("unit_price"), priced, "subject", "price_currency"),
        "l_age": _others(c("first_observed_days_ago").cast("double"), counts, "subject"),
        "leaders": F.count_if(counts).over(Window.partitionBy("subject")) - counts.cast("int"),
    })


def _share(attributes: tuple[str, ...]) -> Column:
    known = F.array_compact(F.array(*map(c, attributes)))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def _ahead(lead: str, own: str) -> Column:
    """How far the leaders are ahead; null where one side has no evidence."""
    return F.when(c(lead).isNotNull() & c(own).isNotNull(), F.greatest(F.lit(0.0), c(lead) - c(own)))


def gap_dimensions(readings: DataFrame, facts: DataFrame) -> DataFrame:
    """The gap of every market of every subject to its measured other markets in nine dimensions.

    readings: subject, country, status (measured, no_signal, no_data), adoption_growth, attention_growth,
    supplier_count, competitor_count, unit_price, price_currency, first_observed_days_ago; facts: market_facts().
    A dimension without evidence on both sides is null, which counts nothing; without any, or without a
    leader, gap is null and not 0: nothing can be said."""
    rows = _leaders(readings, c("status") == "measured").join(facts, "country", "left")
    own_level = F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level(c("adoption_growth"), F.lit(True))) - 1.0, F.lit(0.0))
    lead = F.coalesce("l_level", F.lit(0.0))
    growth_gap = F.least(F.lit(1.0), F.coalesce(_ahead("l_growth", "adoption_growth"), F.lit(0.0)) / 100)
    n = c("supplier_count")
    raw = {
        "adoption_gap": 22 * F.when(c("status") == "no_signal", F.when(lead > 0, lead / 4).otherwise(0.5)).when(
            c("status") == "measured", F.least(F.lit(1.0), 0.65 * F.greatest(F.lit(0.0), lead - own_level) / 4 + 0.35 * growth_gap)
        ),
        "supply_gap": 15 * F.when(n == 0, 1.0).when(n <= 2, 0.75).when(n <= 5, 0.4).when(n <= 15, 0.1).when(n > 15, 0.0),
        "competition_gap": _ahead("l_competitors", "competitor_count") * 1.2,
        "attention_gap": _ahead("l_attention", "attention_growth") / 10,
        "price_gap": F.when(c("l_price") > 0, (c("unit_price") / c("l_price") - 1) * 12),
        "infrastructure_readiness": 12 * _share(INFRASTRUCTURE),
        "regulatory_readiness": 10 * _share(REGULATION),
        "affordability": 6 * c("purchasing_power"),
        "time_lag": _ahead("l_age", "first_observed_days_ago") / 150,
    }
    some = c("leaders") > 0
    points = {k: F.when(some & v.isNotNull(), _round(F.greatest(F.lit(0.0), F.least(F.lit(float(DIMENSIONS[k])), v)), 2)) for k, v in raw.items()}
    total = sum((F.coalesce(k, F.lit(0.0)) for k in DIMENSIONS), F.lit(0.0))
    gap = F.when(F.coalesce(*DIMENSIONS).isNotNull(), _round(F.least(F.lit(100.0), total), 1))
    return rows.select("subject", "country", "leaders", *[v.alias(k) for k, v in points.items()]).withColumn("gap", gap)


def early_gap(readings: DataFrame) -> DataFrame:
    """The earlier gap of six parts, to all other markets of the subject. A market that was not measured gets
    the most for adoption where others are; gap is null where nothing can be compared."""
    rows = _leaders(readings, F.lit(True))
    n = c("supplier_count")
    raw = {
        "adoption": F.when(c("l_growth").isNotNull(), F.when(c("adoption_growth").isNull(), 30.0).otherwise(F.least(F.lit(30.0), _ahead("l_growth", "adoption_growth") / 4))),
        "attention": _ahead("l_attention", "attention_growth") / 8,
        "supply": F.when(n == 0, 25.0).when(n <= 2, 18.0).when(n <= 5, 8.0).when(n > 5, 0.0),
        "competitors": _ahead("l_competitors", "competitor_count") * 1.5,
        "price": F.when(c("l_price") > 0, F.when(c("unit_price").isNotNull(), F.greatest(F.lit(0.0), (c("unit_price") / c("l_price") - 1) * 20))),
        "lag": _ahead("l_age", "first_observed_days_ago") / 100,
    }
    most = {"adoption": 30, "attention": 15, "supply": 25, "competitors": 15, "price": 10, "lag": 5}
    points = {k: F.when((c("leaders") > 0) & v.isNotNull(), _round(F.least(F.lit(float(most[k])), v), 2)) for k, v in raw.items()}
    total = sum((F.coalesce(k, F.lit(0.0)) for k in raw), F.lit(0.0))
    gap = F.when(F.coalesce(*raw).isNotNull(), _round(F.least(F.lit(100.0), total), 2))
    return rows.select("subject", "country", *[v.alias(k) for k, v in points.items()]).withColumn("gap", gap)


def converted(amounts: DataFrame, rates: DataFrame, stale_days: int = 90) -> DataFrame:
    """Every row of amounts (base, quote, as_of, amount) with converted (null without a rate: nothing is guessed),
    the rate, its time, whether it was turned round, and a note where it is older than `stale_days`."""
    found = rates_at(amounts, rates)
    age = F.datediff("as_of", "rated")
    note = F.when(c("base") == c("quote"), None).when(c("rate").isNull(), "no_rate").when(age > stale_days, "stale")
    return found.withColumn("converted", _round(c("amount") * c("rate"), 2)).withColumn("note", note)
