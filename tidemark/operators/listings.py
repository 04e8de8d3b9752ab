"""Listings and pages, run outcomes, lineage and upkeep: what a reader or an operator of the store asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# Order of risk levels.
RISK = ("low", "moderate", "high", "very_high")


def narrowed(rows: DataFrame, equal: dict | None = None, least: dict | None = None, after: dict | None = None, hide: tuple[str, ...] = ()) -> DataFrame:
    """Rows under optional conditions: columns equal to a value, at least a value, later than a time; flags that
    hide a row. A condition of None is none. All reach the scan."""
    tests = [c(k) == v for k, v in (equal or {}).items() if v is not None]
    tests += [c(k) >= v for k, v in (least or {}).items() if v is not None]
    tests += [c(k) > F.lit(v).cast("timestamp") for k, v in (after or {}).items() if v is not None]
    tests += [~F.coalesce(c(k), F.lit(False)) for k in hide]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def risk_rank(level: Column) -> Column:
    """0 for low to 3 for very high; unknown levels come behind all."""
    at = F.array_position(F.array(*map(F.lit, RISK)), level)
    return F.when(at > 0, at - 1).otherwise(len(RISK))


#: Orders of a page of opportunities: column and whether the greatest comes first.
ORDERS = {
    "score": ("opportunity_score", True),
    "confidence": ("confidence", True),
    "risk": ("risk_rank", False),
    "capital": ("capital_required", False),
    "newest": ("detected_at", True),
    "updated": ("updated_at", True),
    "trend": ("trend_score", True),
}


def page(rows: DataFrame, order: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of `rows` in one of ORDERS, nulls last and ties by `key`: every row's place and the total."""
    name, down = ORDERS[order]
    ordered = c(name).desc_nulls_last() if down else c(name).asc_nulls_last()
    found = rows.orderBy(ordered, key).limit(offset + limit)  # only these are ever brought together
    placed = found.withColumn("place", F.row_number().over(Window.orderBy(ordered, key)))
    return placed.filter(c("place") > offset).crossJoin(rows.agg(F.count("*").alias("total")))  # one row


#: Orders of a page of trends: columns, each with the greatest first.
TREND_ORDERS = {
    "score": ("trend_score", "confidence"),
    "confidence": ("confidence", "trend_score"),
    "newest": ("first_detected_at",),
    "updated": ("last_evaluated_at",),
    "acceleration": ("acceleration_pp",),
}


def listed(rows: DataFrame, by: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit in the order of `by` (which ends with a key), their place, and the number of all
    rows. An empty page has no rows."""
    found = rows.orderBy(*by).limit(offset + limit)  # each task keeps as many, and only these are brought together
    placed = found.withColumn("place", F.row_number().over(Window.orderBy(*by)))
    return placed.filter(c("place") > offset).crossJoin(rows.agg(F.count("*").alias("total")))  # one row


def trend_listing(
    trends: DataFrame, order: str = "score", least_score: float | None = None, least_confidence: float | None = None, spikes: bool = True, seasonal: bool = True, limit: int = 50, offset: int = 0, key: str = "subject", **equal
) -> DataFrame:
    """A page of trends in one of TREND_ORDERS, nulls last and ties by `key`. `equal` are columns that must have a value
    (analysis_mode, category, stage, state, geo_scope, subject_type); None is no condition."""
    hide = tuple(flag for flag, shown in (("is_one_day_spike", spikes), ("is_seasonal", seasonal)) if not shown)
    found = narrowed(trends, equal, {"trend_score": least_score, "confidence": least_confidence}, hide=hide)
    return listed(found, [c(k).desc_nulls_last() for k in TREND_ORDERS[order]] + [c(key)], limit, offset)


def signal_listing(signals: DataFrame, entities: DataFrame, sources: DataFrame, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """A page of signals (signal_id, entity_id, source_id, signal_type, signal_class, geo_scope) with the names of their
    entity (entity_id, canonical_name) and source (source_id, slug), by name and type, then by signal_id. A signal whose
    entity or source isn't stored is in no page. `equal`: entity_id, signal_type, signal_class, geo_scope, source_id."""
    found = narrowed(signals, equal).join(entities.select("entity_id", c("canonical_name").alias("entity_name")), "entity_id").join(sources.select("source_id", c("slug").alias("source_slug")), "source_id")
    return listed(found, [c("entity_name"), c("signal_type"), c("signal_id")], limit, offset)


def entity_listing(entities: DataFrame, containing: str | None = None, entity_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of entities (entity_id, canonical_name, normalized, entity_type) by name, then by entity_id. `containing` is
    looked for in lower case inside of the normalised name, every character for itself; an empty one is none."""
    found = narrowed(entities, {"entity_type": entity_type or None})
    return listed(found.filter(c("normalized").contains(containing.lower())) if containing else found, [c("canonical_name"), c("entity_id")], limit, offset)


def timeline(detected: DataFrame, snapshots: DataFrame, records: DataFrame, most: int = 15) -> DataFrame:
    """subject, at, what, ref of each subject: its detection, its evaluations, and its newest `most` records."""
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("at"), "ref"))
    newest = records.withColumn("place", place).filter(c("place") <= most).drop("place")
    told = lambda rows, what: rows.select("subject", "at", F.lit(what).alias("what"), "ref")
    return told(detected, "detected").unionByName(told(snapshots, "evaluated")).unionByName(told(newest, "record"))


def outcomes(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """key, outcome of a run over candidates (key, accepted): rejected, updated if known, else created; and
    kept ones (known) that the run didn't see are `unseen`."""
    rows = candidates.select("key", "accepted").join(known.select("key", F.lit(True).alias("stored")), "key", "full")
    what = F.when(c("accepted").isNull(), "unseen").when(~c("accepted"), "rejected").when(c("stored"), "updated").otherwise("created")
    return rows.select("key", what.alias("outcome"))


def rejection_briefs(rejected: DataFrame, signals: DataFrame, near: float = 5.0) -> DataFrame:
    """subject, reasons, direction, growth (map of class to mean growth, unknown left out) and evidence rows of
    rejected subjects (subject, reasons, growth); within `near` points the direction is flat."""
    direction = F.when(c("growth").isNull(), "unknown").when(c("growth") > near, "rising").when(c("growth") < -near, "falling").otherwise("flat")
    by_class = signals.groupBy("subject", "signal_class").agg(F.round(F.avg("growth_30d") + 1e-9, 1).alias("mean"), F.count("*").alias("n"))
    facts = by_class.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal_class", "mean")))).alias("by_class"), F.sum("n").alias("signals"))  # a handful of classes
    known = F.map_filter("by_class", lambda _, v: v.isNotNull())
    return rejected.join(facts, "subject", "left").select("subject", "reasons", direction.alias("direction"), known.alias("by_class"), F.coalesce("signals", F.lit(0)).alias("signals"))


def weakest(parts: dict[str, float]) -> Column:
    """The component (column name, most points) that reaches the least share of its points; ties by name."""
    return F.array_min(F.array(*[F.struct((c(k) / most).alias("share"), F.lit(k).alias("name")) for k, most in parts.items()]))["name"]


def archived(rows: DataFrame, as_of: Column, days: int = 120) -> DataFrame:
    """Rows (state, evaluated_at): candidates that were not evaluated for more than `days` are archived."""
    stale = (c("state") == "candidate") & (F.datediff(as_of, "evaluated_at") > days)
    return rows.withColumn("state", F.when(stale, "archived").otherwise(c("state")))


def lineage_impact(store: dict[str, DataFrame], gone: DataFrame, key: str) -> DataFrame:
    """name, affected, mixed: for each table of the store (key, owner) how many rows rest on `gone` (key), and
    how many of their owners also rest on other rows."""
    lost = gone.select(key).distinct().withColumn("lost", F.lit(True))
    counts = []
    for name, rows in store.items():
        marked = rows.join(lost, key, "left").groupBy("owner").agg(F.count_if(c("lost").isNotNull()).alias("hit"), F.count("*").alias("n"))
        counts.append(marked.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("affected"), F.count_if((c("hit") > 0) & (c("hit") < c("n"))).alias("mixed")).withColumn("name", F.lit(name)))
    return reduce(DataFrame.unionByName, counts)


def only_from(rows: DataFrame, owner: str, flag: str) -> DataFrame:
    """Owners all of whose rows have the flag."""
    return rows.groupBy(owner).agg(F.bool_and(F.coalesce(c(flag), F.lit(False))).alias("all_of")).filter("all_of").select(owner)


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each table, in one result."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).withColumn("name", F.lit(n)) for n, t in tables.items()])


def freshness(sources: DataFrame, as_of: Column) -> DataFrame:
    """Sources (source_id, last_success) with the hours since; null if there was none."""
    return sources.withColumn("hours", F.round((F.unix_timestamp(as_of) - F.unix_timestamp("last_success")) / 3600 + 1e-9, 1))


def warnings(*parts: Column) -> Column:
    """Lists of warnings as one, each once, in the order of their first occurrence."""
    return F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))


def settings(config: Column) -> Column:
    """What a JSON configuration asks for; what is missing or isn't valid JSON is null."""
    return F.from_json(config, "k int, page string, metric string, threshold double")


def dropped(stored: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that the last run no longer saw."""
    return stored.join(seen.select(*keys).distinct(), keys, "left_anti")


def either_but(first: DataFrame, second: DataFrame, without: DataFrame) -> DataFrame:
    """What is in one of two tables of the same columns and not in the third, each row once."""
    return first.union(second).distinct().join(without, first.columns, "left_anti")


def median_growth(signals: DataFrame) -> DataFrame:
    """subject, growth: the median over the subject's adoption signals that have one."""
    return signals.filter(c("is_adoption") & c("growth_30d").isNotNull()).groupBy("subject").agg(F.median("growth_30d").alias("growth"))


def with_history(observations: DataFrame, least: int = 4) -> DataFrame:
    """Observations (series, value, status) of series with at least `least` usable points."""
    usable = F.count_if((c("status") == "ok") & c("value").isNotNull())
    enough = observations.groupBy("series").agg(usable.alias("usable")).filter(c("usable") >= least).select("series")
    return observations.join(enough, "series", "left_semi")


def documents_only(records: DataFrame) -> DataFrame:
    """Records with both an address and a title: rows that machines made would dilute shares of copies."""
    return records.filter("url is not null and title is not null")
