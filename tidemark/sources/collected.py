"""Counts, documents and figures out of landed bodies, beside the plain readings of connectors.py.

Every function takes a DataFrame of raw bodies with the settings of each as columns, and gives ENVELOPE rows. A body that can't
be read, and an entry without the date or value it needs, gives no row. `cutoff` and `since` are columns of raw where named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_text
from .connectors import envelope

c = F.col


def daily(times: DataFrame, name: str, prefix: str, **columns: Column) -> DataFrame:
    """An envelope for each day with rows of `times` (the column `name`, at): how many there are."""
    days = times.filter(c("at").isNotNull()).groupBy(name, F.to_date("at").alias("day")).agg(F.count("*").alias("n"))
    at = {"published_at": c("day").cast("timestamp"), "metric_value": c("n"), "entity_name": c(name)}
    return envelope(days, external_id=F.concat_ws("|", F.lit(prefix), name, c("day").cast("string")), **(at | columns))


def trade_metrics(raw: DataFrame) -> DataFrame:
    """raw: body {data: [{period, netWgt, primaryValue, ...}]}, cmd_code, metric (null: netWgt), mirror, flow ('M', 'X'; null: M), entity_name, geo_scope.

    Weights are kilograms and have no currency; all else is money as reported, in USD and never converted. Nothing and zero are left out;
    a year is put on its last day and a month on the 28th; partners' figures in place of a country's own are trusted less."""
    metric, mirror = F.coalesce("metric", F.lit("netWgt")), F.coalesce("mirror", F.lit(False))
    rows = raw.withColumns({"metric": metric, "mirror": mirror, "d": F.from_json("body", "data array<map<string, string>>")["data"]}).withColumn("d", F.explode("d"))
    period, value = c("d")["period"], c("d")[c("metric")].try_cast("double")
    text = F.when(F.length(period) == 4, F.concat(period, F.lit("1231"))).when(F.length(period) >= 6, F.concat(F.left(period, F.lit(6)), F.lit("28")))
    rows = rows.withColumns({"value": value, "period": period, "at": F.try_to_timestamp(text, F.lit("yyyyMMdd"))}).filter(c("at").isNotNull() & c("value").isNotNull() & (c("value") != 0))
    money = c("metric") != "netWgt"
    return envelope(
        rows, external_id=F.concat_ws("|", F.lit("trade"), "cmd_code", "metric", "geo_scope", "period"), published_at=c("at"), metric_name=c("metric"), metric_value=c("value"), metric_unit=F.when(money, "value").otherwise("kg"), metric_currency=F.when(money, "USD"),
        entity_name=F.coalesce("entity_name", F.concat(F.lit("HS "), "cmd_code")), entity_type=F.lit("product"), signal_type=F.when(F.coalesce("flow", F.lit("M")) == "M", "import_growth").otherwise("export_growth"), geo_scope=F.coalesce("geo_scope", F.lit("global")),
        confidence=F.when(c("mirror"), 0.75).otherwise(0.9),
    )


def weekly_commits(raw: DataFrame, weeks: int = 52) -> DataFrame:
    """raw: full_name, now, since (or null), body [{week, total}]: totals of the weeks that began within `weeks` before now, and with
    `since` those that began less than seven days before it, or later. A total that isn't given is 0; a body that isn't a list has no weeks."""
    rows = raw.select("full_name", "now", "since", F.explode(F.from_json("body", "array<struct<week: long, total: double>>")).alias("w"))
    rows = rows.withColumn("at", F.timestamp_seconds("w.week")).filter(c("at") >= c("now") - F.make_dt_interval(F.lit(7 * weeks)))
    rows = rows.filter(c("since").isNull() | (c("at") > c("since") - F.make_dt_interval(F.lit(7))))
    return envelope(rows, external_id=F.concat_ws("|", F.lit("commits"), "full_name", c("at").cast("date").cast("string")), published_at=c("at"), metric_value=F.coalesce("w.total", F.lit(0.0)), metric_unit=F.lit("commits_per_week"), entity_name=c("full_name"), entity_type=F.lit("repository"), signal_type=F.lit("github_commit_velocity"), confidence=F.lit(0.85))


def _filed(raw: DataFrame) -> DataFrame:
    """cik, company, place, day, form, number of each filing since the cutoff, from parallel arrays."""
    f = F.from_json("body", "filings struct<recent: struct<filingDate: array<string>, form: array<string>, accessionNumber: array<string>>>")["filings"]["recent"]
    each = raw.select("cik", "company", "cutoff", F.posexplode(F.arrays_zip(f["filingDate"].alias("day"), f["form"].alias("form"), f["accessionNumber"].alias("number"))).alias("place", "x"))
    each = each.select("cik", "company", "cutoff", "place", c("x.day").alias("day"), c("x.form").alias("form"), c("x.number").alias("number")).withColumn("at", F.try_to_timestamp("day", F.lit("yyyy-MM-dd")))
    return each.filter(c("at").isNotNull() & (c("cutoff").isNull() | (c("at") >= c("cutoff"))))


def filing_counts(raw: DataFrame) -> DataFrame:
    """raw: cik, company, cutoff, body: filings of a day, all of them."""
    return daily(_filed(raw), "company", "filings", metric_unit=F.lit("filings_per_day"), entity_type=F.lit("public_company"), signal_type=F.lit("sec_filing_activity"), geo_scope=F.lit("US"), confidence=F.lit(0.95))


def filing_documents(raw: DataFrame, most: int = 25) -> DataFrame:
    """The first `most` filings of each body, where they aren't older than the cutoff, as documents without a metric."""
    rows = _filed(raw).filter(c("place") < most)
    form = F.coalesce("form", F.lit("?"))
    return envelope(rows, external_id=F.concat_ws("|", F.lit("filing"), "cik", F.coalesce("number", F.lit(""))), title=F.concat_ws(" ", "company", F.lit("filed"), form, F.lit("on"), "day"), content=F.concat(F.lit("Form "), form), published_at=c("at"), entity_name=c("company"), entity_type=F.lit("public_company"), geo_scope=F.lit("US"), confidence=F.lit(0.95))


def concept_facts(raw: DataFrame) -> DataFrame:
    """raw: company, cutoff, concept, body {label, units: {unit: [{end, val}]}}: figures of all units in the order of the body; of those
    for one period end the first with a value stands, whatever was reported later."""
    schema = "label string, units map<string, array<struct<end: string, val: double>>>"
    b = raw.select("company", "cutoff", "concept", F.from_json("body", schema).alias("b"))
    units = b.select("company", "cutoff", F.coalesce("b.label", "concept").alias("label"), F.posexplode(F.map_values("b.units")).alias("unit", "rows"))
    facts = units.select("company", "cutoff", "label", "unit", F.posexplode("rows").alias("place", "r")).withColumn("at", F.try_to_timestamp("r.end", F.lit("yyyy-MM-dd")))
    facts = facts.filter(c("at").isNotNull() & c("r.val").isNotNull() & (c("cutoff").isNull() | (c("at") >= c("cutoff"))))
    first = facts.groupBy("company", "label", "at").agg(F.min_by("r.val", F.struct("unit", "place")).alias("val"))
    return envelope(first, external_id=F.concat_ws("|", F.lit("concept"), "company", "label", c("at").cast("date").cast("string")), published_at=c("at"), metric_value=c("val"), metric_unit=c("label"), entity_name=c("company"), entity_type=F.lit("public_company"), signal_type=F.lit("revenue_acceleration"), geo_scope=F.lit("US"), confidence=F.lit(0.95))


def story_counts(raw: DataFrame) -> DataFrame:
    """raw: keyword, body {hits: [{created_at_i}]}: stories of a day, a proxy for interest. A time of 0 is none."""
    hits = raw.select("keyword", F.explode(F.from_json("body", "hits array<struct<created_at_i: long>>")["hits"]["created_at_i"]).alias("t")).filter("t <> 0")
    return daily(hits.select("keyword", F.timestamp_seconds("t").alias("at")), "keyword", "stories", metric_unit=F.lit("stories_per_day"), entity_type=F.lit("keyword"), signal_type=F.lit("social_discussion_growth"), is_proxy=F.lit(True), confidence=F.lit(0.55))


def feed_records(items: DataFrame, cutoff: Column, most: int = 50, excerpt: int = 600) -> DataFrame:
    """items: feed, entity_name, id, title, link, summary, published: the counts of days since the cutoff, and the newest `most` items of each feed
    as documents with an excerpt. A feed lists its newest first, so these are its first; ties go by id."""
    recent = items.filter(c("published") >= cutoff)
    counts = daily(recent.select("entity_name", c("published").alias("at")), "entity_name", "feed", metric_unit=F.lit("items_per_day"), entity_type=F.lit("keyword"), signal_type=F.lit("media_coverage_growth"), confidence=F.lit(0.6))
    place = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("published"), "id"))
    shown = recent.withColumn("place", place).filter(c("place") <= most)  # Spark keeps `most` of a feed on each side of the shuffle
    return counts.unionByName(envelope(shown, external_id=F.concat_ws("|", F.lit("feed"), "feed", "id"), title=c("title"), content=F.left(html_text(c("summary")), F.lit(excerpt)), url=c("link"), published_at=c("published"), entity_name=c("entity_name"), entity_type=F.lit("keyword"), confidence=F.lit(0.6)))
