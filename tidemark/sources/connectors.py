"""Connectors: landed files as record envelopes (one schema for all), and the sinks they go to.

A connector is a function of a DataFrame of raw input to ENVELOPE rows; fetching is not Spark's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_text
from .places import shared_folder

ENVELOPE = (
    "external_id string, title string, content string, url string, published_at timestamp, metric_name string, metric_value double, metric_unit string, metric_currency string, "
    "status string, entity_name string, entity_type string, signal_type string, is_proxy boolean, geo_scope string, confidence double"
)
CSV = "observed_at string, entity_name string, signal_type string, value string, entity_type string, unit string, geo_scope string, url string, is_proxy string, confidence string, currency string, status string, _corrupt string"
c = F.col


def envelope(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows with the given columns; all others of the schema null, status 'ok', scope 'global'."""
    given = {"status": F.lit("ok"), "geo_scope": F.lit("global"), "is_proxy": F.lit(False), "confidence": F.lit(0.9)} | columns
    kinds = [part.rsplit(" ", 1) for part in ENVELOPE.split(", ")]
    return df.select(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds])


def csv_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows as envelopes, and rejected rows with the first rule they break."""
    raw = spark.read.schema(CSV).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", False).csv(path)
    status, value = F.coalesce("status", F.lit("ok")), F.expr("try_cast(value as double)")
    at = F.try_to_timestamp("observed_at")
    reason = (
        F.when(c("_corrupt").isNotNull(), "unreadable").when(at.isNull(), "bad date").when(c("entity_name").isNull() | c("signal_type").isNull(), "missing name or type")
        .when(~status.isin("ok", "missing", "failed"), "unknown status").when((status == "ok") & value.isNull(), "value is not numeric").when(c("currency").isNotNull() & (F.length("currency") != 3), "bad currency")
    )
    judged = raw.withColumn("reason", reason)
    good = envelope(
        judged.filter("reason is null"), external_id=F.concat_ws(":", "entity_name", "signal_type", "observed_at"), published_at=at, metric_value=F.when(status == "ok", value), metric_name=c("signal_type"), metric_unit=c("unit"), metric_currency=c("currency"), status=status, entity_name=c("entity_name"),
        entity_type=c("entity_type"), signal_type=c("signal_type"), url=c("url"), is_proxy=F.lower("is_proxy").isin("true", "1", "yes"), geo_scope=F.coalesce("geo_scope", F.lit("global")), confidence=F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(0.9)),
    )
    return good, judged.filter("reason is not null").drop("_corrupt")


def macro_series(raw: DataFrame, signal_type: str) -> DataFrame:
    """raw: series, body {observations: [{date, value}]}; '.' is a gap, not a zero."""
    rows = raw.select("series", F.explode(F.from_json("body", "observations array<struct<date: string, value: string>>")["observations"]).alias("o"))
    value = F.expr("try_cast(o.value as double)")
    return envelope(rows, external_id=F.concat_ws(":", "series", "o.date"), published_at=F.try_to_timestamp("o.date"), metric_value=value, status=F.when(value.isNull(), "missing").otherwise("ok"), entity_name=c("series"), entity_type=F.lit("indicator"), signal_type=F.lit(signal_type))


def trade_flows(raw: DataFrame) -> DataFrame:
    """raw: body {data: [{period, reporterCode, partnerCode, cmdCode, primaryValue}]}, mirror; years end on
    December 31, months are put on the 28th; mirrored statistics swap the sides and are trusted less."""
    rows = raw.select("mirror", F.explode(F.from_json("body", "data array<struct<period: string, reporterCode: int, partnerCode: int, cmdCode: string, primaryValue: double>>")["data"]).alias("d"))
    rows = rows.filter(c("d.primaryValue") > 0)
    year, month = F.left("d.period", F.lit(4)).cast("int"), F.substring("d.period", 5, 2).cast("int")
    at = F.when(F.length("d.period") == 4, F.make_date(year, F.lit(12), F.lit(31))).otherwise(F.make_date(year, month, F.lit(28)))
    side = F.when(c("mirror"), c("d.partnerCode")).otherwise(c("d.reporterCode"))
    return envelope(rows, external_id=F.concat_ws(":", side, "d.cmdCode", "d.period"), published_at=at, metric_value=c("d.primaryValue"), metric_currency=F.lit("USD"), entity_name=c("d.cmdCode"), entity_type=F.lit("commodity"), signal_type=F.lit("import_growth"), geo_scope=side.cast("string"), confidence=F.when(c("mirror"), 0.75).otherwise(0.9))


def repository_levels(raw: DataFrame) -> DataFrame:
    """raw: full_name, at, stargazers_count, forks_count, open_issues_count; a row for each level."""
    levels = raw.unpivot(["full_name", "at"], ["stargazers_count", "forks_count", "open_issues_count"], "name", "level")
    kind = F.create_map(*[F.lit(x) for x in ("stargazers_count", "github_stars", "forks_count", "github_forks", "open_issues_count", "github_issue_velocity")])[c("name")]
    return envelope(levels, external_id=F.concat_ws(":", "full_name", "name", F.col("at").cast("date").cast("string")), published_at=c("at"), metric_value=c("level"), entity_name=c("full_name"), entity_type=F.lit("repository"), signal_type=kind)


def filings(raw: DataFrame) -> DataFrame:
    """raw: company, body with parallel arrays of filing dates, forms and numbers: daily counts."""
    f = F.from_json("body", "filings struct<recent: struct<filingDate: array<string>, form: array<string>, accessionNumber: array<string>>>")["filings"]["recent"]
    each = raw.select("company", F.explode(F.arrays_zip(f["filingDate"].alias("day"), f["form"].alias("form"))).alias("x"))
    days = each.groupBy("company", c("x.day").alias("day")).agg(F.count("*").alias("n"))
    return envelope(days, external_id=F.concat_ws(":", "company", "day"), published_at=F.try_to_timestamp("day"), metric_value=c("n"), entity_name=c("company"), entity_type=F.lit("public_company"), signal_type=F.lit("sec_filing_activity"))


def first_facts(facts: DataFrame) -> DataFrame:
    """company, end, val, pos: of facts reported again for one period end, the first stands."""
    return facts.groupBy("company", "end").agg(F.min_by("val", "pos").alias("val"))


def stories(raw: DataFrame, top: int = 10) -> DataFrame:
    """raw: keyword, body {hits: [...]}: the `top` stories of each keyword by points, as documents."""
    hits = raw.select("keyword", F.explode(F.from_json("body", "hits array<struct<objectID: string, title: string, url: string, points: int, created_at_i: long, story_text: string>>")["hits"]).alias("h"))
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("h.points"), "h.objectID"))).filter(c("r") <= top)
    return envelope(best, external_id=c("h.objectID"), title=c("h.title"), url=c("h.url"), content=F.left(html_text(c("h.story_text")), F.lit(600)), published_at=F.timestamp_seconds("h.created_at_i"), entity_name=c("keyword"), entity_type=F.lit("keyword"), is_proxy=F.lit(True))


def feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Items of RSS files, or entries of Atom files (tag 'entry')."""
    raw = spark.read.format("xml").option("rowTag", tag).schema("title string, link string, guid string, id string, pubDate string, updated string, description string, summary string").load(path)
    at = F.coalesce(F.expr("try_to_timestamp(regexp_replace(pubDate, '^[A-Za-z]{3}, ', ''), 'd MMM yyyy HH:mm:ss Z')"), F.try_to_timestamp("updated"))
    return envelope(raw, external_id=F.coalesce("guid", "id", "link"), title=F.trim("title"), url=F.coalesce("link", "id"), content=F.left(html_text(F.coalesce("description", "summary")), F.lit(600)), published_at=at)


def page_views(raw: DataFrame) -> DataFrame:
    """raw: article, body {items: [{timestamp, views}]}; a proxy for interest."""
    items = raw.select("article", F.explode(F.from_json("body", "items array<struct<timestamp: string, views: long>>")["items"]).alias("i"))
    return envelope(items, external_id=F.concat_ws(":", "article", F.left("i.timestamp", F.lit(8))), published_at=F.to_date(F.left("i.timestamp", F.lit(8)), "yyyyMMdd"), metric_value=c("i.views"), entity_name=c("article"), signal_type=F.lit("wiki_pageview_growth"), is_proxy=F.lit(True))


def newer_than(rows: DataFrame, high_water: str | None) -> DataFrame:
    return rows if high_water is None else rows.filter(c("published_at") > F.lit(high_water).cast("timestamp"))


def _settled(rows: DataFrame) -> DataFrame:
    """Rows read to the end and kept in the folder that all executors share, before their table changes."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def append_new(rows: DataFrame, path: str, keys: list[str], partition: list[str]) -> int:
    """Append the rows whose keys the table at `path` hasn't, each once; the number appended."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = rows.dropDuplicates(keys)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    new = _settled(new)
    n = new.count()
    if n:
        new.write.mode("append").partitionBy(*partition).parquet(path)
    return n


def upserted(state: DataFrame, fresh: DataFrame, key: str, first: list[str], peak: list[str]) -> DataFrame:
    """Fresh rows over the state: of `first` columns the oldest value stays, of `peak` the greatest; rows
    only in the state stay as they were."""
    old = state.select(*[c(x).alias(f"__{x}") for x in state.columns])
    both = fresh.join(old, fresh[key] == c(f"__{key}"), "full")
    pick = lambda x: F.coalesce(f"__{x}", x) if x in first else F.greatest(x, f"__{x}") if x in peak else F.when(c(key).isNotNull(), c(x)).otherwise(c(f"__{x}"))
    return both.select(*[pick(x).alias(x) for x in fresh.columns])


def append_snapshot(rows: DataFrame, path: str, evaluated_at: str) -> None:
    """Rows as the evaluation of a moment, beside all earlier ones: a partition that is written once. A run that is
    repeated for the same moment writes the same partition again instead of a second one."""
    stamped = rows.withColumn("evaluated_at", F.lit(evaluated_at))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("evaluated_at").parquet(path)


def replace_children(rows: DataFrame, path: str, parent: str, buckets: int = 64) -> None:
    """Child rows (risks, conditions, ways in) of the parents in `rows` in place of those they had; other parents keep
    theirs. The table is partitioned by a hash of the parent, so only partitions with changed parents are written."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(parent), F.lit(buckets)).cast("int"))
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        old = spark.read.schema(new.schema).parquet(path)
        touched = old.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")  # at most `buckets` rows
        new = new.unionByName(touched.join(rows.select(parent).distinct(), parent, "left_anti").select(new.columns))
        new = _settled(new)  # read to the end before its own partitions are written over
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def failure_streaks(ledger: DataFrame, limit: int = 5) -> DataFrame:
    """source_id, streak and state of sources from their runs (source_id, started_at, failed): how many of the latest runs
    failed in a row, and whether that makes the source an error."""
    last_good = ledger.filter(~c("failed")).groupBy("source_id").agg(F.max("started_at").alias("good"))
    since = ledger.join(last_good, "source_id", "left").groupBy("source_id").agg(F.count_if(c("failed") & (c("good").isNull() | (c("started_at") > c("good")))).alias("streak"))
    return since.withColumn("state", F.when(c("streak") >= limit, "error").when(c("streak") > 0, "failing").otherwise("ok"))


def run_accounts(runs: DataFrame, records: DataFrame, limit: int = 5) -> DataFrame:
    """What became of each run (run_id, source_id, started_at, finished_at, error, is_capped): its records (run_id, reason, is_duplicate,
    metric_value, status) fetched, rejected (with a reason), duplicate, stored, and observations, which are stored records that carry a
    value or say that there is none; duration_ms; whether it failed (an error and nothing fetched), was partial (an error, or a cap) or
    succeeded; how many runs of the source have failed in a row by then, and whether that makes the source an error.

    A run without records has zeros; one that isn't finished has no duration. Streaks are told by the last run that didn't fail."""
    is_rejected, again = c("reason").isNotNull(), F.coalesce("is_duplicate", F.lit(False))
    measured = c("metric_value").isNotNull() | (F.coalesce("status", F.lit("ok")) != "ok")
    counted = records.groupBy("run_id").agg(F.count("*").alias("fetched"), F.count_if(is_rejected).alias("rejected"), F.count_if(~is_rejected & again).alias("duplicate"), F.count_if(~is_rejected & ~again).alias("stored"), F.count_if(~is_rejected & ~again & measured).alias("observations"))
    names = ("fetched", "rejected", "duplicate", "stored", "observations")
    out = runs.join(counted, "run_id", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in names})
    out = out.withColumn("duration_ms", F.floor((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000))
    out = out.withColumn("run_status", F.when(c("error").isNotNull() & (c("fetched") == 0), "failed").when(c("error").isNotNull() | F.coalesce("is_capped", F.lit(False)), "partial").otherwise("succeeded"))
    by = Window.partitionBy("source_id").orderBy("started_at", "run_id")  # a row a run
    place = F.row_number().over(by)
    good = F.max(F.when(c("run_status") != "failed", c("place"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("place", place).withColumn("failures", c("place") - F.coalesce(good, F.lit(0))).drop("place")
    return out.withColumn("source_status", F.when(c("failures") >= limit, "error").otherwise("active"))
