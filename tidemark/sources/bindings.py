"""The given tables as inputs of the operators: series of observations with their signals.

Every binding is declared here once; queries name the binding, not the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"  # exclusive; the last month of the order tables holds one day
ATTENTION_SHIFT = 8217  # days that put the event stream just before AS_OF
#: name: signal type, source, source group, reliability, proxy
SIGNALS = {
    "orders": ("transaction_growth", "order_book", "orders", 0.90, False),
    "buyers": ("customer_count_growth", "crm", "orders", 0.85, False),
    "trade": ("import_growth", "customs", "lineitem", 0.80, False),
    "attention": ("social_discussion_growth", "clicks", "events", 0.40, True),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month(ts: Column) -> Column:
    return F.date_trunc("month", ts.cast("timestamp"))


def _by_customer_nation(spark: SparkSession, sf_dir: str, keyed: DataFrame, key: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(key), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return keyed.join(customers, key).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate").filter(F.col("o_orderdate") < F.lit(AS_OF).cast("timestamp_ntz"))
    return _by_customer_nation(spark, sf_dir, o, "o_custkey").withColumn("at", _month(F.col("o_orderdate")))


def series(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """series, subject, at, value, status of one signal family; subjects are nations."""
    if name == "orders":
        found = orders(spark, sf_dir).groupBy("n_name", "at").agg(F.count("*").alias("value"))
    elif name == "buyers":
        found = orders(spark, sf_dir).groupBy("n_name", "at").agg(F.countDistinct("o_custkey").alias("value"))
    elif name == "trade":
        lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_shipdate").filter(F.col("l_shipdate") < F.lit(AS_OF).cast("timestamp_ntz"))
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        found = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name", _month(F.col("l_shipdate")).alias("at")).agg(F.sum("l_quantity").alias("value"))
    elif name == "attention":
        views = table(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", "ts")
        day = F.date_sub(F.col("ts").cast("date"), ATTENTION_SHIFT).cast("timestamp")
        found = _by_customer_nation(spark, sf_dir, views, "user_id").groupBy("n_name", day.alias("at")).agg(F.count("*").alias("value"))
    else:
        raise ValueError(f"no such signal family: {name}")
    return found.select(F.concat(F.lit(f"{name}:"), "n_name").alias("series"), F.col("n_name").alias("subject"), "at", F.col("value").cast("double").alias("value"), F.lit("ok").alias("status"))


def all_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [series(spark, sf_dir, name) for name in SIGNALS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, subject, signal_type, source_id, source_group, reliability, is_proxy, geo_scope."""
    dim = spark.createDataFrame([(name, *rest) for name, rest in SIGNALS.items()], "family string, signal_type string, source_id string, source_group string, reliability double, is_proxy boolean")
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("subject"))
    paired = nations.crossJoin(F.broadcast(dim))  # four signal families for each nation
    return paired.select(F.concat("family", F.lit(":"), "subject").alias("series"), "subject", "signal_type", "source_id", "source_group", "reliability", "is_proxy", F.col("subject").alias("geo_scope"))


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at")).agg(F.count("*").cast("double").alias("value")).withColumn("status", F.lit("ok"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, source_id, title (a document's first line), content."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("record_id"), F.col("source").alias("source_id"), F.split("text", "\n").getItem(0).alias("title"), F.col("text").alias("content"))
