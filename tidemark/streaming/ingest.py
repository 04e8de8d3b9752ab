"""Ingest with the effect of exactly once: of every key the first value that arrived stays, however often, late or
out of order it comes again.

A batch goes to a folder of its own, named by the batch's number, which is the ledger of batches: a batch that is run
again after a failure reads the folders of other batches only, and writes its own one over. Keys are looked up in the
days that the batch holds, by which the store is partitioned, so a batch reads no more of it than it can clash with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .streams import _with_store


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The rows of the store, with the batch and the day they are filed under."""
    return spark.read.schema(StructType(schema.fields).add("batch", "long").add("day", "date")).parquet(store)


def first_of(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The row of each key that arrived first, by partial aggregates."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(arrival, *rows.columns)).alias("row")).select("row.*")


def merge(rows: DataFrame, number: int, store: str, keys: list[str], arrival: str, time: str = "ts") -> None:
    """Put the first row of each key that no other batch has into the folder of this one."""
    spark = rows.sparkSession
    new = first_of(rows, keys, arrival).withColumn("day", F.to_date(time))
    if _exists(spark, store):
        low, high = new.agg(F.min("day"), F.max("day")).first()
        there = stored(spark, store, rows.schema).filter((F.col("batch") != number) & F.col("day").between(F.lit(low), F.lit(high)))
        new = new.join(there.select(*keys, "day"), [*keys, "day"], "left_anti")
    new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(store)


def ingest(stream: DataFrame, store: str, state: str, keys: list[str], arrival: str, time: str = "ts") -> None:
    """All that is there now into `store`. `keys` hold the time. A key or time that is null has no place in a series: such
    rows are left out."""
    known = stream.dropna(subset=[*keys, time])

    def one(batch: DataFrame, number: int) -> None:
        merge(batch, number, store, keys, arrival, time)

    with _with_store(stream.sparkSession):
        query = known.writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
