"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where none is set and all tasks run in the driver's own process, as in
    tests, a temporary one of our own, which is then the session's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str) -> DataFrame:
    """`df` written once to a folder of its own and read again: lost executors cost nothing of what lies before, and no
    memory is held. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
