"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words for the quality rules and for shingles: ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_noted: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where none is set and all tasks run in this very
    process, as in tests, a temporary one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: cuts the lineage there,
    so that a lost executor costs no recomputation of what lies before. The table goes when the
    driver ends, or earlier by release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    discard_at_end(spark, path)
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return spark.read.parquet(path)


@contextmanager
def noting_tables(paths: list[str]) -> Iterator[None]:
    """Inside, the tables that stored() writes are added to `paths`, for release()."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables. For a caller that has written every result which depended on them."""
    while paths:
        fs, at = _file_system(spark, paths.pop())
        fs.delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = 4096, mb: int = 16) -> None:
    """Bound what an Arrow batch holds, so that Python workers need the same memory whether
    documents are short or very long. The bounds are settings of the session and stay: the plans
    that need them run only after the operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)


_caches: dict[tuple[str, str], Any] = {}


def claim(operator: str, key: str = "", build: Callable[[], Any] | None = None) -> Any:
    """In a Python worker: what `build` gave for this operator and key, kept for later tasks of the
    worker. Whatever other operators or keys left there is dropped and its memory returned, for workers are
    reused. Every operator's map claims its worker, with or without something to keep."""
    others = [k for k in _caches if k != (operator, key)]
    for other in others:
        del _caches[other]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it: give freed memory back
        if trim is not None:
            trim(0)
    if build is not None and (operator, key) not in _caches:
        _caches[operator, key] = build()
    return _caches.get((operator, key))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list:
    """Columns that tell documents apart even where ids are null or repeat: the id and a hash
    of the text. Rows that agree in both are one document to every operator."""
    return [F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")]
