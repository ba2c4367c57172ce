"""Shared helpers: durable intermediate tables, Arrow column access, sizes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``.  Only where that is unset and all runs
    in one process (tests, a laptop) a folder of our own is made and
    remembered for the session; a cluster must name one.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "lociframe-shared")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir() or at
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lociframe-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like a checkpoint: a lost executor costs a re-read of the
    written table, never a re-run of what made it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lociframe_path = path  # for drop_durable
    return out


def drop_durable(*tables: DataFrame) -> None:
    """Delete tables written by :func:`durable` once nothing reads them."""
    for df in tables:
        path = getattr(df, "_lociframe_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Give memory that is free in this process back to the system: workers are reused and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run`` over Arrow batches, followed by :func:`release` when the task ends."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    """A string column as Python strings; bytes that are no UTF-8 become U+FFFD."""
    return [None if x is None else x.decode("utf-8", "replace") for x in utf8(column)]


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slice batches so that ``column`` holds about ``limit`` bytes each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit / max(1, batch.column(column).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def use_small_arrow_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Batches of texts, Arrow's and the Parquet reader's: so few rows and bytes that long documents fit a worker's and an executor's memory."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """Project exactly the named columns, cast; extra or clashing columns do not get through."""
    from pyspark.sql import functions as F

    missing = [c for c in types if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
