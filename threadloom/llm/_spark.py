"""Joins whose small side is broadcast only after its size is known, and durable cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import shared_folder

#: Bytes of narrow rows (counted at ROW_BYTES and COLUMN_BYTES a column, as hashed relations measure) that may be broadcast; beyond it both
#: sides are shuffled.
BROADCAST_BYTES, ROW_BYTES, COLUMN_BYTES = 64_000_000, 32, 16


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: lineage ends in files that
    outlive any executor, and the columns stay compressed and prunable."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}.parquet")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def settle() -> None:
    """Give the memory that a fit on the driver used back to the system, as the driver lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator than glibc's
        pass


def release(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.durable_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files of queries that are over deleted: Spark does so once the driver's JVM has collected their handles, which may
    be long after."""
    gc.collect()
    spark._jvm.System.gc()


def row_key() -> Column:
    """What a filter knows a row by: its doc_id (null counts as a value) and its text."""
    return F.xxhash64(F.col("`doc_id`").cast("long"), F.col("`text`").cast("string"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose row_key isn't in ``gone`` (one column, durable), whatever their columns are called."""
    name = "row_key"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return by_key(docs.withColumn(name, row_key()), gone.toDF(name), name, "left_anti").drop(name)


def small_enough(rows: int, columns: int) -> bool:
    return rows * (ROW_BYTES + COLUMN_BYTES * columns) <= BROADCAST_BYTES


def by_key(df: DataFrame, small: DataFrame, on: list[str] | str, how: str) -> DataFrame:
    """Join a large table to a narrow one (already durable, so counting is cheap):
    broadcast within BROADCAST_BYTES, shuffled beyond."""
    few = small_enough(small.count(), len(small.columns))
    return df.join(F.broadcast(small) if few else small, on, how)


def placed(df: DataFrame, name: str, *kept: str) -> DataFrame:
    """The kept columns with one of the rows' places in the order in which they were written: 0, 1, ... over the files by number, then
    path, if ``df`` is a table that was just read; else increasing numbers in the order of its partitions."""
    columns = [F.col(f"`{c}`") for c in kept]
    try:  # columns of files beneath joins or aggregates say nothing about the rows here
        scan = df.select(*columns, "_metadata.file_path", "_metadata.row_index") if df._jdf.queryExecution().analyzed().children().isEmpty() else None
    except AnalysisException:
        scan = None
    if scan is None:
        return df.select(*columns, F.monotonically_increasing_id().alias(name))
    number = lambda pattern: F.coalesce(F.regexp_extract("file_path", pattern, 1).try_cast("long"), F.lit(0))
    before = W.orderBy(number(r"part-(\d+)[^/]*$"), number(r"[-.]c(\d+)\.[^/]*$"), "file_path").rowsBetween(W.unboundedPreceding, -1)
    files = df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("n"))
    starts = durable(files.select("file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "files")
    return by_key(scan, starts, "file_path", "inner").select(*columns, (F.col("start") + F.col("row_index")).alias(name))


#: Bytes of a batch that is sent to a Python worker; with the slices of _text it bounds a worker's memory.
BATCH_BYTES = 8_000_000


def bounded(df: DataFrame) -> DataFrame:
    """The same table; batches to Python workers are bounded by bytes from now on, however long texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns with their types, found without regard to other columns."""
    bounded(df)
    return df.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()])
