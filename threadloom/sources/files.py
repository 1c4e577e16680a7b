"""Sources and sinks: thread files, transcripts, JSON lines, CSV, reports, model files, memoised stages."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "array<struct<role:string,text:string,timestamp:string>>"


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """file, path, ordinal, role, text, timestamp from JSON files of one thread each: chat_history, or messages where that
    is empty. A file that isn't a JSON object gives no rows (see broken_threads)."""
    raw = _threads(spark, path)
    full = F.when(F.size("d.chat_history") > 0, F.col("d.chat_history")).otherwise(F.col("d.messages"))
    return raw.where(F.col("d").isNotNull()).select("file", "path", F.posexplode(full).alias("ordinal", "m")).select("file", "path", "ordinal", "m.role", "m.text", "m.timestamp")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """file (the last part of path), path, value: whole files; bytes that are no UTF-8 become replacement characters."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"[^/]+$", 0).alias("file"), F.col("_metadata.file_path").alias("path"), "value")


def _threads(spark: SparkSession, path: str) -> DataFrame:
    whole = _whole(spark, path)
    parsed = F.when(F.col("value").rlike(r"\A\s*\{") & F.try_parse_json("value").isNotNull(), F.from_json("value", f"chat_history {MESSAGE}, messages {MESSAGE}"))
    return whole.withColumn("d", parsed)


def broken_threads(spark: SparkSession, path: str) -> DataFrame:
    """Files that read_threads skips."""
    return _threads(spark, path).where(F.col("d").isNull()).select("file")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, path, line_no, line of text files; the end of the last line begins no other."""
    whole = _whole(spark, path).withColumn("value", F.regexp_replace("value", r"(\r\n|\r|\n)\z", "")).where("value <> ''")
    return whole.select("file", "path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, tolerant: bool = False) -> DataFrame:
    """Records of JSON lines; blank lines are skipped. A bad line fails the job, or is skipped if tolerant."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def write_jsonl(df: DataFrame, path: str, ascii_only: bool = False) -> None:
    """JSON lines in UTF-8; with ascii_only, other characters are written as \\uXXXX."""
    if not ascii_only:
        df.write.json(path)
        return
    df.select(_escaped(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("value")).write.text(path)


def _escaped(c: Column) -> Column:
    """JSON text with every character beyond ASCII as \\uXXXX, those beyond the basic plane as two."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(x: Column) -> Column:
        n = F.ascii(x)
        high, low = F.floor((n - 0x10000) / 0x400) + 0xD800, (n - 0x10000) % 0x400 + 0xDC00
        return F.when(n < 0x80, x).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(c.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def write_csv(df: DataFrame, path: str, order: str) -> None:
    """All fields quoted, with a header, in order."""
    df.orderBy(order).write.csv(path, header=True, quoteAll=True, escape='"')


def write_report(metrics: DataFrame, path: str) -> None:
    """metric/value rows as one JSON object."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    metrics.agg(F.to_json(entries).alias("value")).coalesce(1).write.text(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """file, parameters: numbers of weights by the headers of safetensors files; null for a broken file."""

    def count(content: bytes) -> int | None:
        try:
            (n,) = struct.unpack("<Q", content[:8])
            header = json.loads(content[8 : 8 + n])
            return sum(math.prod(x.get("shape", [])) for k, x in header.items() if k != "__metadata__")
        except (ValueError, AttributeError, struct.error):
            return None

    counted = F.pandas_udf(lambda s: pd.Series([count(x) for x in s], dtype="Int64"), "long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), counted("content").alias("parameters"))


def read_trainer_log(spark: SparkSession, path: str, name: str = "trainer_state.json") -> DataFrame:
    """The log of the state file with the highest checkpoint number under a folder: step, loss, eval_loss, learning_rate, train_runtime,
    train_samples_per_second, train_steps_per_second, and the file's epoch and global_step in every row."""
    entry = "step:long,loss:double,eval_loss:double,learning_rate:double,train_runtime:double,train_samples_per_second:double,train_steps_per_second:double"
    schema = f"epoch double, global_step long, log_history array<struct<{entry}>>"
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("_metadata.file_path", r"checkpoint-(\d+)", 1), F.lit("")), F.lit("999999999")), F.lit(0))
    latest = files.select(number.alias("k"), F.struct("epoch", "global_step", "log_history").alias("state")).agg(F.max_by("state", "k").alias("state"))
    return latest.select("state.epoch", "state.global_step", F.inline("state.log_history"))


def memoised(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written first where it is missing."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
