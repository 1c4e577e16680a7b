"""Chat records for fine-tuning, and the split into training and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import strip
from .prompts import context_block

#: Buckets of the hash order; one bucket is ranked in one task.
BUCKETS = 4096


def assistant(recs: Column) -> Column:
    """The suggestions as JSON text, messages stripped."""
    clean = F.transform(recs, lambda r: F.struct(strip(r["suggested_message"]).alias("suggested_message"), r["confidence"].alias("confidence")))
    return F.to_json(F.struct(clean.alias("recommendations")))


def chat(labelled: DataFrame, system: str) -> DataFrame:
    """The rows with ``user``, ``reply`` and ``messages`` (system, user, assistant)."""
    user = F.concat(context_block(), F.when(F.coalesce("directive", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("directive"))).otherwise(""))
    out = labelled.withColumns({"user": user, "reply": assistant(F.col("recommendations"))})
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return out.withColumn("messages", F.array(turn("system", F.lit(system)), turn("user", F.col("user")), turn("assistant", F.col("reply"))))


def split(rows: DataFrame, key: Column, share: float = 0.03, seed: int = 0) -> DataFrame:
    """``split``: val for max(1, int(n x share)) rows, train for the others, by the order of md5(seed, key).

    The order is cut into hash buckets: totals of buckets find the one that the border falls into, and rows are ranked
    within their buckets only, so no task ranks the whole table. Pass a conversation's key with
    distinct values in ``key`` to keep groups together."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key))
    df = rows.withColumn("_h", h).withColumn("_b", (F.conv(F.substring("_h", 1, 3), 16, 10)).cast("int"))
    sizes = df.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    wanted = F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(share)))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h")) + F.col("_before")
    return df.join(F.broadcast(starts.drop("_n")), "_b").withColumn("split", F.when(rank <= wanted, "val").otherwise("train")).drop("_h", "_b", "_before", "_all")
