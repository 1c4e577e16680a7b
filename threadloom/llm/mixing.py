"""Mixing sources to target weights over a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, linear between knots; the weights of
all sources add up to 1 at any time. The integral of a source's schedule says what share of
the first t of training it supplies, so with T tokens in all, a document that begins after c
tokens of its source belongs where T times that integral reaches c: a quadratic equation inside one
segment. Documents are then range-sorted by position.

A token is a word between white space here: sources in scripts without spaces, or of long unbroken strings, count less than a tokenizer
would say, so weights are shares of words.

T is the least number of tokens at which every source is used up once or more, so no document is
lost; a source whose tokens fall short of its demand starts over (``copy`` counts from 0).

Documents of a source come in the order of a hash of doc_id. The running total of tokens is
built from totals of ranges of hashes; their number grows with the table, so that a hot source is spread over
many tasks of the same size. The order doesn't depend on it.

Defined results. A null source is a source of its own, named ''. Null or empty text counts 0
tokens and is placed where the next document of its source begins, once in every pass. A null doc_id hashes
as ''. Ties (repeated rows) are ordered by the text's hash; equal rows are interchangeable. Sources that the
schedule doesn't name get the schedule of ``default_schedule``. A very long text is one document in one place. Other columns
may have any name, and are kept by mixed(). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._spark import by_key, durable

#: Powers of a source's share of all tokens that give its weight at the knots: training begins flatter and
#: ends nearer to the natural mixture.
KNOTS = ((0.0, 0.85), (0.5, 0.9), (1.0, 1.0))
#: Rows of the whole table for one range of hashes.
RANGE_ROWS = 20_000


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def default_schedule(totals: DataFrame, knots=KNOTS) -> DataFrame:
    """src, segment, t0, t1, w0, w1: weights proportional to a power of the source's tokens at
    each knot (a source without tokens has weight 0)."""
    powers = [F.when(F.col("total") > 0, F.round(F.pow(F.col("total").cast("double"), F.lit(p)), 6)).otherwise(0.0) for _, p in knots]
    raised = totals.select("src", "total", *[x.alias(f"p{k}") for k, x in enumerate(powers)])
    sums = raised.agg(*[F.sum(F.col(f"p{k}").cast("decimal(38,6)")).cast("double").alias(f"s{k}") for k in range(len(knots))])
    weights = raised.crossJoin(F.broadcast(sums)).select("src", "total", *[F.when(F.col(f"s{k}") > 0, F.col(f"p{k}") / F.col(f"s{k}")).otherwise(0.0).alias(f"w{k}") for k in range(len(knots))])
    parts = [F.struct(F.lit(k).alias("segment"), F.lit(knots[k][0]).alias("t0"), F.lit(knots[k + 1][0]).alias("t1"), F.col(f"w{k}").alias("w0"), F.col(f"w{k + 1}").alias("w1")) for k in range(len(knots) - 1)]
    return weights.select("src", F.explode(F.array(*parts)).alias("x")).select("src", "x.*")


def positions(docs: DataFrame, carried: list[str], schedule: DataFrame | None = None) -> DataFrame:
    """source, copy, position (0 to 1) and tokens n of every document, with the carried columns under ``row``.

    ``schedule`` has src, segment (0, 1, ...), t0, t1, w0, w1 for every source; default_schedule
    if None."""
    bits = min(24, max(2, (docs.count() // RANGE_ROWS).bit_length()))
    key = F.md5(F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")))
    text = F.coalesce(F.col("`text`"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("`source`").cast("string"), F.lit("")).alias("src"), key.alias("key"), F.md5(text).alias("tie"), tokens(F.col("`text`")).alias("n"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")
    ).withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits).cast("int"))
    if "text" not in carried:  # narrow rows are kept, so that texts are read once
        rows = durable(rows, "counted")
    sums = durable(rows.groupBy("src", "bucket").agg(F.sum("n").alias("n")), "buckets")
    before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    totals = sums.groupBy("src").agg(F.sum("n").alias("total"))
    plan = schedule if schedule is not None else default_schedule(totals)
    inside = W.partitionBy("src").orderBy("segment")
    plan = plan.withColumn("area", (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0"))).withColumn("done", F.coalesce(F.sum("area").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    whole = plan.groupBy("src").agg(F.max(F.col("done") + F.col("area")).alias("share"), F.sort_array(F.collect_list(F.struct("segment", "t0", "t1", "w0", "w1", "done", "area"))).alias("plan"))
    # The last source to be used up fixes T.
    demand = totals.join(whole, "src")
    scale = demand.where("share > 0").agg(F.max(F.col("total") / F.col("share")).alias("T"))
    demand = durable(demand.crossJoin(F.broadcast(scale)), "demand")
    order = W.partitionBy("src", "bucket").orderBy("key", "tie")
    placed = rows.withColumn("c", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    placed = by_key(placed, durable(starts, "starts"), ["src", "bucket"], "inner").withColumn("c", F.col("c") + F.col("start"))
    placed = by_key(placed, demand, "src", "left")
    # Copies of a document: all passes over its source in which its first token is still in demand.
    wanted = F.coalesce(F.col("T") * F.col("share"), F.lit(0.0))
    passes = F.when(F.col("total") > 0, F.greatest(F.floor((wanted * (1 - 1e-12) - F.col("c")) / F.col("total")), F.lit(0))).otherwise(0)
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), passes.cast("long"))))
    at = F.when(F.col("T") > 0, (F.col("c") + F.col("copy") * F.col("total")) / F.col("T")).otherwise(0.0)
    placed = placed.withColumn("at", at)
    seg = F.coalesce(F.element_at(F.filter("plan", lambda s: s["done"] <= F.col("at")), -1), F.get("plan", F.lit(0)))
    placed = placed.withColumn("s", seg)
    need, width = F.col("at") - F.col("s.done"), F.col("s.t1") - F.col("s.t0")
    slope = (F.col("s.w1") - F.col("s.w0")) / width
    root = F.sqrt(F.greatest(F.col("s.w0") * F.col("s.w0") + 2 * slope * need, F.lit(0.0)))
    step = F.when(F.col("s.w0") + root > 0, 2 * need / (F.col("s.w0") + root)).otherwise(0.0)
    return placed.select(F.col("src").alias("source"), F.col("copy").cast("int").alias("copy"), F.round(F.coalesce(F.col("s.t0") + F.least(step, width), F.lit(0.0)), 9).alias("position"), "n", "row")


def curriculum(docs: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """doc_id, source, copy, tokens, position of every document and pass, sorted by position."""
    out = positions(docs, ["doc_id"], schedule)
    out = out.select(F.col("row.doc_id").alias("doc_id"), "source", "copy", F.col("n").alias("tokens"), "position")
    return out.orderBy("position", "doc_id", "copy")


def mixed(docs: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, repeated and range-sorted as the curriculum says."""
    out = positions(docs, docs.columns, schedule).orderBy("position", F.col("row.doc_id"), "copy")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
