"""Connected components: in a task by union-find, over the cluster by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable, release


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the components of u[k] and v[k] for all k; every root is the least of its component."""
    while True:
        a, b = roots(parent, u), roots(parent, v)
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def groups(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b): label is the least node of its component.
    Each round joins every node to the least neighbour; the number of rounds grows with the
    logarithm of the diameter. Loops and repeated edges are harmless; null ends are left out."""
    state = durable(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    seen = None
    while True:
        both = state.unionAll(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"), F.collect_set("b").alias("ns"))
        large = star.select("m", F.explode("ns").alias("b"), "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
        large = large.unionAll(star.where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        down = large.groupBy(F.greatest("a", "b").alias("a")).agg(F.min(F.least("a", "b")).alias("m"), F.collect_set(F.least("a", "b")).alias("ns"))
        small = down.select("m", F.explode(F.concat("ns", F.array("a"))).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        before, state = state, durable(small, "edges")
        release(before)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return state.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")).unionAll(state.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
