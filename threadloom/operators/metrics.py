"""Funnel counts, training logs, sparklines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = "▁▂▃▄▅▆▇█"


def funnel(stages: dict[str, DataFrame | None], spark) -> DataFrame:
    """step, stage, n: the rows of each stage, null for a missing one."""
    parts = [(spark.range(1).select(F.lit(None).cast("long").alias("n")) if df is None else df.agg(F.count("*").alias("n"))).select(F.lit(k).alias("step"), F.lit(name).alias("stage"), "n") for k, (name, df) in enumerate(stages.items())]
    return reduce(DataFrame.unionByName, parts)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def loss_summary(log: DataFrame) -> DataFrame:
    """One row from a log (sources.files.read_trainer_log): epochs (two digits) and global steps; first and last loss, last evaluation, highest
    rate; of the last final entry the runtime ("1h 2m 3s") and samples and steps a second. What the log lacks is null."""
    step = lambda c: F.when(F.col(c).isNotNull(), F.col("step"))
    last = lambda c: F.max_by(c, F.when(F.col("train_runtime").isNotNull(), F.col("step")))
    s = F.col("_s").cast("long")
    out = log.agg(
        F.round(F.max("epoch"), 2).alias("epochs"), F.max("global_step").alias("global_steps"), F.min_by("loss", step("loss")).alias("first_loss"), F.max_by("loss", step("loss")).alias("last_loss"),
        F.max_by("eval_loss", step("eval_loss")).alias("last_eval"), F.max("learning_rate").alias("max_rate"), last("train_runtime").alias("_s"),
        last("train_samples_per_second").alias("samples_per_second"), last("train_steps_per_second").alias("steps_per_second"),
    )
    return out.withColumn("runtime", F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).withColumn("runtime", F.when(F.col("_s").isNotNull(), F.col("runtime"))).drop("_s")


def sparkline(values: list[float], width: int = 60) -> str:
    """At most ``width`` evenly strided values as eight levels between their least and greatest."""
    if len(values) > width:
        values = [values[int(k * len(values) / width)] for k in range(width)]
    if not values:
        return ""
    low, span = min(values), (max(values) - min(values)) or 1.0
    return "".join(LEVELS[min(7, int(7 * (v - low) / span))] for v in values)
