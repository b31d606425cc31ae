"""Choosing among alternatives by what they require and what they achieve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.drift import budget

MOST_PATHS = 1000


def available(paths: DataFrame, healthy: DataFrame, *keys: str) -> DataFrame:
    """(keys, path columns, missing): each path (path_id, required array, precision) against each situation (keys, healthy array); missing is what it requires and lacks.

    Paths are a stated table of at most ``MOST_PATHS`` rows; they are laid out in each row of the situations.
    """
    rows = paths.select("path_id", "required", F.col("precision").cast("double")).limit(MOST_PATHS + 1).collect()
    if len(rows) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} paths")
    each = [F.struct(F.lit(r[0]).alias("path_id"), F.lit(list(r[1])).alias("required"), F.lit(r[2]).alias("precision")) for r in rows]
    laid = healthy.withColumn("_p", F.explode(F.array(*each)))
    return laid.select(*healthy.columns, "_p.*").withColumn("missing", F.array_sort(F.array_except("required", "healthy")))


def best_path(options: DataFrame, budget: float, *keys: str) -> DataFrame:
    """(keys, path_id, precision): per situation the path with the highest precision, at least the budget and with nothing missing, ties by path_id; ``halt`` without one."""
    able = (F.size("missing") == 0) & (F.col("precision") >= budget)
    best = options.groupBy(*keys).agg(F.min(F.when(able, F.struct((-F.col("precision")).alias("p"), F.col("path_id").alias("path_id")))).alias("b"))
    return best.select(*keys, F.coalesce("b.path_id", F.lit("halt")).alias("path_id"), (-F.col("b.p")).alias("precision"))


def recalibrated(paths: DataFrame, estimates: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The table with the estimated precision where it differs by more than the tolerance, best first, and whether it was changed."""
    joined = paths.join(estimates.select("path_id", F.col("precision").alias("_e")), "path_id", "left")
    moved = F.coalesce(F.abs(F.col("_e") - F.col("precision")) > tolerance, F.lit(False))
    out = joined.withColumn("changed", moved).withColumn("precision", F.when(moved, F.col("_e")).otherwise(F.col("precision"))).drop("_e")
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("precision"), "path_id")))  # a row per path


def evidence(paths: DataFrame, least: float = 0.60) -> DataFrame:
    """One row: number of paths, the lowest precision (0 without a path), whether all reach ``least``, whether all are below it, and the budget that goes with their mean."""
    found = paths.agg(
        F.count("*").alias("n_paths"), F.coalesce(F.min("precision"), F.lit(0.0)).alias("min_precision"), F.bool_and(F.col("precision") >= least).alias("all_reach"),
        F.bool_and(F.col("precision") < least).alias("all_below"), F.avg("precision").alias("_mean"),
    )
    return found.withColumn("budget", budget(F.col("_mean"), F.lit(0.0))).drop("_mean")
