"""Ranks, running sums and exact quantiles over all rows, without one task that sorts them all.

Rows are range-partitioned by value and key, so a value that any share of all rows has is
still many tasks, sorted inside their ranges and numbered there; the rows of the ranges
below are added. The numbering is checkpointed before it is counted, because ranges are
drawn from a sample.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import materialise

_WITHIN = (1 << 33) - 1  # of monotonically_increasing_id, the place inside a partition


def in_order(df: DataFrame, value: str, key: str, sums: dict[str, str] | None = None) -> DataFrame:
    """df with _rank (from 1) and _n by ``value`` upwards, ties by the unique ``key``; sums: new column -> column to add up to and with the row.

    NULL values come first, NaN last. There are as many ranges as shuffle partitions. An
    empty input comes out empty.
    """
    order = [F.col(value).asc_nulls_first(), F.col(key)]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_io_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_io_range", F.shiftright("_io_at", 33))
    sums = sums or {}
    held = placed.groupBy("_io_range").agg(F.count("*").alias("_io_rows"), *(F.sum(c).alias(f"_io_sum_{name}") for name, c in sums.items()))
    below = W.orderBy("_io_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    offsets = held.select(
        "_io_range", F.coalesce(F.sum("_io_rows").over(below), F.lit(0)).alias("_io_before"), F.sum("_io_rows").over(W.partitionBy()).alias("_n"),
        *(F.coalesce(F.sum(f"_io_sum_{name}").over(below), F.lit(0)).alias(f"_io_sum_{name}") for name in sums),
    )
    out = placed
    own = W.partitionBy("_io_range").orderBy("_io_at").rowsBetween(W.unboundedPreceding, 0)
    for name, c in sums.items():
        out = out.withColumn(name, F.sum(c).over(own))
    out = out.join(F.broadcast(offsets), "_io_range").withColumn("_rank", F.col("_io_before") + F.col("_io_at").bitwiseAND(F.lit(_WITHIN)) + 1)
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_io_sum_{name}"))
    return out.drop("_io_range", "_io_at", "_io_before", *(f"_io_sum_{name}" for name in sums))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation of the values that are there (NaN and NULL are not), as a short list."""
    rows = df.select(F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_v").agg(F.count("*").alias("_k"))
    placed = in_order(rows, "_v", "_v", {"_upto": "_k"})
    n = rows.agg(F.sum("_k")).first()[0]
    if not n:
        return [None] * len(shares)
    wanted = sorted({r for q in shares for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    first = F.col("_upto") - F.col("_k")
    hit = F.exists(F.lit(wanted), lambda r: (r >= first) & (r < F.col("_upto")))
    found = placed.where(hit).select(first.alias("a"), F.col("_upto").alias("b"), "_v").collect()  # at most two values per share

    def at(r: int) -> float:
        return next(x["_v"] for x in found if x["a"] <= r < x["b"])

    out = []
    for q in shares:
        x = q * (n - 1)
        low, high = at(math.floor(x)), at(math.ceil(x))
        out.append(low + (high - low) * (x - math.floor(x)))
    return out
