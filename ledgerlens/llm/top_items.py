"""The N best items of every group, however large a group is.

Two-stage salted ranking: a group is hashed into subgroups by the item's identifier, each
subgroup keeps its N best, and the at most ``salts * N`` survivors of a group are ranked
again by score and identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 32


def top_items(df: DataFrame, group: str, item: str, score: str, n: int, salts: int = SALTS) -> DataFrame:
    """(group, item, score, rank): the ``n`` items with the highest score, ties by the lower item.

    Rows with a NULL group, a NULL item or a NULL or NaN score are not ranked. Rows that
    repeat an item in a group with the same score count once: they hash to one subgroup and
    share a dense rank there, so no separate deduplication shuffles all rows.
    """
    rows = df.select(group, item, score).where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    order = [F.col(score).desc(), F.col(item).asc()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts)).cast("int"))
    first = salted.withColumn("_r", F.dense_rank().over(W.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    second = first.select(group, item, score).withColumn("rank", F.dense_rank().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
    return second.dropDuplicates([group, item, "rank"])
