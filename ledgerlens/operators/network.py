"""Account networks with several kinds of vertices, inputs of learned graph models, and assertions on graph results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.graph import DECAY, DORMANT_CAP, aged, bursts, incident, vertices


def holder_table(kyc: DataFrame, name: str, *flags: str) -> DataFrame:
    """One row per holder's name with the highest of each flag; NULL names name nobody."""
    return kyc.where(F.col(name).isNotNull()).groupBy(name).agg(*(F.max(f).alias(f) for f in flags))


def heterogeneous(tx: DataFrame, accounts: DataFrame, holders: DataFrame, holder: str) -> dict[str, DataFrame]:
    """Vertex tables account (account_id, own columns) and holder, edge tables transacts (both ends known) and owns (account_id, holder)."""
    known = accounts.select(F.col("account_id")).where("account_id IS NOT NULL").distinct()
    transacts = tx.join(known.select(F.col("account_id").alias("s")), "s", "left_semi").join(known.select(F.col("account_id").alias("r")), "r", "left_semi")
    owns = accounts.select("account_id", holder).join(holders.select(holder), holder, "left_semi").select("account_id", holder).distinct()
    return {"account": accounts, "holder": holders, "transacts": transacts, "owns": owns}


def node_features(simple: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, amount, n_edges) per vertex of the simple graph, a self-loop on both sides."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return simple.select(F.explode(ends).alias("e"), "amount").groupBy("e.id").agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum("amount").alias("amount"), F.count("*").alias("n_edges")
    )


def busiest(simple: DataFrame, most: int) -> DataFrame:
    """The edges among the ``most`` vertices with the highest degree, ties by the lower id."""
    kept = incident(simple).groupBy("id").agg(F.count("*").alias("_d")).orderBy(F.desc("_d"), "id").limit(most).select("id")
    return simple.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")


def latest(edges: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows by the columns given, which must order them totally."""
    return edges.orderBy(*(F.desc(c) for c in order)).limit(n)


def assertions(edges: DataFrame, temporal_single: DataFrame, ranks: DataFrame, half_life: float) -> DataFrame:
    """(name, broken): how many rows break each rule that graph results must keep.

    decay: a row's weight (src, dst, amount, age, weight) is its amount decayed by its age;
    range: scores are not below 0 and normalised ones within 0..1; dormancy: no dormant
    vertex above the cap; bursts: every logged sender is a vertex and above the count.
    """
    expected = F.col("amount") * F.exp(-F.lit(DECAY / half_life) * F.greatest(F.col("age"), F.lit(0)))
    decay = temporal_single.agg(F.count_if(F.abs(F.col("weight") - expected) > 1e-9 * F.greatest(expected, F.lit(1.0))).alias("broken")).select(F.lit("decay").alias("name"), "broken")
    wide = ranks.agg(F.count_if((F.col("score") < 0) | (F.col("normalised") < 0) | (F.col("normalised") > 1)).alias("broken")).select(F.lit("range").alias("name"), "broken")
    top = ranks.agg(F.max(F.when(~F.col("dormant"), F.col("score")))).scalar()
    still = ranks.agg(F.count_if(F.col("dormant") & (F.col("score") > DORMANT_CAP * F.greatest(top, F.col("raw")) + 1e-12)).alias("broken")).select(F.lit("dormancy").alias("name"), "broken")
    logged = bursts(edges).join(vertices(edges), F.col("src") == F.col("id"), "left").agg(F.count_if(F.col("id").isNull() | (F.col("multiplier") <= 1)).alias("broken")).select(F.lit("bursts").alias("name"), "broken")
    return decay.unionByName(wide).unionByName(still).unionByName(logged)


def single_weights(edges: DataFrame, half_life: float) -> DataFrame:
    """Each row of the edges with its age and decayed weight."""
    old = aged(edges)
    return old.withColumn("weight", F.col("amount") * F.exp(-F.lit(DECAY / half_life) * F.greatest(F.col("age"), F.lit(0))))
