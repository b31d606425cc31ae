"""Quality of a ranking by score, ties settled by a unique key."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import in_order, quantiles
from ledgerlens.session import materialise


def top(df: DataFrame, k: int, score: str = "score", key: str = "row_index") -> DataFrame:
    """The k rows with the highest score (taken without a full sort), with _rank."""
    best = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(k)
    return best.withColumn("_rank", F.row_number().over(W.orderBy(F.desc(score), key)))  # k rows


def at_k(df: DataFrame, k: int, score: str = "score", label: str = "label", key: str = "row_index") -> DataFrame:
    """One row: precision (over k even where there are fewer rows), precision over the rows there are, recall, ndcg and lift at k; 0 where nothing is labelled, lift 1 or infinite where the base rate is 0."""
    best = top(df, k, score, key).agg(
        F.coalesce(F.sum(label), F.lit(0)).alias("hits"), F.count("*").alias("n_top"), F.coalesce(F.sum(F.col(label) / F.log2(F.col("_rank") + 1)), F.lit(0.0)).alias("dcg")
    )
    whole = df.where(F.col(score).isNotNull()).agg(F.coalesce(F.sum(label), F.lit(0)).alias("positives"), F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("positives"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    both = best.select("*", whole.select("positives").scalar().alias("positives"), whole.select("n").scalar().alias("n"))
    p, base = F.col("hits") / k, F.col("positives") / F.greatest(F.col("n"), F.lit(1))
    some = F.col("positives") > 0
    return both.select(
        F.lit(k).alias("k"), p.alias("precision"), F.when(F.col("n_top") > 0, F.col("hits") / F.greatest(F.col("n_top"), F.lit(1))).otherwise(0.0).alias("precision_of_rows"),
        F.when(some, F.col("hits") / F.when(some, F.col("positives"))).otherwise(0.0).alias("recall"), F.when(some, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        F.when(base > 0, p / F.when(base > 0, base)).when(p > 0, F.lit(math.inf)).otherwise(1.0).alias("lift"),
    )


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the step-wise area under precision and recall over distinct thresholds; 0 without a positive."""
    steps = df.where(F.col(score).isNotNull()).groupBy((-F.col(score)).cast("double").alias("_v")).agg(F.count("*").alias("_n"), F.sum(label).alias("_p"))
    run = in_order(steps, "_v", "_v", {"_seen": "_n", "_hit": "_p"})
    sums = run.agg(F.sum(F.col("_p") * F.col("_hit") / F.col("_seen")).alias("a"), F.sum("_p").alias("p"))
    return sums.select(F.when(F.col("p") > 0, F.col("a") / F.when(F.col("p") > 0, F.col("p"))).otherwise(0.0).alias("average_precision"))


def brier(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2.0)).alias("brier"))


def score_stats(df: DataFrame, score: str = "score") -> DataFrame:
    """One row: mean, population deviation, least, most, exact median, shares above 0.5 and 0.9 of the scores that are there."""
    median = quantiles(df, score, [0.5])[0]
    s = F.col(score)
    return df.where(s.isNotNull()).agg(
        F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("least"), F.max(s).alias("most"), F.lit(median).cast("double").alias("median"),
        F.avg((s > 0.5).cast("double")).alias("above_half"), F.avg((s > 0.9).cast("double")).alias("above_nine_tenths"),
    )


#: The measures of a ranking that are told together, each at its places.
BUNDLE = (("precision", (10, 50, 100)), ("recall", (50, 100)), ("ndcg", (50, 100)), ("lift", (50,)))


def bundle(df: DataFrame, score: str = "score", label: str = "label", key: str = "row_index") -> DataFrame:
    """One row: precision_10/50/100, recall_50/100, ndcg_50/100, lift_50 and average_precision."""
    tables = {k: at_k(df, k, score, label, key) for k in sorted({k for _, ks in BUNDLE for k in ks})}
    one = average_precision(df, score, label)
    return one.select(*(tables[k].select(name).scalar().alias(f"{name}_{k}") for name, ks in BUNDLE for k in ks), "average_precision")


def truth_and_score(df: DataFrame, truth: tuple[str, ...] = ("is_suspicious_tx", "label"), score: tuple[str, ...] = ("predicted_score", "risk_score", "ml_score", "score", "tx_score")) -> DataFrame:
    """df with label and score from the first of the named columns that it has; an error where it has none, as nothing is made up."""
    found = []
    for wanted, names in (("label", truth), ("score", score)):
        there = [c for c in names if c in df.columns]
        if not there:
            raise ValueError(f"no column for {wanted}: none of {', '.join(names)}")
        found.append(F.col(there[0]).alias(wanted))
    return df.select(*(c for c in df.columns if c not in ("label", "score")), *found)


def precision_of_sample(used: Column, label: Column, place: Column, k: int) -> Column:
    """Of the ``k`` places of a resample, ``used`` of them by one row: the row's part of precision at k. place: the first of its places."""
    return used * label / k


def dcg_of_sample(used: Column, label: Column, place: Column, k: int) -> Column:
    """The row's part of the discounted gain at k: the sum over its places."""
    places = F.sequence(place, place + F.greatest(used - 1, F.lit(0)))
    return F.when(used > 0, label * F.aggregate(places, F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))).otherwise(0.0)


def bootstrap(df: DataFrame, k: int, metric: Callable[[Column, Column, Column, int], Column] = precision_of_sample, replicates: int = 500, seed: int = 42,
              score: str = "score", label: str = "label", key: str = "row_index") -> DataFrame:
    """One row: mean and 2.5/97.5 percentiles of a ranking metric at k over Poisson(1) resamples drawn from a hash of key and replicate.

    metric: a row's part of the metric from the number of its copies among the first k
    places, its label, its first place and k; the parts add up. The first k places of a
    resample are filled by the best rows until their drawn weights reach k. Only as many of
    the best rows are drawn as every replicate needs: a stretch that turns out too short is
    doubled, up to all rows, so the result is that of all rows whatever k is.
    """
    need, n = 4 * k + 100, df.where(F.col(score).isNotNull()).count()
    while True:
        best = top(df, min(need, max(n, 1)), score, key)
        u = (F.pmod(F.xxhash64(F.col(key), F.col("b"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        weight, total, p = F.lit(0), 0.0, math.exp(-1)
        for i in range(1, 20):  # beyond, a Poisson(1) weight has a chance below 2**-40, the grain of u
            total += p
            weight = F.when(u >= total, i).otherwise(weight)
            p /= i
        drawn = best.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
        before = F.coalesce(F.sum("w").over(W.partitionBy("b").orderBy("_rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        used = drawn.withColumn("_before", before).withColumn("u", F.greatest(F.least(F.col("w"), F.lit(k) - F.col("_before")), F.lit(0)))
        part = metric(F.col("u"), F.col(label), F.col("_before") + 1, k)
        each = materialise(used.groupBy("b").agg(F.sum(part).alias("p"), F.sum("u").alias("filled")))  # a row per replicate
        if need >= n or not each.where(F.col("filled") < k).limit(1).count():
            return each.agg(F.avg("p").alias("mean"), F.percentile("p", F.lit(0.025)).alias("low"), F.percentile("p", F.lit(0.975)).alias("high"))
        need *= 2


def bootstrap_precision(df: DataFrame, k: int, replicates: int = 500, seed: int = 42, score: str = "score", label: str = "label", key: str = "row_index") -> DataFrame:
    return bootstrap(df, k, precision_of_sample, replicates, seed, score, label, key)


def map_difference(one: DataFrame, other: DataFrame, key: str = "id", outer: bool = False) -> DataFrame:
    """One row: n, mean absolute and mean relative difference (in percent of the other; 0 where that is 0) of two value tables (key, value), over common keys or, outer, all keys with 0 for what is missing."""
    both = one.select(key, F.col("value").alias("a")).join(other.select(key, F.col("value").alias("b")), key, "full_outer" if outer else "inner").na.fill(0.0, ["a", "b"])
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("n"), F.avg(gap).alias("mean_abs"), F.avg(F.when(F.col("b") != 0, gap / F.abs(F.when(F.col("b") != 0, F.col("b"))) * 100).otherwise(0.0)).alias("mean_abs_pct"))


def improvement(before: DataFrame, after: DataFrame, metric: str, least: float = 0.10) -> DataFrame:
    """One row (metric, before, after, gain, relative, enough) from two one-row tables of ``at_k``: relative is infinite, or 0 without a gain, where the first is 0."""
    b, a = before.select(metric).scalar(), after.select(metric).scalar()
    both = before.sparkSession.range(1).select(F.lit(metric).alias("metric"), b.cast("double").alias("before"), a.cast("double").alias("after"))
    gain = F.col("after") - F.col("before")
    relative = F.when(F.col("before") != 0, gain / F.when(F.col("before") != 0, F.col("before"))).when(gain > 0, F.lit(math.inf)).otherwise(0.0)
    return both.withColumn("gain", gain).withColumn("relative", relative).withColumn("enough", F.col("relative") >= least)
