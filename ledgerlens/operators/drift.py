"""Drift between two samples, and precision budgets over a history of estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import quantiles

# Bins of a histogram, smoothing, alert levels, budget bounds and steps.
BINS, TINY = 20, 1e-10
PSI_ALERT, KL_SHIFT = 0.3, 0.15
BASE, LOWEST, HIGHEST, WINDOW = 0.60, 0.55, 0.75, 10
#: Share of online estimates in the blend with evaluations.
ONLINE = 0.7


def psi(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """One row (column, psi, alert): population stability over the train sample's deciles.

    Values out of the train range fall out, the last bin is closed; counts are smoothed by
    one. With fewer than three different edges psi is NULL.
    """
    edges = sorted({x for x in quantiles(train, column, [i / 10 for i in range(11)]) if x is not None})
    spark = train.sparkSession
    if len(edges) < 3:
        return spark.createDataFrame([(column, None, False)], "column string, psi double, alert boolean")
    bins = len(edges) - 1
    v = F.col(column).cast("double")
    inside = v.isNotNull() & ~F.isnan(v) & (v >= edges[0]) & (v <= edges[-1])
    bin_ = F.least(F.size(F.filter(F.lit(edges[1:]), lambda e: e <= v)), F.lit(bins - 1))
    rows = train.select(F.lit(1).alias("t"), v.alias(column)).unionByName(test.select(F.lit(0).alias("t"), v.alias(column))).where(inside)
    counts = rows.groupBy(bin_.alias("bin")).agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0)
    sums = W.partitionBy()  # a row per bin
    a = (F.col("a") + 1) / (F.sum("a").over(sums) + len(edges))
    b = (F.col("b") + 1) / (F.sum("b").over(sums) + len(edges))
    terms = every.select(a.alias("a"), b.alias("b"))
    return terms.agg(F.sum((F.col("a") - F.col("b")) * F.log(F.col("a") / F.col("b"))).alias("psi")).select(F.lit(column).alias("column"), "psi", (F.col("psi") > PSI_ALERT).alias("alert"))


def histogram(df: DataFrame, score: str = "score", *groups: str) -> DataFrame:
    """(groups, bin, p): shares of 20 equal bins over 0..1, smoothed and adding up to 1; scores outside fall out."""
    bin_ = F.least(F.floor(F.col(score) * BINS), F.lit(BINS - 1)).cast("int")
    counts = df.where(F.col(score).between(0.0, 1.0)).groupBy(*groups, bin_.alias("bin")).agg(F.count("*").alias("n"))
    full = counts.select(*groups).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1)))).join(counts, [*groups, "bin"], "left").na.fill(0, ["n"])
    own = W.partitionBy(*groups)
    raw = full.withColumn("d", F.col("n") / F.sum("n").over(own) * BINS + TINY)
    return raw.select(*groups, "bin", (F.col("d") / F.sum("d").over(own)).alias("p"))


def kl_divergence(now: DataFrame, reference: DataFrame, *groups: str) -> DataFrame:
    """(groups, kl) of two histograms; a group without a reference gives 0."""
    both = now.join(reference.select(*groups, "bin", F.col("p").alias("q")), [*groups, "bin"], "left")
    return both.groupBy(*groups).agg(F.coalesce(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), F.lit(0.0)).alias("kl"))


def moving_reference(ordered: Column, alpha: float = 0.1) -> Column:
    """Exponential moving average over an ordered array of histograms (arrays), brought to 1 after each step; the first is the start."""
    start = F.element_at(ordered, 1)

    def step(old: Column, new: Column) -> Column:
        mixed = F.zip_with(old, new, lambda a, b: (1 - alpha) * a + alpha * b)
        return F.transform(mixed, lambda x: x / F.aggregate(mixed, F.lit(0.0), lambda s, y: s + y))

    return F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), start, step)


def drift_class(precision: Column, budget: Column, kl: Column) -> Column:
    """precision_degraded where precision is known and below budget, benign_shift where the divergence is large, no_drift otherwise."""
    return F.when(precision < budget, "precision_degraded").when(kl > KL_SHIFT, "benign_shift").otherwise("no_drift")


def budget(mean: Column, kl: Column) -> Column:
    """The precision asked for, from the mean of the trailing estimates (NULL: none) and the divergence; four decimals."""
    raw = F.when(mean.isNull(), F.lit(BASE)).when(mean > 0.70, F.least(F.lit(BASE + 0.05), F.lit(HIGHEST))).when(mean < 0.65, F.greatest(F.lit(BASE - 0.02), F.lit(LOWEST))).otherwise(F.lit(BASE))
    return F.round(F.least(F.when(kl > 0.10, raw + 0.03).otherwise(raw), F.lit(HIGHEST)), 4)


def trailing_budget(history: DataFrame, key: str = "path_id", order: str = "seq") -> DataFrame:
    """history (key, order, precision, kl) with mean_10 and budget after each estimate."""
    last = W.partitionBy(key).orderBy(order).rowsBetween(1 - WINDOW, 0)
    return history.withColumn("mean_10", F.avg("precision").over(last)).withColumn("budget", budget(F.col("mean_10"), F.col("kl")))


def evaluated(rows: DataFrame, key: str = "path_id", order: str = "seq") -> DataFrame:
    """(key, order, precision, kl, mean_10, budget) of rows (key, order, score, label), one evaluation for each of their periods.

    kl is the divergence of a period's scores from the moving reference, 0 for the first
    period; a period whose precision is no more than 0.05 below its budget moves the reference.
    """
    bins = histogram(rows, "score", key, order).groupBy(key, order).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))), lambda x: x["p"]).alias("h"))  # 20 values
    each = rows.groupBy(key, order).agg(F.avg("label").alias("precision")).join(bins, [key, order])
    ordered = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "precision", "h"))).alias("_o"))  # a value per period
    done = f"array<struct<{order}:bigint,precision:double,kl:double,mean_10:double,budget:double>>"
    start = F.struct(F.lit(None).cast("array<double>").alias("ref"), F.array().cast("array<double>").alias("last"), F.array().cast(done).alias("out"))

    def step(s: Column, x: Column) -> Column:
        last = F.concat(F.when(F.size(s["last"]) >= WINDOW, F.slice(s["last"], 2, WINDOW - 1)).otherwise(s["last"]), F.array(x["precision"]))
        mean = F.aggregate(last, F.lit(0.0), lambda a, b: a + b) / F.size(last)
        kl = F.coalesce(F.aggregate(F.zip_with(x["h"], s["ref"], lambda p, q: p * F.log(p / q)), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
        asked = budget(mean, kl)
        moved = F.coalesce(moving_reference(F.when(s["ref"].isNotNull(), F.array(s["ref"], x["h"]))), x["h"])
        row = F.struct(x[order].cast("bigint").alias(order), x["precision"].alias("precision"), kl.alias("kl"), mean.alias("mean_10"), asked.alias("budget"))
        return F.struct(F.when(x["precision"] >= asked - 0.05, moved).otherwise(s["ref"]).alias("ref"), last.alias("last"), F.concat(s["out"], F.array(row)).alias("out"))

    return ordered.select(key, F.explode(F.aggregate("_o", start, step, lambda s: s["out"])).alias("_e")).select(key, "_e.*")


def blended(online: Column, shadow: Column) -> Column:
    """0.7 of the mean of online estimates and 0.3 of that of evaluations; one alone where the other is NULL."""
    return F.coalesce(ONLINE * online + (1 - ONLINE) * shadow, online, shadow)


def adjusted_budget(ordered: Column, base: float = BASE, kl: Column | None = None) -> Column:
    """Budget after an ordered array of estimates: five in a row above base + 0.10 raise it by 0.05, three in a row within 0.05 of it lower it by 0.02, a divergence above 0.10 raises it by 0.03, within bounds."""
    start = F.struct(F.lit(0.0).alias("adj"), F.lit(0).alias("high"), F.lit(0).alias("near"))

    def step(s: Column, p: Column) -> Column:
        high = F.when(p > base + 0.10, s["high"] + 1).otherwise(0)
        near = F.when(F.abs(p - base) <= 0.05, s["near"] + 1).otherwise(0)
        raised = F.when(high >= 5, F.least(s["adj"] + 0.05, F.lit(HIGHEST - base))).otherwise(s["adj"])
        lowered = F.when(near >= 3, F.greatest(raised - 0.02, F.lit(LOWEST - base))).otherwise(raised)
        return F.struct(lowered.alias("adj"), high.alias("high"), near.alias("near"))

    total = F.aggregate(ordered, start, step, lambda s: s["adj"])
    if kl is not None:
        total = total + F.when(kl > 0.10, 0.03).otherwise(0.0)
    return F.round(F.greatest(F.least(total + base, F.lit(HIGHEST)), F.lit(LOWEST)), 4)


def shadow_evaluation(rows: DataFrame, reference: DataFrame, group: str, key: str, k: int = 50, least: int = 200, score: str = "score", label: str = "label", budget_mean: float | None = None) -> DataFrame:
    """(group, n, precision, kl, budget, escalate, moves_reference): each group's held-out rows judged by their best ``k``.

    reference: a histogram (bin, p) the scores are compared with. escalate where precision
    is more than 0.05 below the budget that goes with the divergence; otherwise the group's
    scores may move the reference. A group of fewer than ``least`` rows is not evaluated
    (NULL). Ranks are limited before the exchange, so a large group is no single task.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(group).isNotNull())
    best = known.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), key))).where(F.col("_r") <= k)
    hits = best.groupBy(group).agg(F.sum(label).alias("_hits"))
    sizes = known.groupBy(group).agg(F.count("*").alias("n"))
    bins = histogram(known, score, group)
    kl = bins.join(F.broadcast(reference.select("bin", F.col("p").alias("q"))), "bin").groupBy(group).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))  # BINS rows
    out = sizes.join(hits, group).join(kl, group, "left").withColumn("precision", F.when(F.col("n") >= least, F.col("_hits") / F.least(F.col("n"), F.lit(k))))
    asked = budget(F.lit(budget_mean).cast("double"), F.coalesce("kl", F.lit(0.0)))
    out = out.withColumn("budget", asked).withColumn("escalate", F.col("precision") < F.col("budget") - 0.05)
    return out.select(group, "n", "precision", "kl", "budget", "escalate", (~F.col("escalate")).alias("moves_reference"))


def clean_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """NaN as the median of the others; where an infinite score is left, all clipped to 0..1. Where there was a NaN, infinities have become finite by then and clip alike."""
    median = quantiles(df, score, [0.5])[0]
    fixed = F.coalesce(F.nanvl(score, F.lit(median).cast("double")), F.lit(median).cast("double"))
    return df.withColumn(score, F.when(F.abs(fixed) == float("inf"), F.greatest(F.least(fixed, F.lit(1.0)), F.lit(0.0))).otherwise(fixed))
