"""Risk of accounts from the scores of their transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.features import clip
from ledgerlens.operators.ordering import quantiles

# Weights of the composite, half-life in days, bands.
COMPOSITE = {"risk_time_decay": 0.30, "risk_top5_mean": 0.25, "risk_max": 0.20, "risk_high_ratio": 0.15, "risk_burst": 0.10}
DECAY, HALF_LIFE, HIGH = 0.693, 3.0, 0.5
BANDS = (("Critical", 0.99), ("High", 0.95), ("Medium", 0.80))
SALTS = 16


def by_role(tx: DataFrame, *columns: str) -> DataFrame:
    """Each transaction for its sender (side 0) and its receiver (side 1), a self-transfer twice; NULL accounts drop out."""
    roles = F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("account_id")), F.struct(F.lit(1).alias("side"), F.col("r").alias("account_id")))
    return tx.select(F.explode(roles).alias("_e"), *columns).select("_e.account_id", "_e.side", *columns).where("account_id IS NOT NULL")


def account_risk(tx: DataFrame, score: str = "score") -> DataFrame:
    """One row per account with the risk measures and their composite; ranking key risk_recent_weighted.

    Rows without a day do not count; a NULL or NaN score counts 0. Order is (day, side,
    row_index). Work is sharded by account and day: neighbours inside a day come from a
    window over the day, those between days from one row per day, so an account with a
    tenth of all rows is many tasks.
    """
    rows = by_role(tx.withColumn("_s", F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))), "row_index", "day", "_s").where("day IS NOT NULL")
    last = tx.where("day IS NOT NULL").agg(F.max("day")).scalar()
    weight = F.exp(-F.lit(DECAY / HALF_LIFE) * F.datediff(last, "day"))
    order = W.partitionBy("account_id", "day").orderBy("side", "row_index")
    inside = rows.withColumns({"_rn": F.row_number().over(order), "_step": F.col("_s") - F.lag("_s").over(order)})
    place = F.struct("side", "row_index")
    days = inside.groupBy("account_id", "day").agg(
        F.count("*").alias("n"), F.sum("_s").alias("sum"), F.sum(F.col("_s") * F.col("_s")).alias("squares"), F.max("_s").alias("max"), F.max("_step").alias("step"),
        F.count_if(F.col("_s") > HIGH).alias("high"), F.sum(F.col("_s") * F.col("_rn")).alias("ramp"), F.min_by("_s", place).alias("first"), F.max_by("_s", place).alias("last"),
        F.first(weight).alias("w"),
    )
    by_day = W.partitionBy("account_id").orderBy("day")
    days = days.withColumns({
        "_before": F.coalesce(F.sum("n").over(by_day.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_jump": F.col("first") - F.lag("last").over(by_day),
    })
    stats = days.groupBy("account_id").agg(
        F.sum("n").alias("tx_count"), F.max("max").alias("risk_max"), F.sum("sum").alias("_sum"), F.sum("squares").alias("_squares"),
        (F.sum(F.col("sum") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("risk_time_decay"),
        F.greatest(F.max("step"), F.max("_jump")).alias("_burst"), F.sum("high").alias("_high"), F.sum(F.col("ramp") + (F.col("_before") - 1) * F.col("sum")).alias("_ramp"),
    )
    n = F.col("tx_count")
    mean = F.col("_sum") / n
    # weights run from 0.5 to 1: their sum over n rows is 0.75 n
    ramp = (0.5 * F.col("_sum") + 0.5 * F.col("_ramp") / F.greatest(n - 1, F.lit(1))) / (0.75 * n)
    stats = stats.select(
        "account_id", "tx_count", "risk_max", mean.alias("risk_mean"), "risk_time_decay", F.coalesce("_burst", F.lit(0.0)).alias("risk_burst"),
        (F.col("_high") / n).alias("risk_high_ratio"), F.when(n > 1, F.sqrt(F.greatest(F.col("_squares") / n - mean * mean, F.lit(0.0)))).otherwise(0.0).alias("risk_volatility"),
        F.when(n > 1, ramp).otherwise(F.col("_sum")).alias("risk_ramp"),
    )
    out = stats.join(_top_mean(rows), "account_id")
    composite = sum((F.lit(w) * F.col(c) for c, w in COMPOSITE.items()), F.lit(0.0))
    return out.withColumn("risk_composite", composite).withColumn("risk_recent_weighted", clip(F.col("risk_composite"), 0.0, 1.0))


def _top_mean(rows: DataFrame, k: int = 5) -> DataFrame:
    """(account_id, risk_top5_mean), ranked in salted subgroups first."""
    order = [F.col("_s").desc(), F.col("row_index"), F.col("side")]
    salted = rows.select("account_id", "side", "row_index", "_s", F.pmod(F.xxhash64("row_index"), F.lit(SALTS)).alias("_salt"))
    first = salted.withColumn("_r", F.row_number().over(W.partitionBy("account_id", "_salt").orderBy(*order))).where(F.col("_r") <= k)
    second = first.withColumn("_r", F.row_number().over(W.partitionBy("account_id").orderBy(*order))).where(F.col("_r") <= k)
    return second.groupBy("account_id").agg(F.avg("_s").alias("risk_top5_mean"))


def priority_bands(risk: DataFrame, score: str = "risk_recent_weighted") -> DataFrame:
    """risk with priority: the bands above the exact quantiles of the score."""
    cuts = quantiles(risk, score, [q for _, q in BANDS])
    band = F.lit("Low")
    for (name, _), cut in reversed(list(zip(BANDS, cuts))):
        if cut is not None:
            band = F.when(F.col(score) >= cut, name).otherwise(band)
    return risk.withColumn("priority", band)


def account_facts(tx: DataFrame) -> DataFrame:
    """Counts, totals and ratios per account over both roles; a NULL amount adds 0.

    Rows are added up per account, side and counterparty first, so that counterparties are
    counted without a copy of every row for each count. Totals are given to six decimals, as
    the last bits of a sum follow the order of addition.
    """
    rows = by_role(tx.withColumn("_c", F.coalesce("amount", F.lit(0.0))), "s", "r", "_c", "cross_border_flag", "tx_count_10", "tx_count_30")
    pairs = rows.withColumn("_other", F.when(F.col("side") == 0, F.col("r")).otherwise(F.col("s"))).groupBy("account_id", "side", "_other").agg(
        F.count("*").alias("_n"), F.sum("_c").alias("_sum"), F.max("_c").alias("_max"), *(x for c in ("cross_border_flag", "tx_count_10", "tx_count_30") for x in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}")))
    )
    out, into = F.col("side") == 0, F.col("side") == 1

    def total(x: str, where: Column, none: float = 0.0) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(x))), F.lit(none))

    def mean(c: str, where: Column | None = None) -> Column:
        up, down = (F.col(f"_{k}_{c}") if where is None else F.when(where, F.col(f"_{k}_{c}")) for k in ("s", "n"))
        return F.try_divide(F.sum(up), F.sum(down))

    facts = pairs.groupBy("account_id").agg(
        total("_n", into, 0).cast("bigint").alias("count_in"), total("_n", out, 0).cast("bigint").alias("count_out"), F.round(total("_sum", into), 6).alias("total_in"), F.round(total("_sum", out), 6).alias("total_out"),
        F.count_if(into & F.col("_other").isNotNull()).alias("unique_senders"), F.count_if(out & F.col("_other").isNotNull()).alias("unique_receivers"),
        F.max("_max").alias("max_single_tx"), F.coalesce(mean("cross_border_flag", out), F.lit(0.0)).alias("cross_border_ratio_out"),
        mean("cross_border_flag").alias("cross_border_ratio"), mean("tx_count_10").alias("_recent"), mean("tx_count_30").alias("_past"),
    )
    return facts.withColumns({
        "avg_in_amount": F.col("total_in") / F.greatest(F.col("count_in"), F.lit(1)),
        "flow_ratio": F.when(F.col("total_in") > 0, F.col("total_out") / F.greatest(F.col("total_in"), F.lit(1.0))).otherwise(0.0),
        "activity_ratio": F.when(F.col("_past") > 0, F.col("_recent") / F.when(F.col("_past") > 0, F.col("_past"))).otherwise(F.coalesce("_recent", F.lit(0.0))),
    }).drop("_recent", "_past")


def peer_averages(tx: DataFrame) -> DataFrame:
    """One row: the means over all transactions that accounts are compared with."""
    return tx.agg(F.avg("velocity_sum_10tx").alias("mean_velocity"), F.avg("cross_border_flag").alias("mean_cross_border"), F.avg("tx_count_10").alias("mean_tx_count"))


def queue_report(risk: DataFrame, suspicious: DataFrame, k: int = 50) -> DataFrame:
    """One row: precision among the k riskiest accounts, the share of suspicious (account_id) among all, the improvement and the review saved, in percent."""
    top = risk.orderBy(F.desc("risk_recent_weighted"), "account_id").limit(k).select("account_id")
    n = risk.count()
    bad = suspicious.select("account_id").where("account_id IS NOT NULL").distinct()
    hits = top.join(bad, "account_id", "left_semi").agg(F.count("*").alias("hits"))
    base = risk.select("account_id").join(bad, "account_id", "left_semi").count() / n if n else 0.0
    precision = F.col("hits") / F.lit(max(min(k, n), 1))
    gain = (precision - base) / base * 100 if base else F.lit(0.0)
    return hits.select(precision.alias("precision"), F.lit(base).alias("expected"), gain.alias("improvement_pct"), F.lit((1 - min(k, n) / n) * 100 if n else 0.0).alias("review_saved_pct"))


def touching(tx: DataFrame, members: DataFrame) -> DataFrame:
    """The transactions with a sender or a receiver among the members (account_id), each once."""
    hit = by_role(tx, "row_index").join(members.select("account_id").distinct(), "account_id", "left_semi").select("row_index").distinct()
    return tx.join(hit, "row_index", "left_semi")


def both_known(tx: DataFrame, members: DataFrame) -> DataFrame:
    """The transactions with both ends among the members (account_id)."""
    one = members.select(F.col("account_id").alias("s")).distinct()
    return tx.join(one, "s", "left_semi").join(one.withColumnRenamed("s", "r"), "r", "left_semi")


def confidence(score: Column) -> Column:
    """How far a score is from undecided, 0 to 1."""
    return 2 * F.abs(score - 0.5)
