"""Transaction features: time of day, pairs, velocity, thresholds, account risk rates.

Statistics of a group are aggregated first and joined back, never a window over the group:
a sender with a tenth of all rows is aggregated on the map side, and an adaptive skew join
splits its rows, where a window would sort them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADES = {"RISK-LOW": 1, "RISK-MED": 2, "RISK-HIGH": 3}
THRESHOLDS = (100_000, 500_000, 1_000_000)
VELOCITY_ROWS = 10
#: Rows of one stretch of row_index.
SHARD_ROWS = 1 << 16
#: Most burst ratio told apart.
MOST_BURST = 100.0
LEAKY = ("sender_account_age_days", "receiver_account_age_days", "tx_count_30")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def risk_value(grade: str = "risk_grade") -> Column:
    """LOW 1, MED 2, HIGH 3; any other grade and NULL 1."""
    out = F.lit(1)
    for name, value in GRADES.items():
        out = F.when(F.col(grade) == name, value).otherwise(out)
    return out


def account_risk_rates(accounts: DataFrame) -> DataFrame:
    """accounts with the mean grade of their institution and of their branch; NULL for accounts without one."""
    rated = accounts.withColumn("risk_numeric", risk_value())
    for group in ("institution", "branch"):
        rate = rated.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg("risk_numeric").alias(f"{group}_risk_rate"))
        rated = rated.join(rate, group, "left")
    return rated


def one_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first by ``order``, ties by the row's content."""
    others = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in others if c not in order])
    row = df.groupBy(key).agg(F.min(packed).alias("_r"))
    return row.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def hour_of_day(tx: DataFrame, raw: str = "tm", out: str = "hour") -> DataFrame:
    """Hour of a valid time. Only where no row at all has one, the first two signs count as a number; 12 where nothing gives an hour."""
    parsed = F.hour(F.try_to_timestamp(F.col(raw), F.lit("HH:mm:ss")))
    none = tx.agg(F.count(parsed) == 0).scalar()
    rough = F.try_to_number(F.substring(raw, 1, 2), F.lit("99")).cast("int")
    return tx.withColumn(out, F.coalesce(parsed, F.when(none, rough), F.lit(12)))


def temporal(tx: DataFrame) -> DataFrame:
    """hour, is_off_hours, is_late_night, day_of_week (Monday 0; NULL without a date), is_weekend."""
    h = F.col("hour")
    return hour_of_day(tx).withColumns({
        "is_off_hours": ((h < 9) | (h >= 17)).cast("int"),
        "is_late_night": ((h >= 23) | (h < 5)).cast("int"),
        "day_of_week": F.weekday("day"),
        "is_weekend": F.coalesce(F.weekday("day") >= 5, F.lit(False)).cast("int"),
    })


def pair_features(tx: DataFrame) -> DataFrame:
    """pair_tx_sequence (from 0, by row_index), pair_total_txs (amounts that are there), pair_amount_deviation, is_one_shot_pair.

    Rows without a sender or receiver belong to no pair and get NULL, but 0 for the flag.
    Sequences are counted in stretches of row_index, so a pair of any size is many tasks.
    """
    pairs = tx.where("s IS NOT NULL AND r IS NOT NULL").withColumn("_h", F.floor(F.col("row_index") / SHARD_ROWS))
    stats = pairs.groupBy("s", "r").agg(F.count("amount").alias("pair_total_txs"), F.avg("amount").alias("_mean"))
    shards = pairs.groupBy("s", "r", "_h").agg(F.count("*").alias("_c"))
    earlier = F.sum("_c").over(W.partitionBy("s", "r").orderBy("_h").rowsBetween(W.unboundedPreceding, -1))
    shards = shards.select("s", "r", "_h", F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("s", "r", "_h").orderBy("row_index"))
    return (
        tx.withColumn("_h", F.floor(F.col("row_index") / SHARD_ROWS))
        .withColumn("_own", own)
        .join(shards, ["s", "r", "_h"], "left")
        .withColumn("pair_tx_sequence", (F.col("_before") + F.col("_own") - 1).cast("int"))
        .drop("_h", "_own", "_before")
        .join(stats, ["s", "r"], "left")
        .withColumn("pair_amount_deviation", F.abs(F.col("amount") - F.col("_mean")))
        .withColumn("is_one_shot_pair", F.coalesce(F.col("pair_total_txs") == 1, F.lit(False)).cast("int"))
        .drop("_mean")
    )


def sender_zscore(tx: DataFrame) -> DataFrame:
    """amount_zscore_sender: sample deviation, 1 where there is none, at least 1."""
    stats = tx.where("s IS NOT NULL").groupBy("s").agg(F.avg("amount").alias("_m"), F.stddev_samp("amount").alias("_d"))
    z = (F.col("amount") - F.col("_m")) / F.greatest(F.coalesce(F.col("_d"), F.lit(1.0)), F.lit(1.0))
    return tx.join(stats, "s", "left").withColumn("amount_zscore_sender", z).drop("_m", "_d")


def near_thresholds(tx: DataFrame, amount: str = "amount") -> DataFrame:
    """near_threshold_<k>k: from 80 % of the threshold up to below it."""
    a = F.col(amount)
    return tx.withColumns({f"near_threshold_{t // 1000}k": F.coalesce((a >= 0.8 * t) & (a < t), F.lit(False)).cast("int") for t in THRESHOLDS})


def burst_ratio() -> Column:
    """velocity_sum_10tx over tx_count_30 times the amount (at least 1), at most 100; 100 for x/0 with x above 0, 0 for 0/0 and NULL."""
    top = F.col("velocity_sum_10tx")
    below = F.col("tx_count_30") * F.greatest(F.col("amount"), F.lit(1.0))
    return F.coalesce(
        F.when((below == 0) & (top > 0), MOST_BURST).when(below == 0, 0.0).otherwise(F.least(top / F.when(below != 0, below), F.lit(MOST_BURST))),
        F.lit(0.0),
    )


def trailing_counts(tx: DataFrame) -> DataFrame:
    """tx_count_10 and tx_count_30: the sender's transactions in the trailing 10 and 30 days, the day included; NULL without sender or day.

    Counted per sender and day first, so the window holds one row per day.
    """
    days = tx.where("s IS NOT NULL AND day IS NOT NULL").groupBy("s", "day").agg(F.count("*").alias("n"))
    by_day = W.partitionBy("s").orderBy(F.unix_date("day"))
    rolled = days.select("s", "day", *(F.sum("n").over(by_day.rangeBetween(1 - k, 0)).alias(f"tx_count_{k}") for k in (10, 30)))
    return tx.join(rolled, ["s", "day"], "left")


def velocity(tx: DataFrame, rows: int = VELOCITY_ROWS) -> DataFrame:
    """velocity_sum_10tx: sum of the sender's last 10 amounts by (day, tm, row_index), the row's own included; NULL without sender or day.

    Sharded by sender, day and hour: a row with nine before it in its shard needs no other;
    the first nine of each shard look at the last nine of the shards before, at most 18 rows
    of a shard, so that no task sorts a whole sender.
    """
    dated = tx.where("s IS NOT NULL AND day IS NOT NULL").select("row_index", "s", "day", "tm", "amount", F.coalesce(F.substring("tm", 1, 2), F.lit("")).alias("shard"))
    order = [F.col("day"), F.col("tm").asc_nulls_first(), F.col("row_index")]
    back = [F.col("day"), F.col("tm").desc_nulls_last(), F.col("row_index").desc()]
    shard = W.partitionBy("s", "day", "shard")
    ranked = dated.withColumns({
        "_up": F.row_number().over(shard.orderBy(*order)), "_down": F.row_number().over(shard.orderBy(*back)),
        "_own": F.sum("amount").over(shard.orderBy(*order).rowsBetween(1 - rows, 0)),
    })
    edge = ranked.where((F.col("_up") < rows) | (F.col("_down") < rows)).withColumn(
        "_sum", F.sum("amount").over(W.partitionBy("s").orderBy(*order).rowsBetween(1 - rows, 0))
    )
    first = edge.where(F.col("_up") < rows).select("row_index", F.col("_sum").alias("velocity_sum_10tx"))
    later = ranked.where(F.col("_up") >= rows).select("row_index", F.col("_own").alias("velocity_sum_10tx"))
    return tx.join(first.unionByName(later), "row_index", "left")


def behaviour(tx: DataFrame) -> DataFrame:
    """tx with the three running columns that features and rules build on."""
    return velocity(trailing_counts(tx))


def role_join(tx: DataFrame, vertex: DataFrame, key: str, columns: dict[str, str], roles: tuple[tuple[str, str], ...] = (("s", "sender"), ("r", "receiver"))) -> DataFrame:
    """Left joins of a vertex table for sender and receiver; columns: name in the table -> name behind the role's prefix.

    The key must be unique in the table, as accounts.account_id is.
    """
    for column, role in roles:
        side = vertex.select(F.col(key).alias(column), *(F.col(c).alias(f"{role}_{name}") for c, name in columns.items()))
        tx = tx.join(side, column, "left")
    return tx


def training_rows(tx: DataFrame, accounts: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """The wide training relation: temporal, pair, velocity and threshold features, account risk of both roles, graph features where given (NULL as 0)."""
    wide = near_thresholds(sender_zscore(pair_features(temporal(behaviour(tx))))).withColumn("velocity_burst_ratio", burst_ratio())
    rates = account_risk_rates(one_per_key(accounts, "account_id"))
    wide = role_join(wide, rates, "account_id", {"institution_risk_rate": "institution_risk", "branch_risk_rate": "branch_risk", "risk_grade": "kyc_risk_grade"})
    if graph is not None and "account_id" in graph.columns:
        names = {c: c for c in graph.columns if c != "account_id"}
        wide = role_join(wide, graph, "account_id", names)
        wide = wide.na.fill(0, subset=[f"{role}_{c}" for role in ("sender", "receiver") for c in names])
    return wide


def temporal_split(tx: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """split: rows by (day, tm, row_index), cut at the shares' row numbers; rows without a day come last.

    Row numbers are global but no task sorts all rows: rows are counted per day and hour,
    inside an hour per time (at most as many as it has seconds), inside a time per stretch
    of row_index, and numbered inside that, so neither undated rows nor those without a
    time are one task.
    """
    day, tm = F.coalesce(F.unix_date("day"), F.lit(2**31 - 1)), F.coalesce("tm", F.lit("~"))
    placed = tx.withColumns({"_d": day, "_t": tm, "_s": F.substring(tm, 1, 2), "_h": F.floor(F.col("row_index") / SHARD_ROWS)})
    parts = placed.groupBy("_d", "_s", "_t", "_h").agg(F.count("*").alias("_c"))
    hours = parts.groupBy("_d", "_s").agg(F.sum("_c").alias("_c"))
    hours = hours.select("_d", "_s", F.coalesce(F.sum("_c").over(W.orderBy("_d", "_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b0"), F.sum("_c").over(W.partitionBy()).alias("_all"))  # a row per hour
    times = parts.groupBy("_d", "_s", "_t").agg(F.sum("_c").alias("_c"))
    times = times.withColumn("_b1", F.coalesce(F.sum("_c").over(W.partitionBy("_d", "_s").orderBy("_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inner = F.coalesce(F.sum("_c").over(W.partitionBy("_d", "_s", "_t").orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_b2", inner).join(times, ["_d", "_s", "_t"]).join(hours, ["_d", "_s"]).drop("_c")
    own = F.row_number().over(W.partitionBy("_d", "_s", "_t", "_h").orderBy("row_index"))
    joined = placed.withColumn("_in", own).join(parts, ["_d", "_s", "_t", "_h"])
    at = F.col("_b0") + F.col("_b1") + F.col("_b2") + F.col("_in") - 1
    cut_1, cut_2 = F.floor(F.col("_all") * F.lit(float(train))), F.floor(F.col("_all") * F.lit(train + validation))
    split = F.when(at < cut_1, "train").when(at < cut_2, "validation").otherwise("test")
    return joined.withColumn("split", split).select(*tx.columns, "split")


def until(edges: DataFrame, day: Column, time: Column | None = None) -> DataFrame:
    """The edges up to a cutoff day, on that day up to a time, texts compared as texts."""
    keep = edges["day"] < day
    keep = keep | ((edges["day"] == day) & (edges["tm"] <= time)) if time is not None else keep | (edges["day"] == day)
    return edges.where(keep)


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_present, n_distinct, null_share, kept, warned): a column is kept with more than one value, warned of above 80 % NULL."""
    one = df.agg(*(F.struct(F.count(c).alias("n"), F.countDistinct(c).alias("d"), F.avg(F.col(c).isNull().cast("double")).alias("e")).alias(c) for c in columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns))).alias("y"))
    return rows.select(
        F.col("y.column").alias("column"), F.col("y.x.n").alias("n_present"), F.col("y.x.d").alias("n_distinct"), F.coalesce("y.x.e", F.lit(1.0)).alias("null_share"),
        (F.col("y.x.d") > 1).alias("kept"), (F.coalesce("y.x.e", F.lit(1.0)) > 0.8).alias("warned"),
    )


def kept_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns asked for that are there and kept; leaky ones are left out."""
    there = [c for c in columns if c in df.columns and c not in LEAKY]
    kept = df.agg(*((F.min(c) < F.max(c)).alias(c) for c in there)).first() if there else {}
    return [c for c in there if kept[c]]


def momentum(tx: DataFrame) -> DataFrame:
    """(account_id, mean_10, mean_30, momentum) per sender: rising where the recent mean is above three quarters of the older part, declining below a quarter."""
    mean = tx.where("s IS NOT NULL").groupBy(F.col("s").alias("account_id")).agg(F.avg("tx_count_10").alias("mean_10"), F.avg("tx_count_30").alias("mean_30"))
    old = F.col("mean_30") - F.col("mean_10")
    return mean.withColumn(
        "momentum", F.when((old > 0) & (F.col("mean_10") > 0.75 * old), "rising").when((old > 0) & (F.col("mean_10") < 0.25 * old), "declining").otherwise("stable")
    )


def readable(name: Column, known: dict[str, str]) -> Column:
    """The label of a feature; others in title case with blanks for underscores."""
    labels = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else None
    title = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(labels, name), title) if labels is not None else title


# Labels of features.
FEATURE_LABELS = {
    "velocity_sum_10tx": "Transaction velocity (10-tx window)",
    "amount_local_npr": "Transaction amount (NPR)",
    "cross_border_flag": "Cross-border transaction",
    "tx_count_10": "Transaction count (10-day)",
    "tx_count_30": "Transaction count (30-day)",
    "sender_gf_pagerank": "Sender network centrality (PageRank)",
    "receiver_gf_pagerank": "Receiver network centrality (PageRank)",
    "sender_gf_out_degree": "Sender outgoing connections",
    "sender_gf_in_degree": "Sender incoming connections",
    "receiver_gf_in_degree": "Receiver incoming connections",
    "sender_gf_betweenness": "Sender bridge centrality",
    "receiver_gf_betweenness": "Receiver bridge centrality",
    "sender_gf_hub_score": "Sender hub score (distributor)",
    "receiver_gf_authority_score": "Receiver authority score (collector)",
    "sender_gf_in_cycle": "Sender in transaction cycle",
    "sender_institution_risk": "Sender institution risk rating",
    "receiver_institution_risk": "Receiver institution risk rating",
    "is_off_hours": "Off-hours transaction",
    "is_weekend": "Weekend transaction",
    "pair_total_txs": "Pair transaction frequency",
    "amount_zscore_sender": "Amount deviation from sender norm",
    "near_threshold_100k": "Near 100K threshold (structuring)",
    "near_threshold_500k": "Near 500K threshold (structuring)",
}
