"""Queries over transaction and account features, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import features as f
from ledgerlens.sources.views import TX_SQL, accounts, transactions


def tx_temporal_features(spark, folder):
    return f.temporal(transactions(spark, folder)).select("row_index", "hour", "is_off_hours", "is_late_night", "day_of_week", "is_weekend")


def near_threshold(spark, folder):
    return f.near_thresholds(transactions(spark, folder)).select("row_index", "near_threshold_100k", "near_threshold_500k", "near_threshold_1000k")


def pair_interaction(spark, folder):
    out = f.pair_features(transactions(spark, folder))
    return out.select("row_index", "pair_tx_sequence", "pair_total_txs", F.round(F.col("pair_amount_deviation") + 1e-7, 4).alias("pair_amount_deviation"), "is_one_shot_pair")


def sender_velocity(spark, folder):
    out = f.behaviour(transactions(spark, folder))
    return out.select("row_index", "tx_count_10", "tx_count_30", F.round("velocity_sum_10tx", 2).alias("velocity_sum_10tx"), F.round(f.burst_ratio(), 6).alias("velocity_burst_ratio"))


def sender_zscore(spark, folder):
    return f.sender_zscore(transactions(spark, folder)).select("row_index", F.round("amount_zscore_sender", 6).alias("amount_zscore_sender"))


def institution_branch_risk(spark, folder):
    out = f.account_risk_rates(accounts(spark, folder))
    return out.select("account_id", "risk_numeric", F.round("institution_risk_rate", 6).alias("institution_risk_rate"), F.round("branch_risk_rate", 6).alias("branch_risk_rate"))


def role_join_training(spark, folder):
    rates = f.account_risk_rates(f.one_per_key(accounts(spark, folder), "account_id"))
    out = f.role_join(transactions(spark, folder), rates, "account_id", {"institution_risk_rate": "institution_risk", "risk_grade": "kyc_risk_grade"})
    return out.select("row_index", *(x for r in ("sender", "receiver") for x in (F.round(f"{r}_institution_risk", 6).alias(f"{r}_institution_risk"), f"{r}_kyc_risk_grade")))


def temporal_split(spark, folder):
    return f.temporal_split(transactions(spark, folder)).select("row_index", "split")


def split_audit(spark, folder):
    """Range of days, rows, labels and accounts of each split, and the accounts it shares with train."""
    tx = f.temporal_split(transactions(spark, folder))
    stats = tx.groupBy("split").agg(F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"), F.count("*").alias("n_tx"), F.sum("label").alias("n_labelled"), F.round(F.avg("label"), 6).alias("label_share"))
    members = tx.select("split", F.explode(F.array("s", "r")).alias("a")).where("a IS NOT NULL").distinct()
    seen = members.where("split = 'train'").select("a", F.lit(1).alias("seen"))
    counts = members.join(seen, "a", "left").groupBy("split").agg(F.count("*").alias("n_accounts"), F.count("seen").alias("n_in_train"))
    return stats.join(counts, "split")


def graph_cutoff_edges(spark, folder):
    """The transactions up to the last of the training split, as edges."""
    split = f.temporal_split(transactions(spark, folder)).where("day IS NOT NULL AND tm IS NOT NULL AND s IS NOT NULL AND r IS NOT NULL")
    end = split.where("split = 'train'").agg(F.max(F.struct("day", "tm")).alias("e")).select("e.*")
    return f.until(split, end.select("day").scalar(), end.select("tm").scalar()).select("row_index", F.col("s").alias("src"), F.col("r").alias("dst"), "amount")


def activity_momentum(spark, folder):
    out = f.momentum(f.trailing_counts(transactions(spark, folder)))
    return out.select("account_id", F.round("mean_10", 6).alias("mean_10"), F.round("mean_30", 6).alias("mean_30"), "momentum")


def column_validation(spark, folder):
    columns = ["amount", "cross_border_flag", "label", "score", "tm", "day"]
    out = f.column_report(transactions(spark, folder), columns)
    return out.withColumn("null_share", F.round("null_share", 6))


def feature_labels(spark, folder):
    names = sorted([*f.FEATURE_LABELS, "is_late_night", "pair_tx_sequence"])
    return spark.createDataFrame([(n,) for n in names], "feature string").select("feature", f.readable(F.col("feature"), f.FEATURE_LABELS).alias("label"))


QUERIES = {x.__name__: x for x in (
    tx_temporal_features, near_threshold, pair_interaction, sender_velocity, sender_zscore, institution_branch_risk, role_join_training,
    temporal_split, split_audit, graph_cutoff_edges, activity_momentum, column_validation, feature_labels,
)}

VELOCITY_SQL = """vel AS (SELECT *,
  CASE WHEN s IS NOT NULL AND day IS NOT NULL THEN count(*) OVER (PARTITION BY s ORDER BY day RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND CURRENT ROW) END AS tx_count_10,
  CASE WHEN s IS NOT NULL AND day IS NOT NULL THEN count(*) OVER (PARTITION BY s ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) END AS tx_count_30,
  CASE WHEN s IS NOT NULL AND day IS NOT NULL THEN sum(amount) OVER (PARTITION BY s ORDER BY (day IS NULL), day, tm NULLS FIRST, row_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS velocity_sum_10tx
  FROM tx)"""
SPLIT_SQL = """sp AS (SELECT *, CASE WHEN rn < floor(n * 0.6::DOUBLE) THEN 'train' WHEN rn < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY day NULLS LAST, tm NULLS LAST, row_index) - 1 AS rn, count(*) OVER () AS n FROM tx))"""
RATE_SQL = """rated AS (SELECT account_id, risk_grade, institution, branch, CASE risk_grade WHEN 'RISK-HIGH' THEN 3 WHEN 'RISK-MED' THEN 2 ELSE 1 END AS risk_numeric FROM accounts),
rates AS (SELECT *, CASE WHEN institution IS NOT NULL THEN avg(risk_numeric) OVER (PARTITION BY institution) END AS institution_risk_rate,
  CASE WHEN branch IS NOT NULL THEN avg(risk_numeric) OVER (PARTITION BY branch) END AS branch_risk_rate FROM rated)"""
_LABELS = ", ".join("('" + k + "', '" + v + "')" for k, v in f.FEATURE_LABELS.items())

ORACLES = {
    "tx_temporal_features": f"""WITH {TX_SQL}, h AS (SELECT *, coalesce(CAST(substr(tm, 1, 2) AS INTEGER), 12) AS hour FROM tx)
SELECT row_index, hour, CAST(hour < 9 OR hour >= 17 AS INTEGER) AS is_off_hours, CAST(hour >= 23 OR hour < 5 AS INTEGER) AS is_late_night,
  CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(coalesce(isodow(day) >= 6, false) AS INTEGER) AS is_weekend FROM h""",
    "near_threshold": f"WITH {TX_SQL} SELECT row_index, " + ", ".join(
        f"CAST(coalesce(amount >= {t} * 0.8 AND amount < {t}, false) AS INTEGER) AS near_threshold_{t // 1000}k" for t in f.THRESHOLDS) + " FROM tx",
    "pair_interaction": f"""WITH {TX_SQL} SELECT row_index, CASE WHEN s IS NOT NULL AND r IS NOT NULL THEN CAST(row_number() OVER w AS INTEGER) - 1 END AS pair_tx_sequence,
  CASE WHEN s IS NOT NULL AND r IS NOT NULL THEN count(amount) OVER p END AS pair_total_txs,
  CASE WHEN s IS NOT NULL AND r IS NOT NULL THEN round(abs(amount - avg(amount) OVER p) + 1e-7, 4) END AS pair_amount_deviation,
  CAST(s IS NOT NULL AND r IS NOT NULL AND count(amount) OVER p = 1 AS INTEGER) AS is_one_shot_pair
FROM tx WINDOW p AS (PARTITION BY s, r), w AS (PARTITION BY s, r ORDER BY row_index)""",
    "sender_velocity": f"""WITH {TX_SQL}, {VELOCITY_SQL} SELECT row_index, tx_count_10, tx_count_30, round(velocity_sum_10tx, 2) AS velocity_sum_10tx,
  round(coalesce(least(velocity_sum_10tx / (tx_count_30 * greatest(amount, 1.0)), 100.0), 0.0), 6) AS velocity_burst_ratio
FROM (SELECT row_index, tx_count_10, tx_count_30, velocity_sum_10tx, CASE WHEN amount IS NULL THEN 1.0 ELSE amount END AS amount FROM vel)""",
    "sender_zscore": f"""WITH {TX_SQL}, z AS (SELECT s, avg(amount) AS m, greatest(coalesce(stddev_samp(amount), 1.0), 1.0) AS d FROM tx WHERE s IS NOT NULL GROUP BY 1)
SELECT row_index, round((amount - m) / d, 6) AS amount_zscore_sender FROM tx LEFT JOIN z USING (s)""",
    "institution_branch_risk": f"WITH {RATE_SQL} SELECT account_id, risk_numeric, round(institution_risk_rate, 6) AS institution_risk_rate, round(branch_risk_rate, 6) AS branch_risk_rate FROM rates",
    "role_join_training": f"""WITH {TX_SQL}, {RATE_SQL} SELECT row_index, round(a.institution_risk_rate, 6) AS sender_institution_risk, a.risk_grade AS sender_kyc_risk_grade,
  round(b.institution_risk_rate, 6) AS receiver_institution_risk, b.risk_grade AS receiver_kyc_risk_grade
FROM tx LEFT JOIN rates a ON s = a.account_id LEFT JOIN rates b ON r = b.account_id""",
    "temporal_split": f"WITH {TX_SQL}, {SPLIT_SQL} SELECT row_index, split FROM sp",
    "split_audit": f"""WITH {TX_SQL}, {SPLIT_SQL}, m AS (SELECT DISTINCT split, unnest([s, r]) AS a FROM sp), k AS (SELECT split, count(*) AS n_accounts, count(*) FILTER (a IN (SELECT a FROM m WHERE split = 'train' AND a IS NOT NULL)) AS n_in_train FROM m WHERE a IS NOT NULL GROUP BY 1)
SELECT split, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS n_tx, CAST(sum(label) AS BIGINT) AS n_labelled, round(avg(label), 6) AS label_share, any_value(n_accounts) AS n_accounts, any_value(n_in_train) AS n_in_train
FROM sp JOIN k USING (split) GROUP BY 1""",
    "graph_cutoff_edges": f"""WITH {TX_SQL}, {SPLIT_SQL}, k AS (SELECT * FROM sp WHERE day IS NOT NULL AND tm IS NOT NULL AND s IS NOT NULL AND r IS NOT NULL),
c AS (SELECT day AS d, tm AS t FROM k WHERE split = 'train' ORDER BY day DESC, tm DESC LIMIT 1)
SELECT row_index, s AS src, r AS dst, amount FROM k, c WHERE day < d OR (day = d AND tm <= t)""",
    "activity_momentum": f"""WITH {TX_SQL}, {VELOCITY_SQL}, m AS (SELECT s AS account_id, avg(tx_count_10) AS a, avg(tx_count_30) AS b FROM vel WHERE s IS NOT NULL GROUP BY 1)
SELECT account_id, round(a, 6) AS mean_10, round(b, 6) AS mean_30, CASE WHEN b - a > 0 AND a > (b - a) * 0.75 THEN 'rising' WHEN b - a > 0 AND a < (b - a) * 0.25 THEN 'declining' ELSE 'stable' END AS momentum FROM m""",
    "column_validation": f"WITH {TX_SQL}, c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct, avg(CAST({c} IS NULL AS DOUBLE)) AS e FROM tx" for c in ("amount", "cross_border_flag", "label", "score", "tm", "day")
    ) + ') SELECT "column", n_present, n_distinct, round(e, 6) AS null_share, n_distinct > 1 AS kept, e > 0.8 AS warned FROM c',
    "feature_labels": f"SELECT * FROM (VALUES {_LABELS}, ('is_late_night', 'Is Late Night'), ('pair_tx_sequence', 'Pair Tx Sequence')) t(feature, label)",
}
