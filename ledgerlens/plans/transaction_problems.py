"""Queries p1, p4 and p5 over the transactions table, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.dense_totals import dense_key_totals, heavy_keys
from ledgerlens.operators.entity_features import entity_type_stats, event_types, feature_table, most_frequent_type, role_events
from ledgerlens.operators.rolling import (
    correct,
    correct_kept,
    daily,
    keep_trees,
    kept_trees,
    peaks_and_lapses,
    rolling_totals,
    segment_trees,
    touched_blocks,
)
from ledgerlens.session import materialise, table_folder
from ledgerlens.sources.tables import distinct_transactions, table, valid_date

SIDES = {"sender": "Sender_account", "receiver": "Receiver_account"}
HEAVY_SHARE = 0.03


def _tx(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return distinct_transactions(table(spark, folder, "transactions"), *columns)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The accounts that hold at least 3 % of all transactions on a side."""
    totals = materialise(dense_key_totals(_tx(spark, folder, *SIDES.values()), SIDES))  # read twice: the whole, and the keys
    return heavy_keys(totals, HEAVY_SHARE).select("side", F.col("key").alias("account_id"))


def p1_account_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Number of transactions and total amount for every account and side."""
    totals = dense_key_totals(_tx(spark, folder, *SIDES.values(), "amount_local_npr"), SIDES, "amount_local_npr")
    return totals.where("key IS NOT NULL").select("side", F.col("key").alias("account_id"), F.col("n_rows").alias("n_tx"), F.round("total", 2).alias("total_amount"))


_EVENT = ("Date", "Sender_account", "Receiver_account", "tx_code", "tx_score")


def _role_events(spark: SparkSession, folder: str) -> DataFrame:
    return role_events(_tx(spark, folder, *_EVENT))


def _features(spark: SparkSession, folder: str, *statistics: str) -> DataFrame:
    codes = event_types(table(spark, folder, "transactions").withColumn("day", valid_date("Date")))
    return feature_table(_role_events(spark, folder), codes, statistics=statistics)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each account's most frequent transaction code in each role."""
    return most_frequent_type(_features(spark, folder, "n", "last"))


def p4_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per account: number, latest day and score total for every code in both roles, as arrays."""
    return _features(spark, folder, "n", "last", "score")


def p4_feature_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The arrays of p4_features as rows, one for every account and code, the empty ones included."""
    wide = p4_features(spark, folder)
    columns = [c for c in wide.columns if c != "account_id"]
    cells = wide.select("account_id", F.inline(F.arrays_zip(*columns)).alias(*columns)).withColumnRenamed("tx_codes", "tx_code")
    days = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("sender_last", "receiver_last")]
    return cells.select("account_id", "tx_code", "sender_n", "receiver_n", *days, *(F.round(c, 4).alias(c) for c in ("sender_score", "receiver_score")))


def p4_feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The long form of p4_features without the empty cells."""
    return entity_type_stats(_role_events(spark, folder)).select(
        "account_id", "account_role", "tx_code", "n_tx", F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), F.round("score_total", 4).alias("score_total")
    )


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return daily(_tx(spark, folder, "Date", "Sender_account", "amount_local_npr"))


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    return segment_trees(_daily(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest day of the highest 30-day total, and of the first 7 days without a transaction."""
    found = peaks_and_lapses(_trees(spark, folder))
    return found.select(F.col("entity").alias("Sender_account"), F.date_format("day", "yyyy-MM-dd").alias("day"), "day_kind")


def _rolled(rolled: DataFrame) -> DataFrame:
    rounded = [c for k in (7, 30) for c in (F.round(f"total_{k}", 2).alias(f"total_{k}"), F.round(F.round(f"total_{k}", 2) / k, 4).alias(f"avg_{k}"))]
    return rolled.select(F.col("entity").alias("Sender_account"), F.date_format("day", "yyyy-MM-dd").alias("day"), *rounded, "n_7", "n_30")


def p5_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing 7- and 30-day totals, averages and counts for every sender and day."""
    return _rolled(rolling_totals(_trees(spark, folder)))


def p5_trees(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the segment trees, a row each."""
    nodes = F.inline(F.arrays_zip("nodes", "sums", "counts")).alias("node", "total", "n")
    return _trees(spark, folder).select(F.col("entity").alias("Sender_account"), "shard", nodes).withColumn("total", F.round("total", 2))


def _on_time_and_late(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Days of the transactions that arrived within a week, and of those that came later."""
    tx = _tx(spark, folder, "Date", "Sender_account", "amount_local_npr", "ingested_at")
    late = F.coalesce(F.datediff("ingested_at", "day") > 7, F.lit(False))
    return daily(tx.where(~late)), daily(tx.where(late))


def p5_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Totals per sender from the trees' roots, after transactions that arrived more than a week late were added as corrections."""
    on_time, late = _on_time_and_late(spark, folder)
    trees = correct(segment_trees(on_time), late).where("size(nodes) > 0")
    roots = trees.select("entity", F.element_at("sums", 1).alias("total"), F.element_at("counts", 1).alias("n"))  # node 1 comes first
    return roots.groupBy(F.col("entity").alias("Sender_account")).agg(F.round(F.sum("total"), 2).alias("total"), F.sum("n").alias("n"))


def p5_rolling_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """p5_rolling by way of late corrections: trees of what came in time are kept and answered, the late transactions correct them in place, and only the blocks they reach are answered again."""
    on_time, late = _on_time_and_late(spark, folder)
    late = materialise(late)
    first, kept = (table_folder(spark, x) for x in ("trees-on-time", "trees"))
    keep_trees(segment_trees(on_time), first)
    before = kept_trees(spark, first)
    keep_trees(before, kept)
    correct_kept(spark, kept, late)
    after = kept_trees(spark, kept)
    touched = materialise(touched_blocks(before, after, late))
    return _rolled(rolling_totals(before, without=touched).unionByName(rolling_totals(after, only=touched)))


QUERIES = {
    "p5_corrected": p5_corrected, "p1_found": p1_found, "p1_account_totals": p1_account_totals,
    "p4_found": p4_found, "p4_features": p4_features, "p4_feature_cells": p4_feature_cells, "p4_feature_rows": p4_feature_rows,
    "p5_found": p5_found, "p5_rolling": p5_rolling, "p5_rolling_corrected": p5_rolling_corrected, "p5_trees": p5_trees,
}

_TX = "tx AS (SELECT DISTINCT ON (row_index) * FROM transactions)"
_DATED = """dated AS (SELECT *, CASE WHEN regexp_matches("Date", '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') THEN CAST(try_strptime("Date", '%Y-%m-%d') AS DATE)
  WHEN regexp_matches("Date", '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN CAST(try_strptime("Date", '%d/%m/%Y') AS DATE) END AS day FROM tx)"""
_ROLES = f"""{_TX}, {_DATED}, ev AS (
  SELECT account_id, account_role, tx_code, count(*) AS n_tx, max(day) AS last_day, coalesce(sum(score), 0) AS score_total FROM (
    SELECT Sender_account AS account_id, 'sender' AS account_role, upper(trim(tx_code)) AS tx_code, day, CASE WHEN tx_score BETWEEN 0 AND 1 AND CAST(tx_score AS VARCHAR) <> 'nan' THEN tx_score END AS score FROM dated
    UNION ALL
    SELECT Receiver_account, 'receiver', upper(trim(tx_code)), day, CASE WHEN tx_score BETWEEN 0 AND 1 AND CAST(tx_score AS VARCHAR) <> 'nan' THEN tx_score END FROM dated)
  WHERE account_id IS NOT NULL AND tx_code IS NOT NULL AND tx_code <> '' AND day IS NOT NULL GROUP BY 1, 2, 3)"""
_DAYS = f"""{_TX}, {_DATED}, d AS (
  SELECT Sender_account, day, sum(CASE WHEN amount_local_npr IS NULL OR isnan(amount_local_npr) THEN 0 ELSE amount_local_npr END) AS total, count(*) AS n
  FROM dated WHERE Sender_account IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2),
span AS (SELECT Sender_account, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY 1),
dense AS (SELECT s.Sender_account, s.day, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM span s LEFT JOIN d USING (Sender_account, day)),
rolled AS (SELECT Sender_account, day,
  round(sum(total) OVER w7, 2) AS total_7, round(round(sum(total) OVER w7, 2) / 7, 4) AS avg_7, CAST(sum(n) OVER w7 AS BIGINT) AS n_7,
  round(sum(total) OVER w30, 2) AS total_30, round(round(sum(total) OVER w30, 2) / 30, 4) AS avg_30, CAST(sum(n) OVER w30 AS BIGINT) AS n_30 FROM dense
  WINDOW w7 AS (PARTITION BY Sender_account ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY Sender_account ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""

ORACLES = {
    "p1_found": f"""WITH {_TX}, k AS (SELECT 'sender' AS side, Sender_account AS account_id FROM tx UNION ALL SELECT 'receiver', Receiver_account FROM tx)
SELECT side, account_id FROM k WHERE account_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.03 * (SELECT count(*) FROM tx)""",
    "p1_account_totals": f"""WITH {_TX}, k AS (SELECT 'sender' AS side, Sender_account AS account_id, amount_local_npr AS a FROM tx UNION ALL SELECT 'receiver', Receiver_account, amount_local_npr FROM tx)
SELECT side, account_id, count(*) AS n_tx, round(sum(CASE WHEN a IS NULL OR isnan(a) THEN 0 ELSE a END), 2) AS total_amount FROM k WHERE account_id IS NOT NULL GROUP BY 1, 2""",
    "p4_found": f"""WITH {_ROLES} SELECT account_id, account_role, tx_code FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, account_role ORDER BY n_tx DESC, last_day DESC, tx_code) AS rn FROM ev) WHERE rn = 1""",
    "p4_feature_rows": f"WITH {_ROLES} SELECT account_id, account_role, tx_code, n_tx, strftime(last_day, '%Y-%m-%d') AS last_day, round(score_total, 4) AS score_total FROM ev",
    "p4_feature_cells": f"""WITH {_ROLES}, wide AS (SELECT account_id, tx_code FROM (SELECT DISTINCT account_id FROM ev), (SELECT DISTINCT tx_code FROM ev))
SELECT w.account_id, w.tx_code, coalesce(a.n_tx, 0) AS sender_n, coalesce(b.n_tx, 0) AS receiver_n, strftime(a.last_day, '%Y-%m-%d') AS sender_last, strftime(b.last_day, '%Y-%m-%d') AS receiver_last,
  round(coalesce(a.score_total, 0), 4) AS sender_score, round(coalesce(b.score_total, 0), 4) AS receiver_score
FROM wide w LEFT JOIN (SELECT * FROM ev WHERE account_role = 'sender') a USING (account_id, tx_code) LEFT JOIN (SELECT * FROM ev WHERE account_role = 'receiver') b USING (account_id, tx_code)""",
    "p5_found": f"""WITH {_DAYS}, best AS (SELECT Sender_account, day, total_30, n_7, max(total_30) OVER (PARTITION BY Sender_account) AS most FROM rolled)
SELECT Sender_account, strftime(min(day), '%Y-%m-%d') AS day, 'peak_30' AS day_kind FROM best WHERE total_30 = most GROUP BY 1
UNION ALL SELECT Sender_account, strftime(min(day), '%Y-%m-%d'), 'lapse_7' FROM best WHERE n_7 = 0 GROUP BY 1""",
    "p5_corrected": f"WITH {_DAYS} SELECT Sender_account, round(sum(total), 2) AS total, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1",
    "p5_trees": f"""WITH {_DAYS}, x AS (SELECT Sender_account, total, n, date_diff('day', DATE '1970-01-01', day) AS u FROM d)
SELECT Sender_account, CAST(floor(u / 64.0) AS INTEGER) AS shard, CAST((64 + u - 64 * CAST(floor(u / 64.0) AS BIGINT)) >> level AS INTEGER) AS node, round(sum(total), 2) AS total, CAST(sum(n) AS BIGINT) AS n
FROM x, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS level) GROUP BY 1, 2, 3""",
    "p5_rolling": f"WITH {_DAYS} SELECT Sender_account, strftime(day, '%Y-%m-%d') AS day, total_7, avg_7, total_30, avg_30, n_7, n_30 FROM rolled",
}
ORACLES["p5_rolling_corrected"] = ORACLES["p5_rolling"]
