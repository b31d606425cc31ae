"""The engine's relations over the given tables, cleaned once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.tables import distinct_transactions, table

ACCOUNT_SCHEMA = T.StructType([
    T.StructField("account_id", T.LongType()), T.StructField("account_number", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("risk_grade", T.StringType()), T.StructField("institution", T.StringType()), T.StructField("branch", T.StringType()),
])
FEATURE_SCHEMA = T.StructType([
    T.StructField("row_index", T.LongType()), T.StructField("Date", T.StringType()), T.StructField("Time", T.StringType()),
    T.StructField("Sender_account", T.LongType()), T.StructField("Receiver_account", T.LongType()), T.StructField("amount_local_npr", T.DoubleType()),
    T.StructField("cross_border_flag", T.IntegerType()), T.StructField("tx_count_10", T.LongType()), T.StructField("tx_count_30", T.LongType()),
    T.StructField("velocity_sum_10tx", T.DoubleType()), T.StructField("is_suspicious_tx", T.IntegerType()),
])
EDGE_SCHEMA = T.StructType([
    T.StructField("Sender_account", T.LongType()), T.StructField("Receiver_account", T.LongType()),
    T.StructField("amount_local_npr", T.DoubleType()), T.StructField("Date", T.StringType()), T.StructField("Time", T.StringType()),
])
SCHEMAS = {"accounts": ACCOUNT_SCHEMA, "transactions": FEATURE_SCHEMA, "ml_features": FEATURE_SCHEMA, "graph_edges": EDGE_SCHEMA}


def number(column: str) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(column), F.col(column))


def valid_time(column: str = "Time") -> Column:
    """Two digits each for hour, minute and second, of a time that exists; anything else is NULL."""
    return F.when(F.col(column).rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"), F.col(column))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One clean row per transaction: row_index, day, tm, s, r, amount, cross_border_flag, label, score.

    Dates and times that are none are NULL, as are NaN amounts and scores outside 0..1;
    a NULL label counts as 0.
    """
    raw = distinct_transactions(
        table(spark, folder, "transactions"), "Date", "Time", "Sender_account", "Receiver_account", "amount_local_npr",
        "cross_border_flag", "tx_score", "is_suspicious_tx",
    )
    return raw.select(
        "row_index", "day", valid_time().alias("tm"), F.col("Sender_account").alias("s"), F.col("Receiver_account").alias("r"),
        number("amount_local_npr").alias("amount"), F.coalesce("cross_border_flag", F.lit(0)).alias("cross_border_flag"),
        F.coalesce("is_suspicious_tx", F.lit(0)).alias("label"), F.when(F.col("tx_score").between(0.0, 1.0), F.col("tx_score")).alias("score"),
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "accounts")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, amount, day) of the transfers with both ends and a Date; NaN and NULL amounts count 0, amounts below zero are no weight of an edge and count 0."""
    raw = table(spark, folder, "graph_edges").where("Sender_account IS NOT NULL AND Receiver_account IS NOT NULL AND Date IS NOT NULL")
    amount = F.greatest(F.coalesce(F.nanvl("amount_local_npr", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return raw.select(F.col("Sender_account").alias("src"), F.col("Receiver_account").alias("dst"), amount.alias("amount"), F.to_date("Date").alias("day"), F.col("Date").alias("at"))


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """(path_id, ts, account_id, score, label); a score outside 0..1, a NULL label or path is no feedback."""
    raw = table(spark, folder, "feedback").where("label IS NOT NULL AND path_id IS NOT NULL AND timestamp IS NOT NULL AND score BETWEEN 0.0 AND 1.0")
    return raw.select("path_id", F.col("timestamp").alias("ts"), "account_id", "score", F.col("label").cast("int").alias("label"))


# The same relations in SQL, for the oracles.
TX_SQL = """tx AS (SELECT row_index,
  CASE WHEN regexp_matches("Date", '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') THEN CAST(try_strptime("Date", '%Y-%m-%d') AS DATE)
       WHEN regexp_matches("Date", '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN CAST(try_strptime("Date", '%d/%m/%Y') AS DATE) END AS day,
  CASE WHEN regexp_matches("Time", '^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$') THEN "Time" END AS tm,
  Sender_account AS s, Receiver_account AS r, CASE WHEN NOT isnan(amount_local_npr) THEN amount_local_npr END AS amount,
  coalesce(cross_border_flag, 0) AS cross_border_flag, coalesce(is_suspicious_tx, 0) AS label,
  CASE WHEN tx_score BETWEEN 0 AND 1 AND CAST(tx_score AS VARCHAR) <> 'nan' THEN tx_score END AS score
  FROM (SELECT DISTINCT ON (row_index) * FROM transactions))"""
EDGE_SQL = """e AS (SELECT Sender_account AS src, Receiver_account AS dst,
  greatest(CASE WHEN amount_local_npr IS NULL OR isnan(amount_local_npr) THEN 0e0 ELSE amount_local_npr END, 0e0) AS amount, CAST("Date" AS DATE) AS day, "Date" AS moment
  FROM graph_edges WHERE Sender_account IS NOT NULL AND Receiver_account IS NOT NULL AND "Date" IS NOT NULL)"""
FEEDBACK_SQL = """fb AS (SELECT path_id, "timestamp" AS ts, account_id, score, CAST(label AS INTEGER) AS label FROM feedback
  WHERE label IS NOT NULL AND path_id IS NOT NULL AND "timestamp" IS NOT NULL AND score BETWEEN 0 AND 1 AND CAST(score AS VARCHAR) <> 'nan')"""
