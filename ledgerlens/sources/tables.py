"""Parquet tables and the cleaning that every query on them shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def valid_date(text: Column | str) -> Column:
    """Year-month-day or day/month/year as a date; every other text, or a day that does not exist, is NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return (
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "d/M/yyyy"))
    )


def distinct_transactions(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each ``row_index``; repeated deliveries differ only in ``ingested_at``.

    The exchange is on ``row_index``, so the resulting splits are equally large whatever
    accounts the rows belong to. Only the columns named travel, and Date travels as the
    date ``day``, which hash aggregation can hold. A row without a row_index is no
    transaction and is left out.
    """
    kept = [valid_date("Date").alias("day") if c == "Date" else F.col(c) for c in columns]
    return df.select("row_index", *kept).where(F.col("row_index").isNotNull()).dropDuplicates(["row_index"])
