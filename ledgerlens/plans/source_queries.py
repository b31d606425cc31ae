"""Queries that go through files: what is written in a format and read back with its schema is what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import features, graph, learned
from ledgerlens.plans import graph_queries, report_queries
from ledgerlens.plans.feature_queries import SPLIT_SQL, VELOCITY_SQL
from ledgerlens.session import materialise, table_folder
from ledgerlens.sources import files
from ledgerlens.sources.tables import table
from ledgerlens.sources.views import EDGE_SCHEMA, EDGE_SQL, FEATURE_SCHEMA, TX_SQL, edges, number, transactions

REFERENCE_DAY = "2025-06-30"


def _through(df: DataFrame, ending: str, name: str, schema=None) -> DataFrame:
    spark = df.sparkSession
    path = f"{table_folder(spark, name)}.{ending}"
    files.write(df, path)
    return files.read(spark, name, path, schema)


def csv_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return _through(table(spark, folder, "accounts"), "csv", "accounts")


def csv_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered row, with what the file's text makes of dates, times and amounts: a CSV has one form for an empty text and NULL, which comes back as NULL (as does NaN here)."""
    names = ["row_index", "Date", "Time", "Sender_account", "Receiver_account", "amount_local_npr", "cross_border_flag", "is_suspicious_tx"]
    schema = type(FEATURE_SCHEMA)([FEATURE_SCHEMA[n] for n in names])
    return _through(table(spark, folder, "transactions").select(*names), "csv", "transactions", schema).withColumn("amount_local_npr", number("amount_local_npr"))


def csv_ml_features(spark: SparkSession, folder: str) -> DataFrame:
    tx = features.behaviour(transactions(spark, folder))
    wide = tx.select(
        "row_index", F.date_format("day", "yyyy-MM-dd").alias("Date"), F.col("tm").alias("Time"), F.col("s").alias("Sender_account"), F.col("r").alias("Receiver_account"),
        F.col("amount").alias("amount_local_npr"), "cross_border_flag", "tx_count_10", "tx_count_30", F.round("velocity_sum_10tx", 2).alias("velocity_sum_10tx"), F.col("label").alias("is_suspicious_tx"),
    )
    return _through(wide, "csv", "ml_features")


def csv_edges(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "graph_edges")
    rows = raw.select("Sender_account", "Receiver_account", "amount_local_npr", F.date_format("Date", "yyyy-MM-dd").alias("Date"), F.date_format("Date", "HH:mm:ss").alias("Time"))
    return _through(rows, "csv", "graph_edges", EDGE_SCHEMA).withColumn("amount_local_npr", number("amount_local_npr"))


def json_reports(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "reports")
    return _through(rows, "json", "reports", rows.schema)


def orc_feedback(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "feedback").select("account_id", number("score").alias("score"), "label", "path_id")
    return _through(rows, "orc", "feedback", rows.schema)


def cached_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """A kept result: made and written at the first reading, read at the second."""
    path = table_folder(spark, "degrees")
    made = []

    def build() -> DataFrame:
        made.append(True)
        return graph_queries.degrees(spark, folder)

    files.read_or(spark, path, build)
    out = files.read_or(spark, path, build)
    if len(made) != 1:
        raise RuntimeError("a kept result was made anew")
    return out


def csv_binned_features(spark: SparkSession, folder: str) -> DataFrame:
    """The binned graph features as the file that later steps read."""
    bins = graph_queries.decile_bins(spark, folder)
    return _through(bins, "csv", "binned", bins.schema)


def xml_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The reports written as XML and scanned; outer blanks go, a report without an id would take its file's name."""
    path = table_folder(spark, "reports")
    files.write_reports(table(spark, folder, "reports"), path)
    return files.read_reports(spark, path)


def demo_reports(spark: SparkSession, folder: str) -> DataFrame:
    return files.reports_or_demo(spark, table_folder(spark, "no-reports"))


def demo_edges(spark: SparkSession, folder: str) -> DataFrame:
    found = files.edges_or_demo(spark, table_folder(spark, "no-edges") + ".csv", REFERENCE_DAY)
    return found.withColumn("Date", F.date_format("Date", "yyyy-MM-dd"))


def kept_model(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of the test split a model scores, and how many alike once it was kept and loaded."""
    rows = report_queries._rows(spark, folder)
    path = table_folder(spark, "model")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    fitted = learned.load_or_fit(path, lambda: learned.fit_linear(train, report_queries.FEATURES))
    loaded = learned.load_or_fit(path, lambda: None)
    a, b = (materialise(learned.scored(m, test, report_queries.FEATURES).select("row_index", F.col("model_score").alias(n))) for m, n in ((fitted, "a"), (loaded, "b")))
    return a.join(b.hint("merge"), "row_index").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("alike"))


def log_amount_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Temporal weights of the logarithms of amounts."""
    out = graph.temporal_edges(edges(spark, folder), graph_queries.HALF_LIFE, log_amount=True)
    return out.select("src", "dst", F.round("weight", 5).alias("weight"), F.round("original", 2).alias("original"))


def kept_feature_names(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the training relation that are left when leaky ones and those of one value are dropped."""
    tx = features.behaviour(transactions(spark, folder)).withColumns({"sender_account_age_days": F.lit(3), "constant": F.lit(1)})
    names = ["amount", "cross_border_flag", "tx_count_10", "tx_count_30", "velocity_sum_10tx", "sender_account_age_days", "constant", "missing"]
    return spark.createDataFrame([(n,) for n in features.kept_columns(tx, names)], "feature string")


QUERIES = {x.__name__: x for x in (
    csv_accounts, csv_transactions, csv_ml_features, csv_edges, json_reports, orc_feedback, cached_degrees, csv_binned_features, xml_reports, demo_reports, demo_edges,
    kept_model, log_amount_edges, kept_feature_names,
)}

_MOCK = ", ".join(f"('{a}', '{b}', {x}e0, strftime(DATE '{REFERENCE_DAY}' - {d}, '%Y-%m-%d'), true)" for a, b, x, d in files.DEMO_EDGES)
_DEMO = ", ".join("(" + ", ".join("NULL" if x is None else f"{x}" if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in files.DEMO_REPORTS)

ORACLES = {
    "csv_accounts": "SELECT * FROM accounts",
    "csv_transactions": """SELECT row_index, nullif("Date", '') AS "Date", nullif("Time", '') AS "Time", Sender_account, Receiver_account, CASE WHEN CAST(amount_local_npr AS VARCHAR) <> 'nan' THEN amount_local_npr END AS amount_local_npr, cross_border_flag, is_suspicious_tx FROM transactions""",
    "csv_ml_features": f"""WITH {TX_SQL}, {VELOCITY_SQL} SELECT row_index, strftime(day, '%Y-%m-%d') AS "Date", tm AS "Time", s AS Sender_account, r AS Receiver_account, amount AS amount_local_npr, cross_border_flag,
  tx_count_10, tx_count_30, round(velocity_sum_10tx, 2) AS velocity_sum_10tx, label AS is_suspicious_tx FROM vel""",
    "csv_edges": """SELECT Sender_account, Receiver_account, CASE WHEN CAST(amount_local_npr AS VARCHAR) <> 'nan' THEN amount_local_npr END AS amount_local_npr, strftime("Date", '%Y-%m-%d') AS "Date", strftime("Date", '%H:%M:%S') AS "Time" FROM graph_edges""",
    "json_reports": "SELECT * FROM reports",
    "orc_feedback": "SELECT account_id, CASE WHEN CAST(score AS VARCHAR) <> 'nan' THEN score END AS score, label, path_id FROM feedback",
    "cached_degrees": graph_queries.ORACLES["degrees"],
    "csv_binned_features": graph_queries.ORACLES["decile_bins"],
    "xml_reports": "SELECT str_id, coalesce(nullif(trim(account_number), ''), 'UNKNOWN') AS account_number, account_id, nullif(trim(reason), '') AS reason FROM reports",
    "demo_reports": f"SELECT str_id, account_number, CAST(account_id AS BIGINT) AS account_id, reason FROM (VALUES {_DEMO}) t(str_id, account_number, account_id, reason)",
    "demo_edges": f"""SELECT * FROM (VALUES {_MOCK}) t(Sender_account, Receiver_account, amount_local_npr, "Date", is_mock)""",
    "kept_model": f"WITH {TX_SQL}, {SPLIT_SQL} SELECT count(*) AS n, count(*) AS alike FROM sp WHERE split = 'test'",
    "log_amount_edges": f"WITH {EDGE_SQL}, {graph_queries.TEMPORAL_SQL.replace('sum(amount * exp', 'sum(ln(1 + amount) * exp')} SELECT src, dst, round(weight, 5) AS weight, round(original, 2) AS original FROM te",
    "kept_feature_names": "SELECT * FROM (VALUES ('amount'), ('cross_border_flag'), ('tx_count_10'), ('velocity_sum_10tx')) t(feature)",
}
