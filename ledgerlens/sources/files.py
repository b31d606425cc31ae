"""Readers and writers of files with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.views import SCHEMAS

REPORT_SCHEMA = "str_id string, account_number string, account_id bigint, reason string"
#: Stand-ins for a missing report folder.
DEMO_REPORTS = [
    ("DEMO-1", "NP0001", 1, "Account NP0001 received NPR 2.3M on 2025-06-14 in many small pieces."),
    ("DEMO-2", "NP0002", 2, "Account NP0002 sent USD 500K abroad on 14/06/2025."),
    ("DEMO-3", "UNKNOWN", None, "No account could be named."),
]

# Stand-in edges with their age in days.
DEMO_EDGES = [
    ("ACC_001", "ACC_002", 50000.0, 1), ("ACC_001", "ACC_003", 75000.0, 0), ("ACC_002", "ACC_004", 30000.0, 2), ("ACC_003", "ACC_005", 60000.0, 1),
    ("ACC_004", "ACC_005", 40000.0, 3), ("ACC_005", "ACC_001", 25000.0, 2), ("ACC_006", "ACC_001", 80000.0, 45), ("ACC_007", "ACC_002", 90000.0, 60),
    ("ACC_006", "ACC_003", 70000.0, 50), ("ACC_008", "ACC_004", 55000.0, 75), ("ACC_007", "ACC_005", 65000.0, 90), ("ACC_008", "ACC_006", 45000.0, 35),
    ("ACC_009", "ACC_007", 85000.0, 80), ("ACC_009", "ACC_008", 35000.0, 55),
]


def read(spark: SparkSession, name: str, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV, JSON or ORC with the declared schema, or Parquet, by the path's ending. A missing path raises FileNotFoundError."""
    schema = schema or SCHEMAS.get(name)
    kind = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read
    try:
        if kind in ("csv", "json", "orc"):
            if schema is not None:
                reader = reader.schema(schema)
            return reader.options(header=True, escape='"').csv(path) if kind == "csv" else getattr(reader, kind)(path)
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def read_or(spark: SparkSession, path: str, build) -> DataFrame:
    """The kept result at a path, or ``build()`` written there first."""
    try:
        return read(spark, "", path)
    except FileNotFoundError:
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    """Parquet, or CSV with a header, JSON or ORC where the path ends so. Texts keep their outer blanks."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    out = df.write.mode("overwrite")
    if kind == "csv":
        out.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"').csv(path)
    elif kind == "json":
        out.option("ignoreNullFields", False).json(path)
    else:
        (out.orc if kind == "orc" else out.parquet)(path)


def write_reports(reports: DataFrame, folder: str) -> None:
    """Reports as XML, a row each under one root per file, in the tags that ``read_reports`` knows."""
    rows = reports.select(F.col("str_id").alias("report_id"), F.col("account_number").alias("account"), "account_id", "reason")
    rows.write.format("xml").mode("overwrite").options(rootTag="reports", rowTag="report").save(folder)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(str_id, account_number, account_id, reason) of the XML files in a folder.

    A file holds one report at its root or any number of ``report`` elements. A missing id
    is the file's name, a missing account (``account``, else ``account_number``) UNKNOWN,
    an id that is no number NULL; files that are no XML are left out. Files are parsed in
    the JVM by the engine's own XPath.
    """
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", r"^\s*<\?xml[^>]*\?>", "").alias("value"))
    pieces = F.regexp_extract_all("value", F.lit(r"(?s)<report(?:\s[^>]*)?>.*?</report>"), F.lit(0))
    found = files.select("name", F.explode(F.when(F.size(pieces) > 0, pieces).otherwise(F.array("value"))).alias("value"))
    ok = F.expr("from_xml(value, '_broken string', map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_broken'))._broken IS NULL")

    def first(*tags: str) -> Column:
        """The first text that is not blank; XPath is asked of well-formed pieces only."""
        texts = (F.expr(f"filter(transform(xpath(value, '//{tag}/text()'), x -> trim(x)), x -> x <> '')") for tag in tags)
        return F.coalesce(*(F.when(F.col("ok"), F.get(x, F.lit(0))) for x in texts))

    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return found.withColumn("ok", ok & F.trim("value").startswith("<")).where("ok").select(
        F.coalesce(first("report_id"), stem).alias("str_id"), F.coalesce(first("account", "account_number"), F.lit("UNKNOWN")).alias("account_number"),
        first("account_id").try_cast("bigint").alias("account_id"), first("reason").alias("reason"),
    )


def edges_or_demo(spark: SparkSession, path: str, reference: str) -> DataFrame:
    """Transfer edges of a file, or fourteen stand-ins dated back from a reference day (yyyy-MM-dd); is_mock tells which."""
    try:
        return read(spark, "graph_edges", path).withColumn("is_mock", F.lit(False))
    except FileNotFoundError:
        rows = spark.createDataFrame(DEMO_EDGES, "Sender_account string, Receiver_account string, amount_local_npr double, days int")
        return rows.select("Sender_account", "Receiver_account", "amount_local_npr", F.date_sub(F.lit(reference).cast("date"), "days").alias("Date"), F.lit(True).alias("is_mock"))


def reports_or_demo(spark: SparkSession, folder: str) -> DataFrame:
    try:
        found = read_reports(spark, folder)
        if not found.isEmpty():
            return found
    except AnalysisException:
        pass
    return spark.createDataFrame(DEMO_REPORTS, REPORT_SCHEMA)
