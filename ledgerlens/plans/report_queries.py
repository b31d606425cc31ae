"""Queries over report narratives, feedback in order, and learned scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import features, learned
from ledgerlens.session import materialise
from ledgerlens.sources.tables import table
from ledgerlens.sources.views import transactions
from ledgerlens.streaming import feedback as stream
from ledgerlens.streaming.hysteresis import health_states

FEATURES = ["amount", "cross_border_flag", "tx_count_10", "hour", "is_off_hours", "is_late_night", "is_weekend"]


def entity_regex(spark, folder):
    out = text.entities(table(spark, folder, "reports"), "reason")
    return out.select("str_id", *(F.array_join(c, "|").alias(c) for c in ("accounts", "amounts", "dates")))


def extractive_summary(spark, folder):
    return text.summary(text.entities(table(spark, folder, "reports"), "reason"), "reason").select("str_id", "summary")


def amount_normalize(spark, folder):
    out = text.entities(table(spark, folder, "reports"), "reason").select("str_id", F.explode("amounts").alias("amount"))
    return out.select("str_id", "amount", F.round(text.amount_value(F.col("amount")), 2).alias("value")).distinct()


def date_normalize(spark, folder):
    out = text.entities(table(spark, folder, "reports"), "reason").select("str_id", F.explode("dates").alias("date"))
    return out.select("str_id", "date", text.date_parts(F.col("date")).alias("p")).select("str_id", "date", "p.*").distinct()


def faithfulness(spark, folder):
    """How much of a narrative its one-sentence summary keeps."""
    out = text.faithfulness(text.summary(text.entities(table(spark, folder, "reports"), "reason"), "reason", sentences=1))
    return out.select("str_id", F.round("faithfulness", 4).alias("faithfulness"), "grade", "faithful")


def case_reports(spark, folder):
    out = table(spark, folder, "reports")
    return out.select("str_id", text.case_report({"Report": "str_id", "Account": "account_number", "Reason": "reason"}).alias("markdown"))


def holder_in_reason(spark, folder):
    """Whether the named account's number stands in the reason, or something like it."""
    out = table(spark, folder, "reports")
    return out.select("str_id", text.similar(F.col("account_number"), F.col("reason")).alias("similar"))


def _arrived(spark, folder):
    raw = table(spark, folder, "feedback").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return raw.where("label IS NOT NULL AND path_id IS NOT NULL AND timestamp IS NOT NULL AND score BETWEEN 0.0 AND 1.0").select(
        "path_id", F.col("timestamp").alias("ts"), "score", F.col("label").cast("int").alias("label"), "file", "row"
    )


def feedback_in_order(spark, folder):
    return stream.kept_in_order(_arrived(spark, folder)).groupBy("path_id").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


def online_precision(spark, folder):
    return stream.online_precision(stream.kept_in_order(_arrived(spark, folder)))


def health_by_path(spark, folder):
    """States of the paths from whether a feedback row contradicts its score."""
    rows = _arrived(spark, folder).select(F.col("path_id").alias("component"), "ts", ((F.col("score") >= 0.5) != (F.col("label") == 1)).alias("unhealthy"))
    return health_states(rows).groupBy("component").agg(F.count_if("switched").alias("n_switches"), F.max_by("state", F.struct("ts", "state")).alias("state"))


def _rows(spark, folder):
    tx = features.temporal_split(features.temporal(features.trailing_counts(transactions(spark, folder))))
    return materialise(tx.select("row_index", "split", "label", *FEATURES))


def baseline_scores(spark, folder):
    """Boosted trees fitted on the whole training split, every row of the test split scored."""
    rows = _rows(spark, folder)
    model = learned.fit_trees(rows.where("split = 'train'"), FEATURES, trees=10, depth=4)
    return learned.scored(model, rows.where("split = 'test'"), FEATURES).select("row_index", F.round("model_score", 6).alias("model_score"))


def feature_importance(spark, folder):
    rows = _rows(spark, folder)
    model = learned.fit_trees(rows.where("split = 'train'"), FEATURES, trees=10, depth=4)
    return spark.createDataFrame(learned.importances(model, FEATURES), "feature string, importance double")


def linear_contributions(spark, folder):
    rows = _rows(spark, folder)
    model = learned.fit_linear(rows.where("split = 'train'"), FEATURES)
    return learned.contributions(model, rows.where("split = 'test'"), FEATURES).withColumn("contribution", F.round("contribution", 6))


def calibrated_scores(spark, folder):
    tx = features.temporal_split(transactions(spark, folder)).select("row_index", "split", "score", "label")
    rows = materialise(tx)
    return learned.calibrated(rows.where("split = 'train'"), rows.where("split = 'test'"), "score").select("row_index", F.round("calibrated", 6).alias("calibrated"))


QUERIES = {x.__name__: x for x in (
    entity_regex, extractive_summary, amount_normalize, date_normalize, faithfulness, case_reports, holder_in_reason, feedback_in_order, online_precision, health_by_path,
    baseline_scores, feature_importance, linear_contributions, calibrated_scores,
)}


def _all(patterns) -> str:
    one = lambda p, g: f"[trim(x) FOR x IN regexp_extract_all(coalesce(reason, ''), '{p}', {g})]"
    return "list_concat(" + ", ".join(one(p, g) for p, g in patterns) + ")" if len(patterns) == 2 else "list_concat(list_concat(" + ", ".join(one(p, g) for p, g in patterns[:2]) + "), " + one(*patterns[2]) + ")"


def _once(x: str) -> str:
    return f"[v FOR v, i IN {x} IF list_position({x}, v) = i]"


_ENT = f"en AS (SELECT str_id, reason, {_once(_all(text.ACCOUNT_PATTERNS))} AS accounts, {_once(_all(text.AMOUNT_PATTERNS))} AS amounts, {_once(_all(text.DATE_PATTERNS))} AS dates FROM reports)"

ORACLES = {
    "entity_regex": f"WITH {_ENT} SELECT str_id, array_to_string(accounts, '|') AS accounts, array_to_string(amounts, '|') AS amounts, array_to_string(dates, '|') AS dates FROM en",
    "amount_normalize": f"""WITH {_ENT}, a AS (SELECT DISTINCT str_id, unnest(amounts) AS amount FROM en), s AS (SELECT *, replace(regexp_replace(upper(trim(amount)), '(NPR|USD|EUR|GBP|\\$|€|£)\\s*', '', 'g'), ',', '') AS t FROM a)
SELECT str_id, amount, round(CASE right(t, 1) WHEN 'K' THEN try_cast(left(t, length(t) - 1) AS DOUBLE) * 1e3 WHEN 'M' THEN try_cast(left(t, length(t) - 1) AS DOUBLE) * 1e6 WHEN 'B' THEN try_cast(left(t, length(t) - 1) AS DOUBLE) * 1e9 ELSE try_cast(t AS DOUBLE) END, 2) AS value FROM s""",
    "date_normalize": f"""WITH {_ENT}, a AS (SELECT DISTINCT str_id, unnest(dates) AS date FROM en) SELECT str_id, date,
  CASE WHEN regexp_matches(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(left(date, 4) AS INTEGER) WHEN regexp_matches(date, '/') THEN CAST(split_part(date, '/', 3) AS INTEGER) END AS year,
  CASE WHEN regexp_matches(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(substr(date, 6, 2) AS INTEGER) WHEN regexp_matches(date, '/') THEN CAST(split_part(date, '/', 2) AS INTEGER) END AS month,
  CASE WHEN regexp_matches(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(substr(date, 9, 2) AS INTEGER) WHEN regexp_matches(date, '/') THEN CAST(split_part(date, '/', 1) AS INTEGER) END AS day FROM a""",
    "case_reports": "SELECT str_id, '# Case report' || chr(10) || '- **Report**: ' || coalesce(str_id, 'unknown') || chr(10) || '- **Account**: ' || coalesce(account_number, 'unknown') || chr(10) || '- **Reason**: ' || coalesce(reason, 'unknown') AS markdown FROM reports",
}
