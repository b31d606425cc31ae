"""Queries over measures of rankings, drift, choices and states, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import drift, features, fusion, graph, learned, metrics, paths, risk
from ledgerlens.plans import report_queries, study_queries
from ledgerlens.plans.feature_queries import SPLIT_SQL
from ledgerlens.plans.graph_queries import DEGREE_SQL, MUTUAL_SQL, SIMPLE_SQL
from ledgerlens.plans.risk_queries import RISK_SQL
from ledgerlens.session import materialise
from ledgerlens.sources.tables import table
from ledgerlens.sources.views import EDGE_SQL, FEEDBACK_SQL, TX_SQL, accounts, edges, feedback, transactions
from ledgerlens.streaming import feedback as stream
from ledgerlens.streaming.hysteresis import health_states, trigger, unhealthy

#: A routing table as a user states it: path and the precision it is known for.
ROUTES = [("full", 0.82), ("no_nlp", 0.82), ("no_symbolic", 0.76), ("no_pagerank", 0.72), ("no_fusion", 0.70), ("lgbm_pagerank", 0.68), ("lgbm_rules", 0.66), ("lgbm_only", 0.62)]
SHADOW_MEAN = 0.62


def _r(*columns, digits=6):
    return [F.round(c, digits).alias(c) for c in columns]


def clean_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every transaction's raw score with NaN and NULL as the median, infinities and what is outside clipped where they are."""
    raw = table(spark, folder, "transactions").select("row_index", "tx_score").dropDuplicates(["row_index"])
    return drift.clean_scores(materialise(raw), "tx_score").select("row_index", *_r("tx_score"))


def prediction_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return transactions(spark, folder).where("score IS NOT NULL").select("row_index", F.round(risk.confidence(F.col("score")), 6).alias("confidence"))


def display_details(spark: SparkSession, folder: str) -> DataFrame:
    """The riskiest accounts with what is shown of them, one row each."""
    top = risk.account_risk(transactions(spark, folder)).select("account_id", F.round(F.col("risk_recent_weighted") + 1e-9, 6).alias("risk")).orderBy(F.desc("risk"), "account_id").limit(50)
    held = features.one_per_key(accounts(spark, folder), "account_id").select("account_id", "name", "institution", "risk_grade")
    return top.join(held, "account_id", "left")


def graph_role_join(spark: SparkSession, folder: str) -> DataFrame:
    """Graph features of sender and receiver at each transaction; without graph features the transactions stay as they are."""
    d = graph.reciprocity(graph.last_edges(edges(spark, folder))).select(F.col("id").alias("account_id"), *(F.col(c).alias(f"gf_{c}") for c in ("in_degree", "out_degree", "reciprocity")))
    wide = features.training_rows(transactions(spark, folder), accounts(spark, folder), d)
    rounded = [F.round(f"{r}_gf_reciprocity", 6).alias(f"{r}_gf_reciprocity") for r in ("sender", "receiver")]
    return wide.select("row_index", "sender_gf_in_degree", "sender_gf_out_degree", "receiver_gf_in_degree", "receiver_gf_out_degree", *rounded)


def importance_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of all weight a group of names holds: of the types' totals those that begin alike."""
    rows = transactions(spark, folder).where("amount > 0 AND tm IS NOT NULL").groupBy(F.concat(F.lit("hour_"), F.substring("tm", 1, 2)).alias("name")).agg(F.sum("amount").alias("v"))
    held = [(r["name"], r["v"]) for r in rows.collect()]  # a row per hour
    return spark.createDataFrame([(p, round(learned.share_of(held, p), 6)) for p in ("hour_0", "hour_1", "hour_2", "none")], "prefix string, share double")


def last_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Of each path the last 500 rows that arrived in order: their number, mean score and number of labels."""
    kept = stream.kept_in_order(report_queries._arrived(spark, folder))
    return stream.last_rows(kept).groupBy("path_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum("label").alias("n_labelled"))


def moving_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Each path's reference histogram after its months, moved by a tenth each."""
    rows = feedback(spark, folder).withColumn("seq", F.year("ts") * 12 + F.month("ts"))
    bins = drift.histogram(rows, "score", "path_id", "seq").groupBy("path_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))), lambda x: x["p"]).alias("h"))  # 20 values
    ordered = bins.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "h"))), lambda x: x["h"]).alias("o"))  # a value per month
    return ordered.select("path_id", F.posexplode(drift.moving_reference(F.col("o"))).alias("bin", "p")).withColumn("p", F.round("p", 7))


def drift_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each path's months classed by their precision against a budget of 0.60 and by the divergence from the month before."""
    rows = feedback(spark, folder).withColumn("seq", F.year("ts") * 12 + F.month("ts"))
    now = drift.histogram(rows, "score", "path_id", "seq")
    before = now.withColumn("seq", F.col("seq") + 1)
    kl = drift.kl_divergence(now, before, "path_id", "seq")
    each = rows.groupBy("path_id", "seq").agg(F.avg("label").alias("precision")).join(kl, ["path_id", "seq"])
    return each.select("path_id", "seq", *_r("precision"), *_r("kl", digits=5), drift.drift_class(F.col("precision"), F.lit(drift.BASE), F.col("kl")).alias("drift"))


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "path_id string, precision double")


def _estimates(spark: SparkSession, folder: str) -> DataFrame:
    return feedback(spark, folder).groupBy("path_id").agg(F.avg("label").alias("precision"))


def routing_table(spark: SparkSession, folder: str) -> DataFrame:
    """The routing table with estimates from feedback where they differ by more than 0.05, best first."""
    return paths.recalibrated(_routes(spark), _estimates(spark, folder)).select("path_id", *_r("precision"), "changed", "place")


def path_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Number of paths, lowest precision, whether all reach 0.60, and the budget that goes with their mean."""
    moved = paths.recalibrated(_routes(spark), _estimates(spark, folder))
    return paths.evidence(moved).select("n_paths", *_r("min_precision"), "all_reach", "all_below", "budget")


def evaluation_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The nine measures of the scores, truth and score found among the columns that are there."""
    rows = metrics.truth_and_score(transactions(spark, folder).withColumnRenamed("score", "tx_score").withColumnRenamed("label", "is_suspicious_tx"))
    out = metrics.bundle(materialise(rows.select("row_index", "label", "score")))
    return out.select(*_r(*out.columns))


def shadow_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Each month's transactions judged by their best 50 scores, against the histogram of all."""
    rows = transactions(spark, folder).where("day IS NOT NULL AND score IS NOT NULL").withColumn("month", F.date_format("day", "yyyy-MM"))
    rows = materialise(rows.select("row_index", "month", "score", "label"))
    found = drift.shadow_evaluation(rows, drift.histogram(rows.withColumn("_all", F.lit(0)), "score", "_all"), "month", "row_index", budget_mean=SHADOW_MEAN)
    return found.select("month", "n", *_r("precision"), *_r("kl", digits=5), "budget", "escalate", "moves_reference")


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, folder, "events").select(
        "event_id", (F.col("user_id") % 5).cast("string").alias("component"), "ts", (F.col("value") * 20).alias("latency"), (k / 100).alias("kl"), (F.col("event_id") % 10 / 10).alias("throughput")
    )


def health_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an observation is out of bounds, and what is, in words."""
    measures = ("latency", "kl", "throughput")
    return _observed(spark, folder).select("event_id", "component", unhealthy(*measures).alias("unhealthy"), trigger(*measures).alias("reason"))


def health_by_component(spark: SparkSession, folder: str) -> DataFrame:
    """Of each component the observations in each state, and the switches."""
    rows = _observed(spark, folder).select("component", "ts", unhealthy("latency", "kl", "throughput").alias("unhealthy"))
    return health_states(rows).groupBy("component", "state").agg(F.count("*").alias("n"), F.count_if("switched").alias("n_switches"))


def known_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """The accounts seen in any role or listed, each once, and where they are seen."""
    seen = risk.by_role(transactions(spark, folder), "row_index").select("account_id").distinct().withColumn("seen", F.lit(1))
    listed = accounts(spark, folder).select("account_id", F.lit(1).alias("listed"))
    every = seen.select("account_id").union(listed.select("account_id")).distinct()
    return every.join(seen, "account_id", "left").join(listed, "account_id", "left").na.fill(0)


def fitting_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Training and validation rows together, as a final fit takes them: rows, labels and total per split and of both."""
    tx = features.temporal_split(transactions(spark, folder))
    train, validation = tx.where("split = 'train'"), tx.where("split = 'validation'")
    both = train.unionByName(validation)
    return both.rollup("split").agg(F.count("*").alias("n"), F.sum("label").alias("n_labelled")).na.fill("both", ["split"])


def combined_report(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluations of fusion, ranks and paths in one table; an error where one of them has nothing to say."""
    rows = materialise(features.behaviour(transactions(spark, folder)).where("score IS NOT NULL").select("row_index", "label", "score", F.greatest(F.coalesce("amount", F.lit(0.0)), F.lit(0.0)).alias("amount")))
    place = fusion.minmax(rows, "amount", "place").withColumn("fused", fusion.fuse(F.col("score"), F.col("place")))
    gain = metrics.improvement(metrics.at_k(rows, 50, "score"), metrics.at_k(materialise(place), 50, "fused"), "precision")
    fused = gain.select(F.lit("fusion").alias("section"), F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in ("before", "after", "gain")))).alias("x"))
    proof = paths.evidence(paths.recalibrated(_routes(spark), _estimates(spark, folder)))
    routed = proof.select(F.lit("paths").alias("section"), F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in ("n_paths", "min_precision")))).alias("x"))
    return study_queries.report({"fusion": fused, "paths": routed}, ("fusion", "paths")).withColumn("value", F.round("value", 6))


QUERIES = {x.__name__: x for x in (
    clean_scores, prediction_confidence, display_details, graph_role_join, importance_share, last_feedback, moving_histogram, drift_classes, routing_table, path_evidence,
    evaluation_bundle, shadow_evaluations, health_observations, health_by_component, known_accounts, fitting_rows, combined_report,
)}

# The k-th row of the feedback file, and the rows that come in order of their times.
ARRIVED_SQL = """ar AS (SELECT path_id, "timestamp" AS ts, score, CAST(label AS INTEGER) AS label, pos FROM (SELECT *, row_number() OVER () AS pos FROM feedback)
  WHERE label IS NOT NULL AND path_id IS NOT NULL AND "timestamp" IS NOT NULL AND score BETWEEN 0 AND 1 AND CAST(score AS VARCHAR) <> 'nan'),
ki AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY path_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ar) WHERE newest IS NULL OR ts >= newest),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY pos DESC) AS back FROM ki) WHERE back <= 500)"""


def hist_sql(source: str, groups: str, name: str) -> str:
    """Smoothed shares of 20 bins of column score for each of ``groups``."""
    return f"""{name}_c AS (SELECT {groups}, CAST(least(floor(score * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM {source} GROUP BY ALL),
{name}_f AS (SELECT k.*, b AS bin, coalesce((SELECT n FROM {name}_c c WHERE ({', '.join(f'c.{g.strip()}' for g in groups.split(','))}) = ({', '.join(f'k.{g.strip()}' for g in groups.split(','))}) AND c.bin = b), 0) AS n
  FROM (SELECT DISTINCT {groups} FROM {name}_c) k CROSS JOIN (SELECT unnest(range(20)) AS b)),
{name}_d AS (SELECT *, n / sum(n) OVER (PARTITION BY {groups}) * 20 + 1e-10 AS d FROM {name}_f), {name} AS (SELECT {groups}, bin, d / sum(d) OVER (PARTITION BY {groups}) AS p FROM {name}_d)"""


_MONTHS = f"{FEEDBACK_SQL}, fm AS (SELECT *, CAST(year(ts) * 12 + month(ts) AS INTEGER) AS seq FROM fb), {hist_sql('fm', 'path_id, seq', 'hm')}"
_ROUTES = ", ".join(f"('{p}', {v}e0)" for p, v in ROUTES)
_MOVED = f"""{FEEDBACK_SQL}, es AS (SELECT path_id, avg(label) AS e FROM fb GROUP BY 1), mv AS (SELECT path_id, CASE WHEN abs(e - v) > 0.05 THEN e ELSE v END AS precision, coalesce(abs(e - v) > 0.05, false) AS changed
  FROM (VALUES {_ROUTES}) t(path_id, v) LEFT JOIN es USING (path_id))"""
_TRUE = f"{TX_SQL}, sc AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_index) AS rk FROM tx WHERE score IS NOT NULL)"


def _at(k: int, name: str) -> str:
    hits = f"(SELECT sum(label) FILTER (rk <= {k}) FROM sc)"
    return {
        "precision": f"{hits} / {k}", "recall": f"{hits} / (SELECT sum(label) FROM sc)", "lift": f"{hits} / {k} / (SELECT avg(label) FROM sc)",
        "ndcg": f"(SELECT sum(label / log2(rk + 1)) FILTER (rk <= {k}) FROM sc) / (SELECT sum(1 / log2(i + 1)) FROM range(1, {k} + 1) t(i) WHERE i <= (SELECT sum(label) FROM sc))",
    }[name]


_OBSERVED = """ob AS (SELECT event_id, CAST(user_id % 5 AS VARCHAR) AS component, ts, value * 20 AS latency, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS kl, event_id % 10 / 10 AS throughput FROM events)"""
_BAD = "coalesce(latency > 5000, false) OR coalesce(kl > 0.5, false) OR coalesce(throughput < 0.2, false)"


def states_sql(source: str) -> str:
    """st: the state after each observation of ``source`` (component, ts, bad), one recursion step an observation."""
    return f"""sq AS (SELECT component, ts, bad, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY component ORDER BY ts, bad) AS i FROM {source}),
st AS (SELECT component, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS ts, 'HEALTHY' AS state, 0 AS b, 0 AS g, CAST([] AS DOUBLE[]) AS w, 0e0 AS until, false AS switched FROM (SELECT DISTINCT component FROM sq)
 UNION ALL SELECT component, i, ts, CASE WHEN locked THEN 'COOLDOWN' WHEN changed AND len(w2) > 3 THEN 'COOLDOWN' ELSE s2 END, CASE WHEN locked THEN b ELSE b2 END, CASE WHEN locked THEN g ELSE g2 END,
  CASE WHEN changed THEN w2 ELSE w END, CASE WHEN changed AND len(w2) > 3 THEN sec + 300 ELSE until END, changed
 FROM (SELECT *, s2 <> s1 AND NOT locked AS changed, list_append(list_filter(w, lambda t: sec - t <= 300), sec) AS w2
  FROM (SELECT *, CASE WHEN s1 = 'HEALTHY' AND b2 >= 2 THEN 'DEGRADED' WHEN s1 = 'DEGRADED' AND g2 >= 3 THEN 'HEALTHY' ELSE s1 END AS s2
   FROM (SELECT q.component, q.i, q.ts, q.sec, locked, s1, w, until, b, g, CASE WHEN q.bad THEN b1 + 1 ELSE 0 END AS b2, CASE WHEN q.bad THEN 0 ELSE g1 + 1 END AS g2
    FROM (SELECT *, state = 'COOLDOWN' AS cold FROM st) p JOIN sq q ON q.component = p.component AND q.i = p.i + 1,
    LATERAL (SELECT cold AND q.sec < until AS locked, CASE WHEN cold AND q.sec >= until THEN 'DEGRADED' ELSE state END AS s1, CASE WHEN cold AND q.sec >= until THEN 0 ELSE b END AS b1, CASE WHEN cold AND q.sec >= until THEN 0 ELSE g END AS g1) l))))"""


ORACLES = {
    "clean_scores": """WITH u AS (SELECT DISTINCT ON (row_index) row_index, tx_score AS x FROM transactions WHERE row_index IS NOT NULL), m AS (SELECT quantile_cont(x, 0.5) AS m FROM u WHERE x IS NOT NULL AND CAST(x AS VARCHAR) <> 'nan')
SELECT row_index, round(CASE WHEN x IS NULL OR CAST(x AS VARCHAR) = 'nan' THEN m WHEN isinf(x) THEN CASE WHEN x > 0 THEN 1 ELSE 0 END ELSE x END, 6) AS tx_score FROM u, m""",
    "prediction_confidence": f"WITH {TX_SQL} SELECT row_index, round(2 * abs(score - 0.5), 6) AS confidence FROM tx WHERE score IS NOT NULL",
    "display_details": f"WITH {RISK_SQL} SELECT account_id, risk_recent_weighted AS risk, name, institution, risk_grade FROM t50 LEFT JOIN accounts USING (account_id)",
    "graph_role_join": f"""WITH {TX_SQL}, {EDGE_SQL}, {SIMPLE_SQL}, {DEGREE_SQL}, {MUTUAL_SQL}, d AS (SELECT id, in_degree AS i, out_degree AS o, coalesce(mutual, 0) / (in_degree + out_degree - coalesce(mutual, 0)) AS x FROM deg LEFT JOIN mu USING (id))
SELECT row_index, coalesce(a.i, 0) AS sender_gf_in_degree, coalesce(a.o, 0) AS sender_gf_out_degree, coalesce(b.i, 0) AS receiver_gf_in_degree, coalesce(b.o, 0) AS receiver_gf_out_degree,
  round(coalesce(a.x, 0), 6) AS sender_gf_reciprocity, round(coalesce(b.x, 0), 6) AS receiver_gf_reciprocity FROM tx LEFT JOIN d a ON a.id = s LEFT JOIN d b ON b.id = r""",
    "importance_share": f"""WITH {TX_SQL}, h AS (SELECT 'hour_' || left(tm, 2) AS name, sum(amount) AS v FROM tx WHERE amount > 0 AND tm IS NOT NULL GROUP BY 1)
SELECT prefix, round(coalesce(sum(v) FILTER (starts_with(name, prefix)), 0) / sum(v), 6) AS share FROM h, (VALUES ('hour_0'), ('hour_1'), ('hour_2'), ('none')) t(prefix) GROUP BY 1""",
    "last_feedback": f"WITH {ARRIVED_SQL} SELECT path_id, count(*) AS n, round(avg(score), 6) AS mean_score, CAST(sum(label) AS BIGINT) AS n_labelled FROM la GROUP BY 1",
    "moving_histogram": f"""WITH RECURSIVE {_MONTHS}, o AS (SELECT path_id, list(p ORDER BY bin) AS h, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY path_id) AS n FROM hm GROUP BY path_id, seq),
m AS (SELECT path_id, i, n, h FROM o WHERE i = 1 UNION ALL SELECT path_id, i, n, [x / list_sum(y) FOR x IN y] FROM (SELECT o.path_id, o.i, o.n, [0.9e0 * m.h[j] + 0.1e0 * o.h[j] FOR j IN range(1, 21)] AS y FROM m JOIN o ON o.path_id = m.path_id AND o.i = m.i + 1))
SELECT path_id, CAST(j - 1 AS INTEGER) AS bin, round(h[j], 7) AS p FROM m, (SELECT unnest(range(1, 21)) AS j) WHERE i = n""",
    "drift_classes": f"""WITH {_MONTHS}, kl AS (SELECT x.path_id, x.seq, coalesce(sum(x.p * ln(x.p / y.p)), 0) AS kl FROM hm x LEFT JOIN hm y ON y.path_id = x.path_id AND y.seq = x.seq - 1 AND y.bin = x.bin GROUP BY 1, 2),
pr AS (SELECT path_id, seq, avg(label) AS precision FROM fm GROUP BY 1, 2)
SELECT path_id, seq, round(precision, 6) AS precision, round(kl, 5) AS kl, CASE WHEN precision < 0.60 THEN 'precision_degraded' WHEN kl > 0.15 THEN 'benign_shift' ELSE 'no_drift' END AS drift FROM pr JOIN kl USING (path_id, seq)""",
    "routing_table": f"WITH {_MOVED} SELECT path_id, round(precision, 6) AS precision, changed, CAST(row_number() OVER (ORDER BY precision DESC, path_id) AS INTEGER) AS place FROM mv",
    "path_evidence": f"""WITH {_MOVED}, a AS (SELECT count(*) AS n_paths, min(precision) AS m, bool_and(precision >= 0.60) AS r, bool_and(precision < 0.60) AS b, avg(precision) AS x FROM mv)
SELECT n_paths, round(m, 6) AS min_precision, r AS all_reach, b AS all_below, CASE WHEN x > 0.70 THEN 0.65e0 WHEN x < 0.65 THEN 0.58e0 ELSE 0.60e0 END AS budget FROM a""",
    "evaluation_bundle": f"""WITH {_TRUE}, st AS (SELECT score, count(*) AS n, sum(label) AS p FROM sc GROUP BY 1), ru AS (SELECT p, sum(p) OVER w AS hit, sum(n) OVER w AS seen FROM st WINDOW w AS (ORDER BY score DESC))
SELECT {', '.join(f'round({_at(k, name)}, 6) AS {name}_{k}' for name, ks in metrics.BUNDLE for k in ks)}, (SELECT round(sum(p * hit / seen) / sum(p), 6) FROM ru) AS average_precision""",
    "shadow_evaluations": f"""WITH {TX_SQL}, m AS (SELECT row_index, strftime(day, '%Y-%m') AS month, score, label, 0 AS one FROM tx WHERE day IS NOT NULL AND score IS NOT NULL), {hist_sql('m', 'month', 'hx')}, {hist_sql('m', 'one', 'hr')},
kl AS (SELECT month, sum(x.p * ln(x.p / y.p)) AS kl FROM hx x JOIN hr y ON y.bin = x.bin GROUP BY 1),
b AS (SELECT month, any_value(c) AS n, sum(label) AS hits FROM (SELECT *, count(*) OVER (PARTITION BY month) AS c, row_number() OVER (PARTITION BY month ORDER BY score DESC, row_index) AS rk FROM m) WHERE rk <= 50 GROUP BY 1),
f AS (SELECT month, n, CASE WHEN n >= 200 THEN hits / least(n, 50) END AS precision, kl, round(least(0.58e0 + CASE WHEN kl > 0.10 THEN 0.03e0 ELSE 0e0 END, 0.75e0), 4) AS budget FROM b JOIN kl USING (month))
SELECT month, n, round(precision, 6) AS precision, round(kl, 5) AS kl, budget, precision < budget - 0.05 AS escalate, NOT (precision < budget - 0.05) AS moves_reference FROM f""",
    "health_observations": f"""WITH {_OBSERVED} SELECT event_id, component, {_BAD} AS unhealthy, coalesce(nullif(concat_ws('; ', CASE WHEN latency > 5000 THEN printf('heartbeat_latency_ms=%.1f', latency) END,
  CASE WHEN kl > 0.5 THEN printf('kl_divergence=%.4f', kl) END, CASE WHEN throughput < 0.2 THEN printf('throughput_ratio=%.4f', throughput) END), ''), 'within_bounds') AS reason FROM ob""",
    "health_by_component": f"WITH RECURSIVE {_OBSERVED}, bo AS (SELECT component, ts, {_BAD} AS bad FROM ob), {states_sql('bo')} SELECT component, state, count(*) AS n, count(*) FILTER (switched) AS n_switches FROM st WHERE i > 0 GROUP BY 1, 2",
    "known_accounts": f"""WITH {TX_SQL}, seen AS (SELECT DISTINCT a FROM (SELECT unnest([s, r]) AS a FROM tx) WHERE a IS NOT NULL)
SELECT account_id, CAST(account_id IN (SELECT a FROM seen) AS INTEGER) AS seen, CAST(account_id IN (SELECT account_id FROM accounts) AS INTEGER) AS listed FROM (SELECT a AS account_id FROM seen UNION SELECT account_id FROM accounts)""",
    "fitting_rows": f"WITH {TX_SQL}, {SPLIT_SQL} SELECT coalesce(split, 'both') AS split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_labelled FROM sp WHERE split <> 'test' GROUP BY ROLLUP (split)",
    "combined_report": f"""WITH {_TRUE}, {_MOVED}, am AS (SELECT row_index, label, score, greatest(coalesce(amount, 0), 0) AS a FROM sc), pl AS (SELECT *, (a - (SELECT min(a) FROM am)) / ((SELECT max(a) - min(a) FROM am)) AS place FROM am),
fu AS (SELECT label, row_number() OVER (ORDER BY least(greatest(0.7e0 * score + 0.3e0 * place, 0), 1) DESC, row_index) AS rk FROM pl), x AS (SELECT (SELECT sum(label) FILTER (rk <= 50) FROM sc) / 50 AS b, (SELECT sum(label) FILTER (rk <= 50) FROM fu) / 50 AS a)
SELECT 'fusion' AS section, 'before' AS measure, round(b, 6) AS value FROM x UNION ALL SELECT 'fusion', 'after', round(a, 6) FROM x UNION ALL SELECT 'fusion', 'gain', round(a - b, 6) FROM x
UNION ALL SELECT 'paths', 'n_paths', count(*)::DOUBLE FROM mv UNION ALL SELECT 'paths', 'min_precision', round(min(precision), 6) FROM mv""",
}
