"""Queries over account risk, rules, fusion, ranking quality and drift, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import drift, features, flow, fusion, graph, metrics, risk
from ledgerlens.operators.fusion import Rule
from ledgerlens.plans.feature_queries import SPLIT_SQL, VELOCITY_SQL
from ledgerlens.plans.graph_queries import RANK_ROUNDS, SIMPLE_SQL, _ranks
from ledgerlens.session import materialise
from ledgerlens.sources.views import EDGE_SQL, FEEDBACK_SQL, TX_SQL, edges, feedback, transactions
from ledgerlens.streaming import feedback as stream

K = 50
#: Examples of the rules a user supplies.
FACT_RULES = [
    Rule("Many Small In", "count_in >= 10 AND total_in < 100000", 20), Rule("Fan In", "unique_senders >= 8 AND count_out <= 3", 18),
    Rule("Fan Out", "unique_receivers >= 8 AND count_in <= 3", 18), Rule("Pass Through", "flow_ratio >= 0.9 AND count_in >= 3", 15, "nearly all that comes in goes out"),
]
TX_RULES = [
    Rule("Many Small", "tx_count_10 >= 10 AND amount < 50000", 15), Rule("Large Abroad", "cross_border_flag = 1 AND amount > 100000", 20),
    Rule("Fast", "velocity_sum_10tx > 1000000", 12), Rule("Near Threshold", "amount >= 80000 AND amount < 100000", 8),
]
SHARE_RULES = [Rule(r.name, r.condition, p) for r, p in zip(TX_RULES, (0.15, 0.30, 0.15, 0.10))]
RISKS = ("risk_max", "risk_mean", "risk_time_decay", "risk_burst", "risk_high_ratio", "risk_volatility", "risk_ramp", "risk_top5_mean", "risk_composite", "risk_recent_weighted")


def _r(*columns, digits=6):
    return [F.round(c, digits).alias(c) for c in columns]


def account_risk(spark, folder):
    return risk.account_risk(transactions(spark, folder)).select("account_id", "tx_count", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in RISKS))


def account_risk_ranking(spark, folder):
    return account_risk(spark, folder).select("account_id", "risk_recent_weighted").orderBy(F.desc("risk_recent_weighted"), "account_id").limit(K)


def priority_bands(spark, folder):
    out = risk.priority_bands(materialise(account_risk(spark, folder)))
    return out.select("account_id", "priority")


FACTS = ("count_in", "count_out", "unique_senders", "unique_receivers")
RATIOS = ("cross_border_ratio_out", "cross_border_ratio", "activity_ratio", "flow_ratio")


def account_facts(spark, folder):
    out = risk.account_facts(features.trailing_counts(transactions(spark, folder)))
    return out.select("account_id", *FACTS, *_r("total_in", "total_out", "max_single_tx", digits=2), *_r(*RATIOS, digits=5), F.round(F.col("avg_in_amount") + 1e-7, 4).alias("avg_in_amount"))


def typology_rules(spark, folder):
    facts = risk.account_facts(features.trailing_counts(transactions(spark, folder)))
    return fusion.apply_rules(facts, FACT_RULES).select("account_id", "points", "typologies", "explanation")


def peer_averages(spark, folder):
    return risk.peer_averages(features.behaviour(transactions(spark, folder))).select(*_r("mean_velocity", digits=3), *_r("mean_cross_border", "mean_tx_count"))


def analyst_kpis(spark, folder):
    tx = transactions(spark, folder)
    suspicious = risk.by_role(tx.where("label = 1")).select("account_id")
    out = risk.queue_report(materialise(account_risk(spark, folder)), suspicious, K)
    return out.select(*_r("precision", "expected", digits=6), *_r("improvement_pct", "review_saved_pct", digits=3))


def flagged_transactions(spark, folder):
    """The transactions of the 50 riskiest accounts, in either role."""
    return risk.touching(transactions(spark, folder), account_risk_ranking(spark, folder)).select("row_index")


def known_both_ends(spark, folder):
    from ledgerlens.sources.views import accounts

    return risk.both_known(transactions(spark, folder), accounts(spark, folder)).select("row_index")


def tx_rule_points(spark, folder):
    out = fusion.apply_rules(features.behaviour(transactions(spark, folder)), TX_RULES)
    return out.select("row_index", "points", F.round(fusion.rule_bump(F.col("points")), 6).alias("bump"), F.round(fusion.fuse(F.coalesce("score", F.lit(0.0)), points=F.col("points")), 6).alias("fused"))


def rule_triggers(spark, folder):
    rows = features.behaviour(transactions(spark, folder)).where("score IS NOT NULL")
    return fusion.rule_report(rows, SHARE_RULES).withColumn("mean_uplift", F.round("mean_uplift", 5))


def rrf(spark, folder):
    rows = transactions(spark, folder).select("row_index", F.coalesce("score", F.lit(0.0)).alias("a"), F.coalesce("amount", F.lit(0.0)).alias("b"))
    return fusion.reciprocal_ranks(materialise(rows), ["a", "b"], "row_index").select("row_index", *_r("rrf", digits=9))


def ranking_at_k(spark, folder):
    out = metrics.at_k(transactions(spark, folder), K)
    return out.select("k", *_r("precision", "precision_of_rows", "recall", "ndcg", "lift"))


def average_precision(spark, folder):
    return metrics.average_precision(transactions(spark, folder)).select(*_r("average_precision"))


def brier(spark, folder):
    return metrics.brier(transactions(spark, folder)).select(*_r("brier"))


def score_stats(spark, folder):
    return metrics.score_stats(transactions(spark, folder)).select(*_r("mean", "std", "least", "most", "median", "above_half", "above_nine_tenths"))


def bootstrap_precision(spark, folder):
    return metrics.bootstrap_precision(transactions(spark, folder), K).select(*_r("mean", "low", "high"))


def psi_drift(spark, folder):
    """Population stability of amounts and scores between the training and the test split."""
    split = materialise(features.temporal_split(transactions(spark, folder)).select("split", "amount", "score"))
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    out = [drift.psi(train, test, c) for c in ("amount", "score")]
    return out[0].unionByName(out[1]).withColumn("psi", F.round("psi", 5))


def kl_drift(spark, folder):
    """Divergence of each path's later feedback scores from its earlier ones."""
    rows = feedback(spark, folder).withColumn("late", F.col("ts") >= F.lit("2025-04-01").cast("timestamp"))
    return drift.kl_divergence(drift.histogram(rows.where("late"), "score", "path_id"), drift.histogram(rows.where("NOT late"), "score", "path_id"), "path_id").withColumn("kl", F.round("kl", 5))


def precision_budget(spark, folder):
    """The budget after each month of each path, from the monthly share of confirmed feedback alone; drift_budget adds the divergence."""
    return drift.trailing_budget(_monthly(spark, folder)).select("path_id", "seq", *_r("precision", "mean_10"), "budget")


def _dated(spark, folder):
    return feedback(spark, folder).withColumns({"seq": F.year("ts") * 12 + F.month("ts"), "week": F.floor(F.unix_date(F.to_date("ts")) / 7)})


def _monthly(spark, folder):
    rows = feedback(spark, folder).groupBy("path_id", (F.year("ts") * 12 + F.month("ts")).alias("seq")).agg(F.avg("label").alias("precision"))
    return rows.withColumn("kl", F.lit(0.0))


def drift_budget(spark, folder):
    """The same budget raised where the month's scores diverge from the moving reference of the path."""
    return drift.evaluated(_dated(spark, folder)).select("path_id", "seq", *_r("precision", "kl", "mean_10"), "budget")


def adjusted_budget(spark, folder):
    """The budget after the weekly online precisions of each path and its last divergence, and the blend of online precisions with the monthly evaluations (the last ten of each)."""
    rows = materialise(_dated(spark, folder))
    weekly = stream.precision_after(rows, "week").where("precision IS NOT NULL")
    online = weekly.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("week", "precision"))), lambda x: x["precision"]).alias("ps"))  # a value per week
    months = drift.evaluated(rows).groupBy("path_id").agg(F.max_by("kl", "seq").alias("kl"), F.max_by("mean_10", "seq").alias("shadow"))
    both = months.join(online, "path_id", "left").withColumn("ps", F.coalesce("ps", F.array().cast("array<double>")))
    last = F.slice(F.reverse("ps"), 1, drift.WINDOW)
    mean = F.when(F.size(last) > 0, F.aggregate(last, F.lit(0.0), lambda a, b: a + b) / F.size(last))
    return both.select("path_id", drift.adjusted_budget(F.col("ps"), kl=F.col("kl")).alias("budget"), F.round(drift.blended(mean, F.col("shadow")), 6).alias("blended"))


def path_scores(spark, folder):
    rows = fusion.apply_rules(features.behaviour(transactions(spark, folder)), TX_RULES).withColumn("score", F.coalesce("score", F.lit(0.0)))
    rows = fusion.minmax(materialise(rows.select("row_index", "score", "points", F.coalesce("amount", F.lit(0.0)).alias("amount"))), "amount", "graph")
    return rows.select("row_index", *(F.round(fusion.path_score(p, F.col("score"), F.col("graph"), F.col("points")), 6).alias(p) for p in fusion.PATHS))


def adaptive_weights(spark, folder):
    """Weights of accounts by how few neighbours they have."""
    simple = materialise(graph.last_edges(edges(spark, folder)))
    d = graph.degrees(simple).join(graph.ego_to_three(simple), "id")
    nodes = F.col("in_degree") + F.col("out_degree")
    base = fusion.pack(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    raised = d.withColumn("w", fusion.isolated(base, 1 / (1 + nodes)))
    held = raised.withColumn("w", fusion.floored(F.col("w"), F.col("ego_nodes")))
    return held.select("id", *(F.round(f"w.{n}", 6).alias(n) for n in fusion.NAMES))


def _rank_maps(spark, folder, rounds=RANK_ROUNDS):
    e = materialise(edges(spark, folder))
    simple = graph.last_edges(e).withColumnRenamed("amount", "weight")
    one = flow.pagerank(materialise(simple), rounds=rounds).select("id", F.col("rank").alias("value"))
    recent = graph.temporal_edges(e.where("day >= DATE'2025-03-01'"), 7.0, burst=False).select("src", "dst", "weight")
    return materialise(flow.pagerank(materialise(recent), rounds=rounds).select("id", F.col("rank").alias("value"))), materialise(one)


def known_node_diff(spark, folder, rounds=RANK_ROUNDS):
    """PageRank of the recent decayed graph against that of the whole graph, over vertices of both; in the rounds that SQL replays."""
    a, b = _rank_maps(spark, folder, rounds)
    return metrics.map_difference(a, b).select("n", *_r("mean_abs", digits=9), *_r("mean_abs_pct", digits=4))


def known_node_diff_settled(spark, folder):
    """The same of ranks that have settled."""
    return known_node_diff(spark, folder, None)


def outer_node_diff(spark, folder, rounds=RANK_ROUNDS):
    a, b = _rank_maps(spark, folder, rounds)
    return metrics.map_difference(a, b, outer=True).select("n", *_r("mean_abs", digits=9), *_r("mean_abs_pct", digits=4))


def outer_node_diff_settled(spark, folder):
    return outer_node_diff(spark, folder, None)


QUERIES = {x.__name__: x for x in (
    account_risk, account_risk_ranking, priority_bands, account_facts, typology_rules, peer_averages, analyst_kpis, flagged_transactions, known_both_ends,
    tx_rule_points, rule_triggers, rrf, ranking_at_k, average_precision, brier, score_stats, bootstrap_precision, psi_drift, kl_drift, precision_budget,
    drift_budget, adjusted_budget, path_scores, adaptive_weights, known_node_diff, known_node_diff_settled, outer_node_diff, outer_node_diff_settled,
)}

RISK_SQL = f"""{TX_SQL}, ro AS (SELECT s AS account_id, 0 AS side, row_index, day, coalesce(score, 0e0) AS sc FROM tx WHERE s IS NOT NULL AND day IS NOT NULL
  UNION ALL SELECT r, 1, row_index, day, coalesce(score, 0e0) FROM tx WHERE r IS NOT NULL AND day IS NOT NULL),
rw AS (SELECT *, row_number() OVER w AS rn, sc - lag(sc) OVER w AS step, count(*) OVER (PARTITION BY account_id) AS n, row_number() OVER (PARTITION BY account_id ORDER BY sc DESC, row_index, side) AS best,
  exp(-0.693e0 / 3e0 * date_diff('day', day, (SELECT max(day) FROM tx))) AS w FROM ro WINDOW w AS (PARTITION BY account_id ORDER BY day, side, row_index)),
ag AS (SELECT account_id, count(*) AS tx_count, max(sc) AS risk_max, avg(sc) AS risk_mean, sum(sc * w) / sum(w) AS risk_time_decay, coalesce(max(step), 0) AS risk_burst,
  count(*) FILTER (sc > 0.5) / count(*) AS risk_high_ratio, CASE WHEN count(*) > 1 THEN stddev_pop(sc) ELSE 0 END AS risk_volatility,
  CASE WHEN count(*) > 1 THEN sum(sc * (0.5e0 + 0.5e0 * (rn - 1) / greatest(n - 1, 1))) / sum(0.5e0 + 0.5e0 * (rn - 1) / greatest(n - 1, 1)) ELSE sum(sc) END AS risk_ramp, avg(sc) FILTER (best <= 5) AS risk_top5_mean FROM rw GROUP BY 1),
rk AS (SELECT *, least(greatest(risk_composite, 0), 1) AS risk_recent_weighted FROM (SELECT *, 0.30e0 * risk_time_decay + 0.25e0 * risk_top5_mean + 0.20e0 * risk_max + 0.15e0 * risk_high_ratio + 0.10e0 * risk_burst AS risk_composite FROM ag)),
rr AS (SELECT account_id, tx_count, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in RISKS)} FROM rk),
t50 AS (SELECT account_id, risk_recent_weighted FROM rr ORDER BY risk_recent_weighted DESC, account_id LIMIT 50)"""
FACT_SQL = f"""{TX_SQL}, {VELOCITY_SQL}, fr AS (SELECT s AS account_id, 0 AS side, s, r, coalesce(amount, 0) AS c, cross_border_flag, tx_count_10, tx_count_30 FROM vel WHERE s IS NOT NULL
  UNION ALL SELECT r, 1, s, r, coalesce(amount, 0), cross_border_flag, tx_count_10, tx_count_30 FROM vel WHERE r IS NOT NULL),
f0 AS (SELECT account_id, count(*) FILTER (side = 1) AS count_in, count(*) FILTER (side = 0) AS count_out, coalesce(sum(c) FILTER (side = 1), 0) AS total_in, coalesce(sum(c) FILTER (side = 0), 0) AS total_out,
  count(DISTINCT s) FILTER (side = 1) AS unique_senders, count(DISTINCT r) FILTER (side = 0) AS unique_receivers, max(c) AS max_single_tx, coalesce(avg(cross_border_flag) FILTER (side = 0), 0) AS cross_border_ratio_out,
  avg(cross_border_flag) AS cross_border_ratio, avg(tx_count_10) AS a, avg(tx_count_30) AS b FROM fr GROUP BY 1),
fc AS (SELECT *, total_in / greatest(count_in, 1) AS avg_in_amount, CASE WHEN total_in > 0 THEN total_out / greatest(total_in, 1) ELSE 0 END AS flow_ratio, CASE WHEN b > 0 THEN a / b ELSE coalesce(a, 0) END AS activity_ratio FROM f0)"""


def _points(rules, alias):
    return " + ".join(f"CASE WHEN {r.condition} THEN {float(r.points)}e0 ELSE 0e0 END" for r in rules) + f" AS {alias}"


_NAMES = ", ".join(f"CASE WHEN {r.condition} THEN '{r.name}' END" for r in FACT_RULES)
_TEXTS = ", ".join(f"CASE WHEN {r.condition} THEN '{r.text or r.name}' END" for r in FACT_RULES)
_PT = f"{TX_SQL}, {VELOCITY_SQL}, pt AS (SELECT *, {_points(TX_RULES, 'points')} FROM vel)"
_TOP = f"{TX_SQL}, sc AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_index) AS rk FROM tx WHERE score IS NOT NULL), m AS (SELECT sum(label) FILTER (rk <= {K}) AS hits, sum(label) AS pos, count(*) AS n, sum(label / log2(rk + 1)) FILTER (rk <= {K}) AS dcg FROM sc)"


def _psi(c):
    return f"""(SELECT '{c}' AS "column", round(sum((a - b) * ln(a / b)), 5) AS psi, sum((a - b) * ln(a / b)) > 0.3 AS alert FROM (SELECT (x + 1) / (sum(x) OVER () + len(ed)) AS a, (y + 1) / (sum(y) OVER () + len(ed)) AS b FROM (
 SELECT i, any_value(ed) AS ed, count(*) FILTER (split = 'train') AS x, count(*) FILTER (split = 'test') AS y FROM (SELECT list_sort(list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS ed FROM sp WHERE split = 'train') q,
 unnest(range(len(ed) - 1)) u(i) LEFT JOIN (SELECT split, {c} AS v FROM sp WHERE split <> 'validation' AND {c} IS NOT NULL) d ON v >= ed[i + 1] AND (v < ed[i + 2] OR (i = len(ed) - 2 AND v = ed[i + 2])) GROUP BY i)))"""


_MAPS = f"""WITH {EDGE_SQL}, {SIMPLE_SQL}, w AS (SELECT src, dst, amount AS weight FROM g), {_ranks('w', RANK_ROUNDS, 'pr')}"""

ORACLES = {
    "account_risk": f"WITH {RISK_SQL} SELECT * FROM rr",
    "account_risk_ranking": f"WITH {RISK_SQL} SELECT * FROM t50",
    "priority_bands": f"WITH {RISK_SQL}, q AS (SELECT quantile_cont(risk_recent_weighted, [0.99, 0.95, 0.80]) AS c FROM rr) SELECT account_id, CASE WHEN risk_recent_weighted >= c[1] THEN 'Critical' WHEN risk_recent_weighted >= c[2] THEN 'High' WHEN risk_recent_weighted >= c[3] THEN 'Medium' ELSE 'Low' END AS priority FROM rr, q",
    "account_facts": f"WITH {FACT_SQL} SELECT account_id, {', '.join(FACTS)}, round(total_in, 2) AS total_in, round(total_out, 2) AS total_out, round(max_single_tx, 2) AS max_single_tx, {', '.join(f'round({c}, 5) AS {c}' for c in RATIOS)}, round(avg_in_amount + 1e-7, 4) AS avg_in_amount FROM fc",
    "typology_rules": f"""WITH {FACT_SQL}, x AS (SELECT account_id, {_points(FACT_RULES, 'points')}, list_filter([{_NAMES}], lambda x: x IS NOT NULL) AS n, list_filter([{_TEXTS}], lambda x: x IS NOT NULL) AS t FROM fc)
SELECT account_id, points, CASE WHEN len(n) > 0 THEN array_to_string(list_sort(n), ', ') ELSE 'None' END AS typologies, CASE WHEN len(t) > 0 THEN array_to_string(t, ' | ') ELSE 'No anomalous rules triggered.' END AS explanation FROM x""",
    "peer_averages": f"WITH {TX_SQL}, {VELOCITY_SQL} SELECT round(avg(velocity_sum_10tx), 3) AS mean_velocity, round(avg(cross_border_flag), 6) AS mean_cross_border, round(avg(tx_count_10), 6) AS mean_tx_count FROM vel",
    "analyst_kpis": f"""WITH {RISK_SQL}, bad AS (SELECT DISTINCT a FROM (SELECT unnest([s, r]) AS a FROM tx WHERE label = 1) WHERE a IS NOT NULL),
b AS (SELECT (SELECT count(*) FROM t50 WHERE account_id IN (SELECT a FROM bad)) / 50 AS p, (SELECT count(*) FROM rr WHERE account_id IN (SELECT a FROM bad)) / (SELECT count(*) FROM rr) AS e, (SELECT count(*) FROM rr) AS n)
SELECT round(p, 6) AS precision, round(e, 6) AS expected, round((p - e) / e * 100, 3) AS improvement_pct, round((1 - 50 / n) * 100, 3) AS review_saved_pct FROM b""",
    "flagged_transactions": f"WITH {RISK_SQL} SELECT row_index FROM tx WHERE s IN (SELECT account_id FROM t50) OR r IN (SELECT account_id FROM t50)",
    "known_both_ends": f"WITH {TX_SQL} SELECT row_index FROM tx WHERE s IN (SELECT account_id FROM accounts) AND r IN (SELECT account_id FROM accounts)",
    "tx_rule_points": f"WITH {_PT} SELECT row_index, points, round(0.25e0 * (1 - exp(-points / 50)), 6) AS bump, round(least(greatest(coalesce(score, 0) + 0.25e0 * (1 - exp(-points / 50)), 0), 1), 6) AS fused FROM pt",
    "rule_triggers": f"WITH {TX_SQL}, {VELOCITY_SQL} " + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, count(*) AS triggers, round(coalesce(avg(least(greatest(score + {r.points}, 0), 1) - score), 0), 5) AS mean_uplift FROM vel WHERE score IS NOT NULL AND {r.condition}" for r in SHARE_RULES),
    "rrf": f"WITH {TX_SQL} SELECT row_index, round(1e0 / (60 + row_number() OVER (ORDER BY coalesce(score, 0) DESC, row_index)) + 1e0 / (60 + row_number() OVER (ORDER BY coalesce(amount, 0) DESC, row_index)), 9) AS rrf FROM tx",
    "ranking_at_k": f"WITH {_TOP} SELECT {K} AS k, round(hits / {K}, 6) AS precision, round(hits / least(n, {K}), 6) AS precision_of_rows, round(hits / pos, 6) AS recall, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, {K} + 1) t(i) WHERE i <= pos), 6) AS ndcg, round(hits / {K} / (pos / n), 6) AS lift FROM m",
    "average_precision": f"WITH {TX_SQL}, st AS (SELECT score, count(*) AS n, sum(label) AS p FROM tx WHERE score IS NOT NULL GROUP BY 1), ru AS (SELECT p, sum(p) OVER w AS hit, sum(n) OVER w AS seen FROM st WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * hit / seen) / sum(p), 6) AS average_precision FROM ru",
    "brier": f"WITH {TX_SQL} SELECT round(avg(pow(score - label, 2)), 6) AS brier FROM tx",
    "score_stats": f"WITH {TX_SQL} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS least, round(max(score), 6) AS most, round(quantile_cont(score, 0.5), 6) AS median, round(avg(CAST(score > 0.5 AS DOUBLE)), 6) AS above_half, round(avg(CAST(score > 0.9 AS DOUBLE)), 6) AS above_nine_tenths FROM tx WHERE score IS NOT NULL",
    "psi_drift": f"WITH {TX_SQL}, {SPLIT_SQL} {_psi('amount')} UNION ALL {_psi('score')}",
    "kl_drift": f"""WITH {FEEDBACK_SQL}, f2 AS (SELECT path_id, ts >= TIMESTAMP '2025-04-01' AS late, CAST(least(floor(score * 20), 19) AS INTEGER) AS bin FROM fb), ct AS (SELECT late, path_id, bin, count(*) AS n FROM f2 GROUP BY 1, 2, 3),
fu AS (SELECT k.late, k.path_id, b, coalesce(n, 0) AS n FROM (SELECT DISTINCT late, path_id FROM ct) k CROSS JOIN (SELECT unnest(range(20)) AS b) LEFT JOIN ct ON ct.late = k.late AND ct.path_id = k.path_id AND bin = b),
ds AS (SELECT late, path_id, b, n / sum(n) OVER (PARTITION BY late, path_id) * 20 + 1e-10 AS d FROM fu), hi AS (SELECT late, path_id, b, d / sum(d) OVER (PARTITION BY late, path_id) AS p FROM ds)
SELECT x.path_id, round(coalesce(sum(x.p * ln(x.p / y.p)), 0), 5) AS kl FROM hi x LEFT JOIN hi y ON y.path_id = x.path_id AND y.b = x.b AND NOT y.late WHERE x.late GROUP BY 1""",
    "precision_budget": f"""WITH {FEEDBACK_SQL}, mo AS (SELECT path_id, year(ts) * 12 + month(ts) AS seq, avg(label) AS precision FROM fb GROUP BY 1, 2), me AS (SELECT *, avg(precision) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean_10 FROM mo)
SELECT path_id, CAST(seq AS INTEGER) AS seq, round(precision, 6) AS precision, round(mean_10, 6) AS mean_10, CASE WHEN mean_10 > 0.70 THEN 0.65e0 WHEN mean_10 < 0.65 THEN 0.58e0 ELSE 0.60e0 END AS budget FROM me""",
    "path_scores": f"""WITH {_PT}, gr AS (SELECT row_index, coalesce(score, 0e0) AS x, 0.25e0 * (1 - exp(-points / 50)) AS bump, coalesce((coalesce(amount, 0) - min(coalesce(amount, 0)) OVER ()) / nullif(max(coalesce(amount, 0)) OVER () - min(coalesce(amount, 0)) OVER (), 0), 0) AS gg FROM pt)
SELECT row_index, """ + ", ".join(f"round(least(greatest({a}e0 * x + {b}e0 * gg{' + bump' if rules else ''}, 0), 1), 6) AS {name}" for name, (a, b, rules) in fusion.PATHS.items()) + " FROM gr",
    "known_node_diff": None, "outer_node_diff": None,
}
_RECENT = "rc AS (SELECT src, dst, sum(amount * exp(-0.693e0 / 7e0 * greatest(date_diff('day', day, (SELECT max(day) FROM e WHERE day >= DATE '2025-03-01')), 0))) AS weight FROM e WHERE day >= DATE '2025-03-01' GROUP BY 1, 2)"


def _difference(join: str) -> str:
    recent = _ranks("rc", RANK_ROUNDS, "p2").replace("tot ", "tot2 ").replace(" tot)", " tot2)").replace("JOIN tot ", "JOIN tot2 ").replace("mv ", "mv2 ").replace("mv.", "mv2.").replace("nn ", "nn2 ").replace("nn)", "nn2)")
    for i in range(RANK_ROUNDS, -1, -1):
        recent = recent.replace(f"r{i} ", f"q{i} ").replace(f"r{i})", f"q{i})")
    return f"{_MAPS}, {_RECENT}, {recent}, bo AS (SELECT coalesce(a.rank, 0) AS a, coalesce(b.rank, 0) AS b FROM p2 a {join} JOIN pr b USING (id)) SELECT count(*) AS n, round(avg(abs(a - b)), 9) AS mean_abs, round(avg(CASE WHEN b <> 0 THEN abs(a - b) / b * 100 ELSE 0 END), 4) AS mean_abs_pct FROM bo"


ORACLES["known_node_diff"] = _difference("INNER")
ORACLES["outer_node_diff"] = _difference("FULL OUTER")
