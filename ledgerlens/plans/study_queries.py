"""Queries put together from several operators: networks, studies of features and rules, explanations, choices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import features, flow, fusion, graph, learned, metrics, network, neural, paths, risk
from ledgerlens.operators.ordering import in_order
from ledgerlens.plans.feature_queries import VELOCITY_SQL
from ledgerlens.plans.graph_queries import HALF_LIFE, SIMPLE_SQL, SOURCES
from ledgerlens.plans.risk_queries import FACT_RULES, K, RISK_SQL, SHARE_RULES, TX_RULES
from ledgerlens.session import materialise, written
from ledgerlens.sources.views import EDGE_SQL, FEEDBACK_SQL, TX_SQL, accounts, edges, feedback, transactions

BASE = ["amount", "cross_border_flag", "tx_count_10", "hour", "is_off_hours", "is_weekend"]
GRAPH = ["sender_gf_in_degree", "sender_gf_out_degree", "sender_gf_reciprocity", "receiver_gf_in_degree", "receiver_gf_out_degree"]
#: Features of the pipeline beside those of the graph; those with one value only and leaky ones are dropped.
WIDE = [
    "amount", "cross_border_flag", "tx_count_10", "tx_count_30", "velocity_sum_10tx", "is_off_hours", "is_late_night", "is_weekend", "pair_tx_sequence", "pair_total_txs", "pair_amount_deviation", "is_one_shot_pair",
    "amount_zscore_sender", "near_threshold_100k", "near_threshold_500k", "near_threshold_1000k", "velocity_burst_ratio",
    "sender_institution_risk", "receiver_institution_risk", "sender_branch_risk", "receiver_branch_risk",
]
#: Alternatives as a user states them.
EXAMPLE_PATHS = [("all", ["model", "graph", "rules"], 0.82), ("no_rules", ["model", "graph"], 0.76), ("no_graph", ["model", "rules"], 0.72), ("model_only", ["model"], 0.62)]


def _r(*columns, digits=6):
    return [F.round(c, digits).alias(c) for c in columns]


def holder_flags(spark, folder):
    """Per institution the highest grade among its accounts."""
    rated = accounts(spark, folder).withColumn("grade", features.risk_value())
    return network.holder_table(rated, "institution", "grade")


def heterogeneous_sizes(spark, folder):
    acc = accounts(spark, folder)
    holders = network.holder_table(acc.withColumn("grade", features.risk_value()), "institution", "grade")
    parts = network.heterogeneous(transactions(spark, folder), acc, holders, "institution")
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def node_features(spark, folder):
    return network.node_features(graph.last_edges(edges(spark, folder))).select("id", "in_degree", "out_degree", *_r("amount", digits=2), "n_edges")


def busiest_subgraph(spark, folder):
    return network.busiest(materialise(graph.last_edges(edges(spark, folder))), 50)


def latest_transactions(spark, folder):
    return network.latest(transactions(spark, folder).where("day IS NOT NULL"), 500, "day", "row_index").select("row_index")


def graph_assertions(spark, folder, rounds=None):
    e = materialise(edges(spark, folder))
    ranks = materialise(flow.td_pagerank(e, HALF_LIFE, rounds=rounds))
    return network.assertions(e, network.single_weights(e, HALF_LIFE), ranks, HALF_LIFE)


def recent_ego_share(spark, folder):
    e = materialise(edges(spark, folder))
    seeds = graph.vertices(e).where("id % 100 = 0")
    return graph.recent_within_two(e, seeds).select("seed", *_r("velocity_ratio"))


def threat_landscape(spark, folder):
    """Of the 50 riskiest accounts how many send abroad fast, move fast, or make many small transfers."""
    tx = features.behaviour(transactions(spark, folder))
    top = risk.account_risk(transactions(spark, folder)).select("account_id", F.round(F.col("risk_recent_weighted") + 1e-9, 6).alias("w")).orderBy(F.desc("w"), "account_id").limit(K)
    rows = tx.select("row_index", "velocity_sum_10tx", "cross_border_flag", "tx_count_10", "amount", F.explode(F.array_distinct(F.array("s", "r"))).alias("account_id"))
    per = rows.join(top.select("account_id"), "account_id", "left_semi").groupBy("account_id").agg(
        F.avg("velocity_sum_10tx").alias("v"), F.sum("cross_border_flag").alias("c"), F.avg("tx_count_10").alias("n"), F.avg("amount").alias("a")
    )
    return per.agg(
        F.count_if((F.col("c") > 0) & (F.col("v") > 500_000)).alias("abroad_fast"), F.count_if(F.col("v") > 1_000_000).alias("fast"), F.count_if((F.col("n") > 10) & (F.col("a") < 50_000)).alias("many_small")
    )


def rule_study(spark, folder):
    """Ranking quality before and after the example rules raise the scores."""
    rows = materialise(features.behaviour(transactions(spark, folder)).where("score IS NOT NULL").withColumn("raised", fusion.raised(F.col("score"), SHARE_RULES)).select("row_index", "label", "score", "raised"))
    before = metrics.at_k(rows, K, "score").withColumn("track", F.lit("scores"))
    after = metrics.at_k(rows, K, "raised").withColumn("track", F.lit("with rules"))
    return before.unionByName(after).select("track", *_r("precision", "recall", "ndcg", "lift"))


def ablation(spark, folder):
    """Trees on base features, and on base and graph features: quality on the test split, and the part of importance the graph features have."""
    e = materialise(edges(spark, folder))
    d = graph.reciprocity(graph.last_edges(e)).select(F.col("id").alias("account_id"), *(F.col(c).alias(f"gf_{c}") for c in ("in_degree", "out_degree", "reciprocity")))
    tx = features.temporal_split(features.temporal(features.trailing_counts(transactions(spark, folder))))
    wide = features.role_join(tx, materialise(d), "account_id", {c: c for c in d.columns if c != "account_id"}).na.fill(0, GRAPH)
    rows = materialise(wide.select("row_index", "split", "label", *BASE, *GRAPH))
    out = None
    for track, names in (("base", BASE), ("base and graph", BASE + GRAPH)):
        model = learned.fit_trees(rows.where("split = 'train'"), names, trees=8, depth=4)
        done = materialise(learned.scored(model, rows.where("split = 'test'"), names).select("row_index", "label", F.col("model_score").alias("score")))
        part = learned.share_of(learned.importances(model, names), "sender_gf") + learned.share_of(learned.importances(model, names), "receiver_gf")
        one = metrics.at_k(done, K).select(F.lit(track).alias("track"), "precision", "ndcg", "lift", metrics.average_precision(done).select("average_precision").scalar().alias("average_precision"), F.lit(part).alias("graph_share"))
        out = one if out is None else out.unionByName(one)
    return out


def account_explanations(spark, folder):
    """Per sender the five features that raise its riskiest transaction most, in words."""
    tx = materialise(features.temporal(features.trailing_counts(transactions(spark, folder))).select("row_index", "s", "label", "score", *BASE))
    model = learned.fit_linear(tx, BASE)
    worst = tx.where("s IS NOT NULL AND score IS NOT NULL").groupBy("s").agg(F.max_by("row_index", F.struct("score", "row_index")).alias("row_index"))
    parts = learned.contributions(model, tx.join(worst, ["s", "row_index"], "left_semi"), BASE).withColumn("label", features.readable(F.col("feature"), features.FEATURE_LABELS))
    text = parts.groupBy("row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), " || ").alias("text"))  # five at most
    return worst.join(text, "row_index", "left").select(F.col("s").alias("account_id"), F.coalesce("text", F.lit("No single feature raises this account's risk.")).alias("text"))


def path_selection(spark, folder):
    """For each week of feedback the best alternative that needs only parts with feedback that week."""
    table = spark.createDataFrame(EXAMPLE_PATHS, "path_id string, required array<string>, precision double")
    part = F.when(F.col("path_id").isin("full", "no_nlp"), "model").when(F.col("path_id").isin("no_symbolic", "lgbm_pagerank"), "graph").otherwise("rules")
    weeks = feedback(spark, folder).groupBy(F.floor(F.unix_date(F.to_date("ts")) / 7).alias("week")).agg(F.array_sort(F.collect_set(part)).alias("healthy"))
    return paths.best_path(paths.available(table, weeks, "week"), 0.60, "week").select("week", "path_id")


def network_weights(spark, folder):
    """Weights of three scores of a vertex and a penalty, from networks fitted on whether the vertex takes part in a labelled transaction: mean model score, share of edges that come in, and reciprocity."""
    d = graph.reciprocity(graph.last_edges(edges(spark, folder)))
    seen = risk.by_role(transactions(spark, folder), "score", "label").groupBy(F.col("account_id").alias("id")).agg(F.max("label").alias("label"), F.avg("score").alias("mean_score"))
    rows = d.join(seen, "id", "left").na.fill(0, ["label"]).na.fill(0.0, ["mean_score"])
    rows = materialise(rows.select("id", "label", "mean_score", "degree_ratio", "reciprocity", F.log1p("in_degree").alias("i"), F.log1p("out_degree").alias("o")))
    names = ["i", "o", "reciprocity"]
    inputs = [F.col(c) for c in names]
    w = neural.attention(neural.fit_weights(rows, names, ["mean_score", "degree_ratio", "reciprocity"], "label"), np.eye(3), *inputs)
    p = neural.group_penalty(neural.fit_penalty(rows, names, "label"), *inputs)
    out = rows.select("id", w.alias("w"), p.alias("penalty"))
    return out.select("id", *(F.round(F.col("w")[i], 6).alias(n) for i, n in enumerate(fusion.NAMES)), F.round("penalty", 6).alias("penalty"))


def adaptive_fusion(spark, folder, rounds=None):
    """Each transaction's score, its sender's place in the graph and its rule points, weighted by how isolated the sender is; static weights where the sender is not in the graph."""
    simple = materialise(graph.last_edges(edges(spark, folder)))
    d = graph.degrees(simple).join(graph.ego_to_three(simple), "id")
    n = F.col("in_degree") + F.col("out_degree")
    raised = d.withColumn("w", fusion.isolated(fusion.pack(F.lit(0.5), F.lit(0.3), F.lit(0.2)), 1 / (1 + n)))
    held = raised.withColumn("w", fusion.floored(F.col("w"), F.col("ego_nodes"))).join(flow.pagerank(simple.withColumnRenamed("amount", "weight"), rounds=rounds), "id")
    vertex = fusion.minmax(materialise(held.select("id", "w", "rank")), "rank", "place").select("id", "w", "place")
    tx = fusion.apply_rules(features.behaviour(transactions(spark, folder)), TX_RULES)
    joined = tx.join(vertex.withColumnRenamed("id", "s"), "s", "left")
    fused = fusion.fuse_three(F.col("w"), F.coalesce("score", F.lit(0.0)), F.coalesce("place", F.lit(0.0)), fusion.rule_bump(F.col("points")))
    return joined.select("row_index", F.round(fused, 6).alias("fused"), F.round(risk.confidence(F.coalesce("score", F.lit(0.0))), 6).alias("confidence"))


def fusion_gain(spark, folder, rounds=None):
    """Precision of the weighted scores over that of the scores alone."""
    done = materialise(adaptive_fusion(spark, folder, rounds))
    rows = materialise(transactions(spark, folder).select("row_index", "label", "score").where("score IS NOT NULL").join(done, "row_index"))
    return metrics.improvement(metrics.at_k(rows, K, "score"), metrics.at_k(rows, K, "fused"), "precision").select("metric", *_r("before", "after", "gain"), "enough")


def report(sections: dict, wanted: tuple[str, ...]):
    """One table (section, measure, value) of the evaluations that are wanted; an error names those that were not run."""
    missing = [n for n in wanted if sections.get(n) is None]
    if missing:
        raise RuntimeError(f"not evaluated yet: {', '.join(missing)}")
    out = None
    for name in wanted:
        one = sections[name].select("section", "x.measure", "x.value")
        out = one if out is None else out.unionByName(one)
    return out


def _training_graph(spark, folder, split):
    """Graph features of the edges before the last day of the training split; edges have no time, so that day's could be later than the boundary."""
    end = split.where("split = 'train'").agg(F.max("day")).scalar()
    return materialise(flow.graph_features(materialise(features.until(edges(spark, folder), F.date_sub(end, 1))), HALF_LIFE, SOURCES))


def _reasons(fused, wide, fitted, names):
    """(account_id, reasons): of each account's riskiest transaction, in either role, the features that raise a linear model's score most, in words."""
    worst = materialise(risk.by_role(fused, "row_index", "score").groupBy("account_id").agg(F.max_by("row_index", F.struct("score", "row_index")).alias("row_index")))
    rows = materialise(wide.join(worst.select("row_index").distinct(), "row_index", "left_semi").select("row_index", *names))
    parts = learned.contributions(learned.fit_linear(fitted, names), rows, names).withColumn("label", features.readable(F.col("feature"), features.FEATURE_LABELS))
    text_of = parts.groupBy("row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), " || ").alias("reasons"))  # five at most
    return worst.join(text_of, "row_index", "left").select("account_id", F.coalesce("reasons", F.lit("No single feature raises this account's risk.")).alias("reasons"))


def _rule_facts(fused):
    """Facts of the scored transactions per account, judged by the rules: cross-border over both roles, flow without a least divisor, and whether a sender lies in a cycle."""
    ratio = F.when(F.col("total_in") > 0, F.col("total_out") / F.when(F.col("total_in") > 0, F.col("total_in"))).otherwise(0.0)
    facts = risk.account_facts(fused).withColumns({"cross_border_ratio_out": F.col("cross_border_ratio"), "flow_ratio": ratio})
    cycles = risk.by_role(fused, "sender_gf_in_cycle").groupBy("account_id").agg((F.max("sender_gf_in_cycle") > 0).alias("is_cycle"))
    return fusion.apply_rules(facts.join(cycles, "account_id"), FACT_RULES)


def _narratives(facts):
    """facts with a narrative of each account, its summary, and how much of it the summary keeps."""
    money = lambda c: F.concat(F.lit("NPR "), F.format_number(F.col(c), 0))
    story = F.concat(
        F.lit("Account "), F.col("account_id"), F.lit(" received "), F.col("count_in"), F.lit(" transfers from "), F.col("unique_senders"), F.lit(" senders totalling "), money("total_in"),
        F.lit(". It sent "), F.col("count_out"), F.lit(" transfers to "), F.col("unique_receivers"), F.lit(" receivers totalling "), money("total_out"),
        F.lit(". Patterns: "), F.col("typologies"), F.lit("."),
    )
    return text.faithfulness(text.summary(text.entities(facts.withColumn("narrative", story), "narrative"), "narrative", sentences=2))


def risk_pipeline(spark, folder):
    """From the tables to ranked accounts: graph features up to the training boundary, the wide training relation, trees fitted on the training split, the test split scored and raised by rules,
    accounts aggregated, banded, named and ranked, with reasons, rules and narratives."""
    split = materialise(features.temporal_split(transactions(spark, folder)))
    wide = features.training_rows(split, accounts(spark, folder), _training_graph(spark, folder, split))
    wide = written(wide.where("split IN ('train', 'test')"), "wide")  # four steps read it; features are those of all rows, the validation split's are not read
    names = features.kept_columns(wide.where("split = 'train'"), [*WIDE, *(c for c in wide.columns if "_gf_" in c)])
    fitted = wide.where("split = 'train'").select("row_index", "label", *names)
    model = learned.fit_trees(fitted, names, trees=8, depth=4)
    scored = fusion.apply_rules(learned.scored(model, wide.where("split = 'test'"), names), TX_RULES)
    seen = ["row_index", "s", "r", "day", "amount", "cross_border_flag", "tx_count_10", "tx_count_30", "sender_gf_in_cycle"]
    fused = materialise(scored.select(*seen, fusion.fuse(F.col("model_score"), points=F.col("points")).alias("score")))
    banded = in_order(risk.priority_bands(materialise(risk.account_risk(fused))).withColumn("_v", -F.col("risk_recent_weighted")), "_v", "account_id")
    held = features.one_per_key(accounts(spark, folder), "account_id").select("account_id", "name", "institution", "risk_grade")
    told = _narratives(_rule_facts(fused)).select("account_id", "is_cycle", "points", "typologies", "explanation", "summary", *_r("faithfulness", digits=4), "faithful")
    out = banded.join(held, "account_id", "left").join(_reasons(fused, wide.where("split = 'test'"), fitted, names), "account_id", "left").join(told, "account_id", "left")
    return out.select(
        F.col("_rank").alias("place"), "account_id", "name", "institution", "risk_grade", "priority", "tx_count", *_r("risk_recent_weighted"),
        "reasons", "is_cycle", "points", "typologies", "explanation", "summary", "faithfulness", "faithful",
    )


QUERIES = {x.__name__: x for x in (
    holder_flags, heterogeneous_sizes, node_features, busiest_subgraph, latest_transactions, graph_assertions, recent_ego_share, threat_landscape, rule_study, ablation,
    account_explanations, path_selection, network_weights, adaptive_fusion, fusion_gain, risk_pipeline,
)}


def _at_k(track: str, order: str) -> str:
    top = f"(SELECT label, row_number() OVER (ORDER BY {order} DESC, row_index) AS rk FROM ra)"
    return f"""SELECT '{track}' AS track, round(hits / {K}, 6) AS precision, round(hits / pos, 6) AS recall, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, {K} + 1) t(i) WHERE i <= pos), 6) AS ndcg, round(hits / {K} / (pos / n), 6) AS lift
FROM (SELECT sum(label) FILTER (rk <= {K}) AS hits, sum(label) AS pos, count(*) AS n, sum(label / log2(rk + 1)) FILTER (rk <= {K}) AS dcg FROM {top})"""


def _raised() -> str:
    x = "score"
    for r in SHARE_RULES:
        x = f"least(greatest(({x}) + CASE WHEN {r.condition} THEN {r.points}e0 ELSE 0e0 END, 0), 1)"
    return x


_NEEDS = ", ".join(f"('{p}', {need!r}, {v}e0)" for p, need, v in EXAMPLE_PATHS)

ORACLES = {
    "path_selection": f"""WITH {FEEDBACK_SQL}, w AS (SELECT CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS week,
  list(DISTINCT CASE WHEN path_id IN ('full', 'no_nlp') THEN 'model' WHEN path_id IN ('no_symbolic', 'lgbm_pagerank') THEN 'graph' ELSE 'rules' END) AS healthy FROM fb GROUP BY 1),
o AS (SELECT week, p, v FROM w JOIN (VALUES {_NEEDS}) t(p, need, v) ON list_has_all(healthy, need)) SELECT week, coalesce(arg_max(p, v), 'halt') AS path_id FROM w LEFT JOIN o USING (week) GROUP BY 1""",
    "holder_flags": "SELECT institution, max(CASE risk_grade WHEN 'RISK-HIGH' THEN 3 WHEN 'RISK-MED' THEN 2 ELSE 1 END) AS grade FROM accounts WHERE institution IS NOT NULL GROUP BY 1",
    "heterogeneous_sizes": f"""WITH {TX_SQL} SELECT 'account' AS part, count(*) AS n FROM accounts UNION ALL SELECT 'holder', count(DISTINCT institution) FROM accounts
UNION ALL SELECT 'transacts', count(*) FROM tx WHERE s IN (SELECT account_id FROM accounts) AND r IN (SELECT account_id FROM accounts) UNION ALL SELECT 'owns', count(*) FROM accounts WHERE institution IS NOT NULL""",
    "node_features": f"""WITH {EDGE_SQL}, {SIMPLE_SQL} SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, round(sum(amount), 2) AS amount, count(*) AS n_edges FROM (
SELECT src AS id, 0 AS i, 1 AS o, amount FROM g UNION ALL SELECT dst, 1, 0, amount FROM g) GROUP BY 1""",
    "busiest_subgraph": f"""WITH {EDGE_SQL}, {SIMPLE_SQL}, k AS (SELECT id FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 50)
SELECT * FROM g WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""",
    "latest_transactions": f"WITH {TX_SQL} SELECT row_index FROM tx WHERE day IS NOT NULL ORDER BY day DESC, row_index DESC LIMIT 500",
    "threat_landscape": f"""WITH {RISK_SQL}, {VELOCITY_SQL}, x AS (SELECT s AS a, * FROM vel UNION ALL SELECT r AS a, * FROM vel WHERE r IS DISTINCT FROM s),
p AS (SELECT a, avg(velocity_sum_10tx) AS v, sum(cross_border_flag) AS c, avg(tx_count_10) AS n, avg(amount) AS m FROM x WHERE a IN (SELECT account_id FROM t50) GROUP BY 1)
SELECT count(*) FILTER (c > 0 AND v > 500000) AS abroad_fast, count(*) FILTER (v > 1000000) AS fast, count(*) FILTER (n > 10 AND m < 50000) AS many_small FROM p""",
    "rule_study": f"WITH {TX_SQL}, {VELOCITY_SQL}, ra AS (SELECT row_index, label, score, {_raised()} AS raised FROM vel WHERE score IS NOT NULL) {_at_k('scores', 'score')} UNION ALL {_at_k('with rules', 'raised')}",
}
