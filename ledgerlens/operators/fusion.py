"""Scores of several sources brought together, and rules that raise them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.features import clip
from ledgerlens.operators.ordering import in_order

# Bounds of a weight, static weights, saturation of rule points.
LOW, HIGH = 0.05, 0.90
STATIC = (0.70, 0.15, 0.15)
BUMP, SATURATION = 0.25, 50.0
NAMES = ("w_ml", "w_graph", "w_rules")


def rule_bump(points: Column) -> Column:
    """Rule points as a raise of the score that saturates at 0.25."""
    return BUMP * (1 - F.exp(-points / SATURATION))


def fuse(tabular: Column, graph: Column | None = None, points: Column | None = None) -> Column:
    """0.7 tabular + 0.3 graph where there is a graph score, raised by rule points, within 0..1."""
    score = tabular if graph is None else 0.7 * tabular + 0.3 * graph
    return clip(score if points is None else score + rule_bump(points), 0.0, 1.0)


def fuse_three(weights: Column, ml: Column, graph: Column, rules: Column) -> Column:
    """The weighted sum within 0..1; static weights where the struct of weights is NULL or holds a NULL or NaN."""
    ok = weights.isNotNull()
    for n in NAMES:
        ok = ok & weights[n].isNotNull() & ~F.isnan(weights[n])
    w = [F.when(ok, weights[n]).otherwise(d) for n, d in zip(NAMES, STATIC)]
    return clip(w[0] * ml + w[1] * graph + w[2] * rules, 0.0, 1.0)


def pack(*w: Column) -> Column:
    return F.struct(*(x.alias(n) for x, n in zip(w, NAMES)))


def bounded(weights: Column, passes: int, low: float = LOW, high: float = HIGH) -> Column:
    """Clamped and brought to a sum of 1, so many times."""
    steps = F.sequence(F.lit(1), F.lit(passes))

    def once(w: Column, _: Column) -> Column:
        c = [clip(w[n], low, high) for n in NAMES]
        total = c[0] + c[1] + c[2]
        return pack(*(x / total for x in c))

    return F.aggregate(steps, pack(*(weights[n].cast("double") for n in NAMES)), once)


def isolated(weights: Column, isolation: Column) -> Column:
    """The model's weight raised towards 0.90 by how isolated (0..1) an account is, the rest split in proportion, bounded."""
    ml = clip(weights["w_ml"] + isolation * (HIGH - weights["w_ml"]), LOW, HIGH)
    others = weights["w_graph"] + weights["w_rules"]
    part = F.when(others > 0, weights["w_graph"] / F.when(others > 0, others)).otherwise(0.5)
    return bounded(pack(ml, (1 - ml) * part, (1 - ml) * (1 - part)), 6)


def floored(weights: Column, ego_nodes: Column) -> Column:
    """At least 0.70 for the model where the network has fewer than three vertices; the others share 0.30, each at least 0.05, or half and half where that does not fit."""
    others = weights["w_graph"] + weights["w_rules"]
    g = F.when(others > 0, 0.30 * weights["w_graph"] / F.when(others > 0, others)).otherwise(0.15)
    r = F.when(others > 0, 0.30 * weights["w_rules"] / F.when(others > 0, others)).otherwise(0.15)
    g2, r2 = F.greatest(g, F.lit(0.05)), F.greatest(r, F.lit(0.05))
    over = ((g < 0.05) | (r < 0.05)) & (g2 + r2 > 0.30)
    low = pack(F.lit(0.70), F.when(over, 0.15).otherwise(g2), F.when(over, 0.15).otherwise(r2))
    return F.when((ego_nodes < 3) & (weights["w_ml"] < 0.70), low).otherwise(pack(*(weights[n].cast("double") for n in NAMES)))


def reciprocal_ranks(df: DataFrame, scores: list[str], key: str, k: int = 60) -> DataFrame:
    """df with rrf: the sum of 1/(k + rank) over the scores, highest first, ties by key."""
    total = F.lit(0.0)
    for i, s in enumerate(scores):
        df = in_order(df.withColumn("_v", -F.col(s).cast("double")), "_v", key).withColumn(f"_r{i}", F.col("_rank")).drop("_v", "_rank", "_n")
        total = total + 1 / (k + F.col(f"_r{i}"))
    return df.withColumn("rrf", total).drop(*(f"_r{i}" for i in range(len(scores))))


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """The column brought to 0..1 over all rows, 0 where all are equal or NULL."""
    low, high = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    return df.withColumn(out, F.coalesce(F.when(high > low, (F.col(column) - low) / F.when(high > low, high - low)), F.lit(0.0)))


#: What a degraded path blends: shares of score and graph, and whether rules raise the result.
PATHS = {
    "full": (1.0, 0.0, True), "no_nlp": (1.0, 0.0, True), "no_symbolic": (1.0, 0.0, False), "no_pagerank": (1.0, 0.0, True), "no_fusion": (0.70, 0.15, True),
    "lgbm_pagerank": (0.75, 0.25, False), "lgbm_rules": (1.0, 0.0, True), "lgbm_only": (1.0, 0.0, False), "halt": (1.0, 0.0, False),
}


def path_score(path: str, score: Column, graph: Column, points: Column) -> Column:
    """The score of a path, within 0..1; an unknown path gives the raw score."""
    a, b, rules = PATHS.get(path, (1.0, 0.0, False))
    blended = a * score + b * graph if b else score
    return clip(blended + rule_bump(points) if rules else blended, 0.0, 1.0)


@dataclass(frozen=True)
class Rule:
    """A named condition (SQL over the row) with points; facts it names that are NULL do not match."""

    name: str
    condition: str
    points: float
    text: str = ""


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with points (sum), typologies (sorted, each once; 'None') and explanation (in the rules' order)."""
    hits = [(F.coalesce(F.expr(r.condition), F.lit(False)), r) for r in rules]
    names = F.filter(F.array(*(F.when(c, r.name) for c, r in hits)), lambda x: x.isNotNull())
    texts = F.filter(F.array(*(F.when(c, r.text or r.name) for c, r in hits)), lambda x: x.isNotNull())
    return df.withColumns({
        "points": sum((F.when(c, float(r.points)).otherwise(0.0) for c, r in hits), F.lit(0.0)),
        "typologies": F.when(F.size(names) > 0, F.array_join(F.array_sort(F.array_distinct(names)), ", ")).otherwise("None"),
        "explanation": F.when(F.size(texts) > 0, F.array_join(texts, " | ")).otherwise("No anomalous rules triggered."),
    })


def rule_report(df: DataFrame, rules: list[Rule], score: str = "score") -> DataFrame:
    """(rule, triggers, mean_uplift): the rules' points as direct raises of the score, clipped; one scan."""
    hits = [(F.coalesce(F.expr(r.condition), F.lit(False)), r) for r in rules]
    one = df.agg(*(
        F.struct(F.lit(r.name).alias("rule"), F.count_if(c).alias("triggers"), F.coalesce(F.avg(F.when(c, clip(F.col(score) + r.points, 0.0, 1.0) - F.col(score))), F.lit(0.0)).alias("mean_uplift")).alias(f"r{i}")
        for i, (c, r) in enumerate(hits)
    ))
    return one.select(F.explode(F.array(*(f"r{i}" for i in range(len(hits))))).alias("x")).select("x.*")


def raised(score: Column, rules: list[Rule]) -> Column:
    """The score raised rule by rule, clipped after each."""
    for r in rules:
        score = clip(F.when(F.coalesce(F.expr(r.condition), F.lit(False)), score + r.points).otherwise(score), 0.0, 1.0)
    return score
