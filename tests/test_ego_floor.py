"""The floor of the model's weight goes by the vertices within two steps, not by degrees."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import graph
from ledgerlens.plans import risk_queries

EDGES = "src bigint, dst bigint, amount double, day date, at string"


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0, None, "2025-01-01") for a, b in pairs], EDGES)


def test_small_networks_are_floored(spark, monkeypatch):
    data = _edges(spark, [(1, 2), (2, 1), (1, 1), (10, 11), (10, 12), (20, 20)])
    monkeypatch.setattr(risk_queries, "edges", lambda *_: data)
    w = {r["id"]: round(r["w_ml"], 3) for r in risk_queries.adaptive_weights(spark, "").collect()}
    assert (w[1], w[2], w[10]) == (0.70, 0.70, 0.633)


def test_counts_match_two_hop(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(45)} | {(90, 90), (91, 92), (92, 91), (93, 94), (94, 95)}
    simple = graph.last_edges(_edges(spark, pairs))
    want = {r[0]: min(r[1], 3) for r in graph.two_hop(simple, graph.vertices(simple)).groupBy("seed").agg(F.count("*")).collect()}
    assert {r["id"]: r["ego_nodes"] for r in graph.ego_to_three(simple).collect()} == want and set(want.values()) == {1, 2, 3}
