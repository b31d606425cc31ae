"""Ranks of the registered queries are those that further rounds no longer change."""

import numpy as np
import pytest

from ledgerlens.plans import graph_queries, risk_queries, study_queries
from ledgerlens.operators import flow

PAIRS = [(i, i + 1) for i in range(11)] + [(11, 0), (0, 6), (3, 3), (7, 2)]
EDGES = "src bigint, dst bigint, amount double, day date, at string"


@pytest.fixture
def ring(spark):
    return spark.createDataFrame([(a, b, 1.0, None, "2025-04-01") for a, b in PAIRS], EDGES).selectExpr("src", "dst", "amount", "DATE'2025-04-01' AS day", "at")


def test_pagerank(spark, ring, monkeypatch):
    monkeypatch.setattr(graph_queries, "edges", lambda *_: ring)
    m = np.zeros((12, 12))
    for a, b in PAIRS:
        m[b, a] = 1 / sum(x == a for x, _ in PAIRS)
    want = np.linalg.solve(np.eye(12) - 0.85 * m, np.full(12, 0.15 / 12))
    for name, column in (("pagerank", "rank"), ("td_pagerank", "raw")):
        got = {r["id"]: r[column] for r in graph_queries.QUERIES[name](spark, "").collect()}
        assert [got[i] for i in range(12)] == pytest.approx(want, abs=1e-6)
    cut = {r["id"]: r["rank"] for r in graph_queries.pagerank_fixed(spark, "").collect()}
    assert max(abs(cut[i] - want[i]) for i in range(12)) > 1e-4


def test_hits(spark, monkeypatch):
    data = spark.createDataFrame([(1, 5, 1.0, None, "x"), (1, 6, 1.0, None, "x"), (2, 6, 1.0, None, "x"), (2, 7, 1.0, None, "x"), (3, 7, 1.0, None, "x")], EDGES)
    monkeypatch.setattr(graph_queries, "edges", lambda *_: data)
    m = np.array([[1.0, 1, 0], [0, 1, 1], [0, 0, 1]])
    v = np.abs(np.linalg.eigh(m @ m.T)[1][:, -1])
    got = {r["id"]: r["hub"] for r in graph_queries.QUERIES["hits"](spark, "").collect()}
    assert [got[i] for i in (1, 2, 3)] == pytest.approx(v / v.sum(), abs=1e-5)


def test_no_query_without_sql_is_cut(spark, ring, monkeypatch):
    asked, real = [], flow.pagerank
    monkeypatch.setattr(flow, "pagerank", lambda *a, **k: asked.append(k.get("rounds")) or real(*a, **{**k, "rounds": 2}))
    for module in (study_queries, risk_queries):
        monkeypatch.setattr(module, "edges", lambda *_: ring)
    tx = spark.createDataFrame([(1, 1, 2)], "row_index bigint, s bigint, r bigint").selectExpr("*", "DATE'2025-04-01' AS day", "'10:00:00' AS tm", "1.0D AS amount", "0 AS cross_border_flag", "0 AS label", "0.5D AS score")
    monkeypatch.setattr(study_queries, "transactions", lambda *_: tx)
    study_queries.adaptive_fusion(spark, "")
    study_queries.graph_assertions(spark, "")
    risk_queries.known_node_diff_settled(spark, "")
    risk_queries.outer_node_diff_settled(spark, "")
    assert asked == [None] * 6
