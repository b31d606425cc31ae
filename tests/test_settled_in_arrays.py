"""Ranks, hubs and strong components of one graph come out of arrays as out of plans, in one task instead of plans a round."""

import random

import numpy as np
import pytest

from ledgerlens.operators import flow, held


def _edges(spark, pairs):
    rows = [(a, b, x, f"2025-0{1 + day // 28}-{1 + day % 28:02d}") for a, b, x, day in pairs]
    return spark.createDataFrame(rows, "src bigint, dst bigint, amount double, at string").selectExpr("src", "dst", "amount", "CAST(at AS DATE) AS day", "at")


def _unused(*_, **__):
    raise AssertionError("a plan a round")


def test_graph_features_in_arrays_and_rows(spark, monkeypatch):
    pairs = [(1, 2, 3.0, 99), (2, 3, 1.0, 98), (3, 1, 4.0, 99), (3, 4, 0.0, 97), (5, 4, 2.0, 3), (5, 4, 8.0, 1), (60, 60, 2.0, 5), (6, 7, 1.0, 60), (7, 6, 1.0, 99)]
    edges = _edges(spark, pairs)
    with monkeypatch.context() as m:
        for name in ("strong_components", "td_pagerank", "hits"):
            m.setattr(flow, name, _unused)
        arrays = {r["account_id"]: r.asDict() for r in flow.graph_features(edges, 7.0, 3).collect()}
    simple = flow.last_edges(edges)
    g = held.hold(simple.join(flow.temporal_edges(edges, 7.0), ["src", "dst"]).join(flow.aged(edges).groupBy("src", "dst").agg({"age": "min"}).withColumnRenamed("min(age)", "age"), ["src", "dst"]), "weight", "age")
    names = {"hub": "gf_hub_score", "authority": "gf_authority_score", "normalised": "gf_pagerank", "cycle_member": "gf_cycle_member", "in_cycle": "gf_in_cycle"}
    for i, *x in zip(*flow._settled(g).values()):
        assert [arrays[i][c] for c in names.values()] == pytest.approx([*map(float, x)], abs=1e-9)
    monkeypatch.setattr(flow, "ROUNDS", 3)  # few plans; both stop there
    arrays = {i: x for i, *x in zip(*flow._settled(g).values())}
    rows = {r["id"]: [r[c] for c in names] for r in flow._settled_in_rows(edges, simple, 7.0).collect()}
    assert set(arrays) == set(rows) == {1, 2, 3, 4, 5, 6, 7, 60}
    for i, r in rows.items():
        assert [*map(float, arrays[i])] == pytest.approx([*map(float, r)], abs=1e-9)
        assert r[3:] == [i in (1, 2, 3), int(i in (1, 2, 3, 6, 7))]


def test_ranks_and_hubs_by_algebra():
    a, b = np.array([0, 0, 1, 2, 3, 4, 4]), np.array([1, 2, 2, 0, 2, 3, 4])
    g, w = held.Held(np.arange(6), a, b, {}), np.array([1.0, 3, 1, 1, 2, 0, 1])
    m = np.full((6, 6), 1 / 6)
    m[:, :5] = 0
    for x, y, z in zip(g.src, g.dst, w):
        m[y, x] += z / w[g.src == x].sum()
    assert held.ranks(g, w, 0.85, 1e-12, 500) == pytest.approx(np.linalg.solve(np.eye(6) - 0.85 * m, np.full(6, 0.15 / 6)))
    links = np.zeros((6, 6))
    links[a, b] = 1
    hub, authority = held.hubs(g, 1e-12, 5000)
    best = np.abs(np.linalg.eigh(links @ links.T)[1][:, -1])
    assert hub == pytest.approx(best / best.sum(), abs=1e-6) and authority == pytest.approx(links.T @ hub / (links.T @ hub).sum(), abs=1e-6)
    assert [x.tolist() for x in held.hubs(g, 1e-12, 1)] == [[1 / 6] * 6] * 2


def test_strong_components_by_reachability():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 14)
        a, b = (np.array(x) for x in zip(*{(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 30))}))
        ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        g = held.Held(ids, places[: len(a)], places[len(a) :], {})
        reach = np.eye(g.n, dtype=bool)
        reach[g.src, g.dst] = True
        for k in range(g.n):
            reach |= np.outer(reach[:, k], reach[k])
        assert (held.strong(g) == (reach & reach.T).argmax(1)).all()


def test_no_edges(spark):
    assert flow.graph_features(_edges(spark, [(1, 2, 1.0, 1)]).where("src > 1")).collect() == []
