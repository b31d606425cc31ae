"""Measures on a graph held as arrays give the rows of the plans, and no circle of edges without length keeps them busy."""

import random

import numpy as np
import pytest

from ledgerlens.operators import flow, graph, held

ARC = "src bigint, dst bigint, amount double"


def _graph(spark, seed, n=60, m=200):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), min(rng.randrange(n), rng.randrange(n), rng.randrange(n))) for _ in range(m)} | {(100, 101), (200, 200), *((300, 301 + i) for i in range(5))}
    return spark.createDataFrame([(a, b, float(rng.randrange(5))) for a, b in sorted(pairs)], ARC)


def test_betweenness_in_arrays_and_rows(spark, monkeypatch):
    simple = _graph(spark, 1)
    arrays = {r["id"]: r["betweenness"] for r in flow.betweenness(simple, 7).collect()}
    monkeypatch.setattr(held, "MOST_ARCS", 1)
    rows = {r["id"]: r["betweenness"] for r in flow.betweenness(simple, 7).collect()}
    assert rows == pytest.approx(arrays) and sum(x > 0 for x in arrays.values()) > 5


@pytest.mark.parametrize("most", [held.MOST_ARCS, 1])
def test_edges_lost_in_the_distance(spark, monkeypatch, most):
    """Two accounts that pay each other nothing, so far away that 1e-9 is lost in the distance: their paths were counted without an end."""
    monkeypatch.setattr(held, "MOST_ARCS", most)
    simple = spark.createDataFrame([(0, 1, 1e8), (1, 2, 0.0), (2, 1, 0.0), (2, 3, 5.0)], ARC)
    got = {r["id"]: r["betweenness"] for r in flow.betweenness(simple).collect()}
    assert got == pytest.approx({0: 0.0, 1: 2 / 6, 2: 2 / 6, 3: 0.0})


def _unused(*_):
    raise AssertionError("rows (seed, member) are made")


def test_shapes_without_rows_of_members(spark, monkeypatch):
    simple = _graph(spark, 2)
    seeds = spark.createDataFrame([(i,) for i in (0, 1, 7, 100, 101, 200, 300, 304, 999)], "id bigint")
    want = {r["seed"]: r for r in graph.topology(simple, seeds).collect()}
    with monkeypatch.context() as m:
        m.setattr(graph, "two_hop", _unused)
        got = {r["seed"]: r for r in graph.topology(simple, seeds).collect()}
    assert got == want and {100, 101, 200, 300, 304} <= set(got) and 999 not in got
    monkeypatch.setattr(held, "MOST_ARCS", 1)
    rows = {r["seed"]: r for r in graph.topology(simple, seeds).collect()}
    assert set(rows) == set(got)
    for seed, r in rows.items():
        assert got[seed].asDict() == pytest.approx(r.asDict())


def _far(n, pairs):
    """All distances by Floyd and Warshall's steps."""
    d = [[0 if i == j else 1 if (i, j) in pairs or (j, i) in pairs else 99 for j in range(n)] for i in range(n)]
    for k in range(n):
        for i in range(n):
            if d[i][k] < 99:
                d[i] = [min(x, d[i][k] + y) for x, y in zip(d[i], d[k])]
    return d


def _networks():
    yield 30, {(i, j) for i in range(15) for j in range(15, 30)}  # two sides
    yield 40, {(0, i) for i in range(1, 40)}
    yield 6, {(i, j) for i in range(6) for j in range(i)}
    yield 5, {(i, (i + 1) % 5) for i in range(5)}
    yield 6, {(i, (i + 1) % 6) for i in range(6)}
    yield 200, {(0, i) for i in range(1, 5)} | {(1 + i % 4, i) for i in range(5, 200)}  # leaves beyond the first 64
    yield 201, {(0, i) for i in range(1, 3)} | {(1 + j, i) for i in range(3, 200) for j in (0, 1)} | {(2, 200)}
    rng = random.Random(5)
    for _ in range(20):
        n = rng.randint(3, 120)
        yield n, {(rng.randrange(n), rng.randrange(n) // rng.randint(1, 9)) for _ in range(rng.randint(n, 4 * n))}


def test_shapes_by_all_distances():
    widest = set()
    for n, pairs in _networks():
        a, b = (np.array(x) for x in zip(*sorted(pairs)))
        ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        g = held.Held(ids, places[: len(a)], places[len(a) :], {}).with_triangles().with_neighbours()
        d = _far(n, pairs)
        for at in range(0, g.n, 7):
            ego = [v for v in range(n) if d[ids[at]][v] <= 2]
            inner = {(i, j) for i, u in enumerate(ego) for j, v in enumerate(ego) if (u, v) in pairs}
            near = [{j for j in range(len(ego)) if j != i and {(i, j), (j, i)} & inner} for i in range(len(ego))]
            local = [sum(y in near[x] for x in s for y in s if x < y) / (len(s) * (len(s) - 1) / 2) if len(s) > 1 else 0 for s in near]
            n_nodes, n_edges, diameter, clustering, _ = held.shape(g, at)
            assert (n_nodes, n_edges, diameter) == (len(ego), len(inner), max(map(max, _far(len(ego), inner))))
            assert clustering == pytest.approx(sum(local) / len(local))
            widest.add(diameter)
    assert widest == {1, 2, 3, 4}
