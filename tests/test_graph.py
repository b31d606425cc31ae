"""Graph measures against plain Python models on small random graphs."""

import datetime
import heapq
import random
from collections import defaultdict

import pytest

from ledgerlens.operators import flow, graph
from ledgerlens.operators.components import components

DAY = datetime.date(2024, 1, 1)


def edges_of(spark, rows):
    """rows: (src, dst, amount, days ago)."""
    full = [(s, d, float(a), DAY - datetime.timedelta(days=k), datetime.datetime(2024, 1, 1) - datetime.timedelta(days=k)) for s, d, a, k in rows]
    return spark.createDataFrame(full, "src bigint, dst bigint, amount double, day date, at timestamp")


SAMPLE = [(0, 1, 50000, 2), (1, 2, 30000, 5), (2, 0, 25000, 3), (0, 3, 100000, 1), (3, 4, 75000, 10), (4, 1, 20000, 45)]
RANDOM = [(a, b, c, d) for rnd in [random.Random(4)] for a, b, c, d in [(rnd.randint(0, 14), rnd.randint(0, 14), rnd.randint(1, 9), rnd.randint(0, 60)) for _ in range(40)]]


def reach(rows):
    out = defaultdict(set)
    for s, d, *_ in rows:
        out[s].add(d)
        out[d]
    seen = {}
    for v in out:
        stack, got = [v], set()
        while stack:
            for w in out[stack.pop()]:
                if w not in got:
                    got.add(w)
                    stack.append(w)
        seen[v] = got
    return seen


@pytest.mark.parametrize("rows", [SAMPLE, RANDOM, [(1, 2, 1, 0)], [(1, 1, 1, 0)], [(1, 2, 1, 0), (2, 1, 1, 0), (3, 4, 1, 0), (4, 3, 1, 0), (2, 3, 1, 0)]])
def test_strong_components(spark, rows):
    far = reach(rows)
    want = {v: min({v} | {w for w in far[v] if v in far[w]}) for v in far}
    got = {r["id"]: r for r in flow.strong_components(edges_of(spark, rows)).collect()}
    assert {v: r["scc"] for v, r in got.items()} == want
    assert all(r["size"] == list(want.values()).count(want[v]) for v, r in got.items())


def test_pagerank(spark):
    simple = graph.last_edges(edges_of(spark, RANDOM)).withColumnRenamed("amount", "weight")
    w = {(r["src"], r["dst"]): r["weight"] for r in simple.collect()}
    nodes = sorted({x for k in w for x in k})
    total = defaultdict(float)
    for (s, _), x in w.items():
        total[s] += x
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        loose = sum(rank[v] for v in nodes if not total[v]) / len(nodes)
        new = {v: 0.15 / len(nodes) + 0.85 * loose for v in nodes}
        for (s, d), x in w.items():
            new[d] += 0.85 * rank[s] * x / total[s]
        gap, rank = sum(abs(new[v] - rank[v]) for v in nodes), new
        if gap < 1e-6:
            break
    got = {r["id"]: r["rank"] for r in flow.pagerank(simple).collect()}
    assert got == pytest.approx(rank, abs=1e-9) and sum(got.values()) == pytest.approx(1)


def test_decay_and_dormancy(spark):
    e = edges_of(spark, [(0, 1, 50000, 60), (1, 2, 30000, 90), (2, 0, 25000, 45), (3, 4, 100000, 1), (4, 3, 80000, 2)])
    t = {(r["src"], r["dst"]): r for r in graph.temporal_edges(e, 7.0).collect()}
    import math

    assert t[0, 1]["weight"] == pytest.approx(50000 * math.exp(-0.693 / 7 * 59), rel=1e-9)
    assert {r["id"] for r in graph.dormant(e).collect()} == {0, 1, 2}
    out = {r["id"]: r for r in flow.td_pagerank(e).collect()}
    assert all(0 <= r["normalised"] <= 1 and r["score"] >= 0 for r in out.values())
    assert {v for v, r in out.items() if r["dormant"]} == {0, 1, 2} and {v for v, r in out.items() if r["cycle_member"]} == {0, 1, 2}
    assert max(r["score"] for v, r in out.items() if r["dormant"]) <= 0.1 * max(r["score"] for r in out.values()) + 1e-12


def test_bursts(spark):
    e = edges_of(spark, [(0, i, 10, 1) for i in range(1, 7)] + [(0, 9, 10, 30), (5, 1, 10, 0)])
    assert [(r["src"], r["n_window"], r["n_total"]) for r in graph.bursts(e).collect()] == [(0, 6, 7)]


def test_closed_group_penalty(spark):
    e = edges_of(spark, [(a, b, 1e6, 1) for a in range(3) for b in range(3) if a != b] + [(5, 0, 0.01, 1)])
    plain = {r["id"]: r["raw"] for r in flow.td_pagerank(e).collect()}
    after = {r["id"]: r["score"] for r in flow.td_pagerank(e).collect()}
    assert all(after[v] == pytest.approx(plain[v] * 0.5) for v in range(3)) and after[5] == pytest.approx(plain[5])


def test_clustering_and_reciprocity(spark):
    simple = graph.last_edges(edges_of(spark, [*SAMPLE, (1, 0, 5, 1), (7, 7, 1, 1)]))
    near = defaultdict(set)
    for s, d, *_ in [*SAMPLE, (1, 0, 5, 1)]:
        near[s].add(d)
        near[d].add(s)
    got = {r["id"]: r for r in graph.clustering(simple).collect()}
    for v, n in near.items():
        links = sum(b in near[a] for a in n for b in n if a < b)
        assert got[v]["triangles"] == links and got[v]["clustering"] == pytest.approx(2 * links / (len(n) * (len(n) - 1)) if len(n) > 1 else 0)
    assert got[7]["clustering"] == 0
    r = {x["id"]: x for x in graph.reciprocity(simple).collect()}
    assert r[0]["mutual"] == 1 and r[0]["reciprocity"] == pytest.approx(1 / 3)


def test_betweenness(spark):
    simple = graph.last_edges(edges_of(spark, RANDOM))
    arcs = defaultdict(list)
    for r in simple.collect():
        if r["src"] != r["dst"]:
            arcs[r["src"]].append((r["dst"], r["amount"]))
    nodes = sorted({x for r in simple.collect() for x in (r["src"], r["dst"])})
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, before, order = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), []
        heap, done = [(0.0, s)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for w, x in arcs[v]:
                if w not in dist or d + x < dist[w]:
                    dist[w], sigma[w], before[w] = d + x, sigma[v], [v]
                    heapq.heappush(heap, (d + x, w))
                elif d + x == dist[w] and w not in done:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    n = len(nodes)
    want = {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}
    assert {r["id"]: r["betweenness"] for r in flow.betweenness(simple).collect()} == pytest.approx(want)


def test_topology(spark):
    simple = graph.last_edges(edges_of(spark, [*RANDOM, (40, 41, 1, 1)]))
    seeds = spark.createDataFrame([(1,), (40,), (99,), (3,)], "id bigint")
    near = defaultdict(set)
    arcs = {(r["src"], r["dst"]) for r in simple.collect()}
    for s, d in arcs:
        near[s].add(d)
        near[d].add(s)
    got = {r["seed"]: r for r in graph.topology(simple, seeds).collect()}
    assert set(got) == {1, 40, 3}
    for seed, r in got.items():
        ego = {seed} | near[seed] | {y for x in near[seed] for y in near[x]}
        assert r["n_nodes"] == len(ego) and r["n_edges"] == sum(s in ego and d in ego for s, d in arcs)

        def far(v):
            dist, todo = {v: 0}, [v]
            for x in todo:
                for y in near[x] & ego:
                    if y not in dist:
                        dist[y] = dist[x] + 1
                        todo.append(y)
            return max(dist.values())

        assert r["diameter"] == max(far(v) for v in ego)


def test_hits(spark):
    simple = graph.last_edges(edges_of(spark, SAMPLE))
    out = flow.hits(simple, 15).collect()
    assert sum(r["hub"] for r in out) == pytest.approx(1) and sum(r["authority"] for r in out) == pytest.approx(1)


def test_components(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_chains_and_rings_of_any_length(spark):
    """A chain of 10,000 vertices, a ring of 5,000, a long loop that leaves and enters one vertex, a chain between two rings."""
    n = 10_000
    chain = [(i, i + 1) for i in range(n)]
    ring = [(20_000 + i, 20_000 + (i + 1) % 5000) for i in range(5000)]
    loop = [(30_000, 30_500), *((30_500 + i, 30_501 + i) for i in range(300)), (30_800, 30_000), (30_000, 5)]
    two = [(40_000, 40_001), (40_001, 40_000), (40_000, 40_100), *((40_100 + i, 40_101 + i) for i in range(50)), (40_150, 40_200), (40_200, 40_201), (40_201, 40_200), (1, 40_000)]
    df = spark.createDataFrame([*chain, *ring, *loop, *two, (7, 7)], "src bigint, dst bigint")
    got = {r["id"]: (r["scc"], r["size"]) for r in flow.strong_components(df).collect()}
    big = {k: v for k, v in got.items() if v[1] > 1}
    assert all(big[20_000 + i] == (20_000, 5000) for i in range(5000))
    assert all(big[x] == (30_000, 302) for x in [30_000, *range(30_500, 30_801)])
    assert big[40_000] == big[40_001] == (40_000, 2) and big[40_200] == big[40_201] == (40_200, 2)
    assert len(big) == 5000 + 302 + 4 and got[5] == (5, 1) and got[40_120] == (40_120, 1)


def test_strong_components_against_reachability(spark):
    import random

    rnd = random.Random(3)
    for _ in range(6):
        n = rnd.randint(2, 30)
        pairs = {(rnd.randint(0, n), rnd.randint(0, n)) for _ in range(rnd.randint(1, 2 * n))}
        reach = {v: {v} for e in pairs for v in e}
        for _ in range(n + 1):
            for a, b in pairs:
                reach[a] |= reach[b]
        want = {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
        got = {r["id"]: (r["scc"], r["size"]) for r in flow.strong_components(spark.createDataFrame(list(pairs), "src bigint, dst bigint")).collect()}
        assert got == {v: (c, sum(x == c for x in want.values())) for v, c in want.items()}
