"""Measures that go out from single vertices, or go on in rounds until they settle, on a whole graph held as arrays.

Rows (source, vertex) grow with the number of sources times the number of vertices; where the
graph itself is small, each task takes some sources and walks the arrays instead, and only its
sums travel. Measures of all vertices together take a plan a round; on the arrays one task goes
through all rounds. The size is checked first: beyond ``MOST_ARCS`` ``hold`` gives nothing, and
the callers fall back on plans, which give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arcs of a graph that is sent to every task, at 16 to 40 bytes each, and wedges searched for its triangles.
MOST_ARCS = 4_000_000
MOST_WEDGES = 20_000_000
#: States (source, vertex) that are walked at once.
STATES = 1 << 16


def starts_of(sorted_: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of 0..n-1 begin in an array in order, and its length."""
    return np.concatenate([[0], np.cumsum(np.bincount(sorted_, minlength=n))])


def spans(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths) of the entries of the vertices ``of``, one vertex after the other."""
    lengths = start[of + 1] - start[of]
    return np.repeat(start[of] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum()), lengths


class Held:
    """A directed graph with its ids in order; src and dst are places among them, arcs sorted by src. columns go with the arcs."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, columns: dict[str, np.ndarray]):
        order = np.argsort(src, kind="stable")
        self.ids, self.n = ids, len(ids)
        self.src, self.dst = src[order].astype(np.int32), dst[order].astype(np.int32)
        self.columns = {k: v[order] for k, v in columns.items()}
        self.start = starts_of(self.src, self.n)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The places of those ids that are vertices."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(self.n - 1, 0))
        return at[self.ids[at] == ids] if self.n else at[:0]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs (a, b), a < b, of neighbours, in order."""
        other = self.src != self.dst
        a, b = self.src[other].astype(np.int64), self.dst[other].astype(np.int64)
        keys = np.unique(np.minimum(a, b) * self.n + np.maximum(a, b))
        return keys // max(self.n, 1), keys % max(self.n, 1)

    def with_neighbours(self) -> Held:
        """near: the other ends of every vertex, each once, without itself; near_of: whose they are; near_start: where they begin."""
        a, b = self.pairs()
        of, near = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((near, of))
        self.near_of, self.near = of[order].astype(np.int32), near[order].astype(np.int32)
        self.near_start = starts_of(self.near_of, self.n)
        return self

    def with_triangles(self) -> Held | None:
        """triangles: three arrays of corners, each triangle once; None where there are too many wedges to search."""
        a, b = self.pairs()
        degree = np.bincount(a, minlength=self.n) + np.bincount(b, minlength=self.n)
        up = (degree[a] < degree[b]) | ((degree[a] == degree[b]) & (a < b))
        x, y = np.where(up, a, b), np.where(up, b, a)
        order = np.lexsort((y, x))
        x, y, keys = x[order], y[order], a * self.n + b
        start = starts_of(x, self.n)
        later = start[x + 1] - np.arange(len(x)) - 1
        if later.sum() > MOST_WEDGES:
            return None
        found: list[np.ndarray] = []
        bounds = np.searchsorted(np.cumsum(later), np.arange(0, later.sum() + 1, 1_000_000)) if len(x) else np.zeros(1, int)
        for low, high in zip(bounds, [*bounds[1:], len(x)]):
            one = np.repeat(np.arange(low, high), later[low:high])
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later[low:high]) - later[low:high], later[low:high])
            key = np.minimum(y[one], y[two]) * self.n + np.maximum(y[one], y[two])
            hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            found.append(np.stack([x[one[hit]], y[one[hit]], y[two[hit]]]).astype(np.int32))
        self.triangles = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int32)
        return self

    def within_two(self, at: int) -> np.ndarray:
        """Of every vertex whether it is at most two steps away in any direction."""
        inside = np.zeros(self.n, bool)
        first = self.near[self.near_start[at] : self.near_start[at + 1]]
        inside[at] = True
        inside[first] = True
        inside[self.near[spans(self.near_start, first)[0]]] = True
        return inside


def hold(arcs: DataFrame, *columns: str) -> Held | None:
    """The graph of arcs (src, dst, columns), or None where it has more than ``MOST_ARCS``."""
    if arcs.limit(MOST_ARCS + 1).count() > MOST_ARCS:
        return None
    table = arcs.select("src", "dst", *columns).toArrow()
    src, dst = (table[c].to_numpy() for c in ("src", "dst"))
    ids, places = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return Held(ids, places[: len(src)], places[len(src) :], {c: table[c].to_numpy() for c in columns})


def dealt(seeds: DataFrame) -> DataFrame:
    """seeds (id), evenly over twice as many tasks as there are cores."""
    return seeds.select("id").repartition(2 * seeds.sparkSession.sparkContext.defaultParallelism)


def _distances(g: Held, w: np.ndarray, sources: np.ndarray, most_rounds: int) -> np.ndarray | None:
    """Distances of the states source * n + vertex; None where they have not settled."""
    n = g.n
    d = np.full(len(sources) * n, np.inf)
    now = np.arange(len(sources)) * n + sources
    d[now] = 0.0
    moved = np.zeros(len(d), bool)
    for _ in range(most_rounds):
        v = now % n
        arc, lengths = spans(g.start, v)
        to, far = np.repeat(now - v, lengths) + g.dst[arc], np.repeat(d[now], lengths) + w[arc]
        nearer = far < d[to]
        to = to[nearer]
        np.minimum.at(d, to, far[nearer])
        moved[to] = True
        now = np.flatnonzero(moved)
        if not len(now):
            return d
        moved[now] = False
    return None


def _shortest(g: Held, w: np.ndarray, d: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arcs (u, v) between states that lie on shortest paths, sorted by u.

    An arc that adds nothing to the distance, being 0 or lost in it, is longer than none:
    of paths of one distance those with the fewest such arcs are the shortest, so that the
    arcs never lead in a circle.
    """
    us, vs, ns = [], [], []
    for k in range(len(sources)):
        one = d[k * g.n : (k + 1) * g.n]
        far = one[g.src] + w
        at = np.flatnonzero((far == one[g.dst]) & np.isfinite(far))
        us.append(g.src[at].astype(np.int64) + k * g.n)
        vs.append(g.dst[at].astype(np.int64) + k * g.n)
        ns.append(far[at] == one[g.src[at]])
    u, v, nothing = np.concatenate(us), np.concatenate(vs), np.concatenate(ns)
    if not nothing.any():
        return u, v
    start = starts_of(u, len(d))
    z = np.full(len(d), np.iinfo(np.int64).max // 2)
    now = np.arange(len(sources)) * g.n + sources
    z[now] = 0
    while len(now):
        arc, lengths = spans(start, now)
        to, steps = v[arc], np.repeat(z[now], lengths) + nothing[arc]
        less = steps < z[to]
        np.minimum.at(z, to[less], steps[less])
        now = np.unique(to[less])
    kept = z[u] + nothing == z[v]
    return u[kept], v[kept]


def dependencies(g: Held, w: np.ndarray, sources: np.ndarray, most_rounds: int) -> np.ndarray | None:
    """Per vertex the sum of the dependencies of the sources on it; None where distances have not settled. As many sources at once as ``STATES`` allows."""
    total = np.zeros(g.n)
    step = max(1, STATES // max(g.n, 1))
    for i in range(0, len(sources), step):
        part = sources[i : i + step]
        d = _distances(g, w, part, most_rounds)
        if d is None:
            return None
        u, v = _shortest(g, w, d, part)
        first = np.arange(len(part)) * g.n + part
        start, waits = starts_of(u, len(d)), np.bincount(v, minlength=len(d))
        sigma, delta, levels = np.zeros(len(d)), np.zeros(len(d)), []
        sigma[first] = 1.0
        now = first
        while len(now):  # a state is ready when all arcs into it have been walked
            arc, lengths = spans(start, now)
            a, b = np.repeat(now, lengths), v[arc]
            np.add.at(sigma, b, sigma[a])
            np.subtract.at(waits, b, 1)
            levels.append((a, b))
            now = np.unique(b[waits[b] == 0])
        for a, b in reversed(levels):
            np.add.at(delta, a, sigma[a] / sigma[b] * (1 + delta[b]))
        delta[first] = 0.0
        total += delta.reshape(len(part), g.n).sum(axis=0)
    return total


def summed_dependencies(g: Held, distance: str, seeds: DataFrame, most_rounds: int) -> DataFrame:
    """(id, v, open): the dependencies of the seeds on each vertex, a row per task; open tells that a task's distances have not settled."""
    shared = seeds.sparkSession.sparkContext.broadcast(g)  # at most MOST_ARCS arcs
    kind = seeds.schema["id"].dataType.simpleString()

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = [f["id"].to_numpy() for f in frames]
        if not sum(map(len, ids)):
            return
        g = shared.value
        total = dependencies(g, g.columns[distance], g.places(np.concatenate(ids)), most_rounds)
        if total is None:
            yield pd.DataFrame({"id": g.ids[:1], "v": [0.0], "open": [True]})
        else:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"id": g.ids[at], "v": total[at], "open": False})

    return dealt(seeds).mapInPandas(walked, f"id {kind}, v double, open boolean")


def per_seed(g: Held, seeds: DataFrame, measure, schema: str) -> DataFrame:
    """(seed, *schema): ``measure(graph, place)`` of every seed that is a vertex; g needs its neighbours."""
    shared = seeds.sparkSession.sparkContext.broadcast(g)  # at most MOST_ARCS arcs
    names = ["seed", *(x.split()[0] for x in schema.split(","))]

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            g = shared.value
            yield pd.DataFrame([(g.ids[at], *measure(g, at)) for at in g.places(frame["id"].to_numpy())], columns=names)

    return dealt(seeds.select("id").distinct()).mapInPandas(measured, f"seed {seeds.schema['id'].dataType.simpleString()}, {schema}")


def recent(g: Held, at: int) -> tuple[float | None]:
    """The share of recent rows among those inside the network; columns n and recent count the rows of an arc."""
    inside = g.within_two(at)
    both = inside[g.src] & inside[g.dst]
    n = int(g.columns["n"][both].sum())
    return (int(g.columns["recent"][both].sum()) / n if n else None,)


def once(g: Held, spark: SparkSession, measure, schema: str) -> DataFrame:
    """(schema): the columns that ``measure(graph)`` gives, in one task; nothing of a graph without vertices."""
    shared = spark.sparkContext.broadcast(g)  # at most MOST_ARCS arcs

    def measured(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if shared.value.n:
            yield pd.DataFrame(measure(shared.value))

    return spark.range(0, 1, 1, 1).mapInPandas(measured, schema)


def ranks(g: Held, weight: np.ndarray, damping: float, tolerance: float, most_rounds: int) -> np.ndarray:
    """PageRank of every vertex, until the L1 distance of two rounds is below ``tolerance``; a vertex without outgoing weight spreads its rank evenly."""
    total = np.bincount(g.src, weight, g.n)[g.src]
    used = (weight > 0) & (total > 0)
    src, dst, p = g.src[used], g.dst[used], weight[used] / total[used]
    dangling = np.bincount(src, minlength=g.n) == 0
    now = np.full(g.n, 1 / g.n)
    for _ in range(most_rounds):
        before, now = now, (1 - damping) / g.n + damping * (np.bincount(dst, now[src] * p, g.n) + now[dangling].sum() / g.n)
        if np.abs(now - before).sum() < tolerance:
            break
    return now


def hubs(g: Held, tolerance: float, most_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Hub and authority of every vertex, each adding up to 1; 1/n everywhere where the hubs have not settled."""
    hub = np.ones(g.n)
    for _ in range(most_rounds):
        authority = np.bincount(g.dst, hub[g.src], g.n)
        authority /= authority.sum()
        before, hub = hub, np.bincount(g.src, authority[g.dst], g.n)
        hub /= hub.sum()
        if np.abs(hub - before).sum() < tolerance:
            return hub, authority
    return np.full(g.n, 1 / g.n), np.full(g.n, 1 / g.n)


def strong(g: Held) -> np.ndarray:
    """The least place in the strongly connected component of every vertex, by one walk in depth (Tarjan's)."""
    start, dst, at = memoryview(g.start), memoryview(g.dst), memoryview(g.start[:-1].copy())
    seen, low, label = (memoryview(x) for x in (np.zeros(g.n, np.int32), np.zeros(g.n, np.int32), np.full(g.n, -1, np.int32)))
    n, stack, path = 0, [], []
    for root in range(g.n):
        if not seen[root]:
            path.append(root)
        while path:
            v = path[-1]
            if not seen[v]:
                n += 1
                seen[v] = low[v] = n
                stack.append(v)
            end, i = start[v + 1], at[v]
            while i < end:
                u = dst[i]
                if not seen[u]:
                    path.append(u)
                    break
                if label[u] < 0 and low[u] < low[v]:
                    low[v] = low[u]
                i += 1
            at[v] = i
            if i < end:
                continue  # that arc is looked at again once its end is done
            path.pop()
            if low[v] == seen[v]:
                cut = len(stack) - 1
                while stack[cut] != v:
                    cut -= 1
                least = min(stack[cut:])
                for u in stack[cut:]:
                    label[u] = least
                del stack[cut:]
    return np.asarray(label)


def _variance(x: np.ndarray) -> float:
    """Of all of them, from exact sums of integers."""
    n, s, q = len(x), int(x.sum()), int((x.astype(np.int64) ** 2).sum())
    return (n * q - s * s) / (n * n)


#: What ``shape`` gives.
SHAPE = "n_nodes bigint, n_edges bigint, diameter int, clustering double, asymmetry double"


def shape(g: Held, at: int) -> tuple:
    """n_nodes, n_edges, diameter, clustering, asymmetry of the network within two steps; g needs its triangles."""
    inside = g.within_two(at)
    n = int(inside.sum())
    both = inside[g.src] & inside[g.dst]
    into, out = (np.bincount(x[both], minlength=g.n)[inside] for x in (g.dst, g.src))
    both_near = inside[g.near_of] & inside[g.near]
    of, near = g.near_of[both_near], g.near[both_near]
    degree = np.bincount(of, minlength=g.n)[inside]
    a, b, c = g.triangles
    all_three = inside[a] & inside[b] & inside[c]
    corners = np.bincount(g.triangles[:, all_three].ravel(), minlength=g.n)[inside]
    wedges = degree * (degree - 1)
    clustering = float(np.divide(2.0 * corners, wedges, out=np.zeros(n), where=wedges > 0).mean())
    number = np.cumsum(inside) - 1
    widest = _diameter(int(number[at]), number[of], number[near], degree)
    return n, int(both.sum()), widest, clustering, _variance(into) / max(_variance(out), 1e-10)


def _diameter(seed: int, of: np.ndarray, near: np.ndarray, degree: np.ndarray) -> int:
    """Of a network within two steps of its seed, exact: neighbours (of, near) in order of ``of``.

    The diameter is at most four, and only vertices two steps from the seed can be ends of
    a way of more than two. They are searched 64 at once, a bit each, those with few
    neighbours first, until one has a vertex four steps away. A vertex that reaches all in
    two steps leaves none of its neighbours more than three.
    """
    n = len(degree)
    if n == 1:
        return 0
    if len(of) == n * (n - 1):
        return 1
    if degree.max() == n - 1:
        return 2
    start = starts_of(of, n)
    far = np.ones(n, bool)
    far[seed] = False
    far[near[start[seed] : start[seed + 1]]] = False
    widest = 2
    hubs = np.argsort(-degree, kind="stable")[:8]
    todo = np.flatnonzero(far)
    todo = todo[np.argsort(degree[todo], kind="stable")]
    while len(todo):
        part = np.concatenate([hubs, todo[: 64 - len(hubs)]])
        todo = todo[64 - len(hubs) :]
        reach = np.zeros(n, np.uint64)
        np.bitwise_or.at(reach, part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
        whole = []
        for _ in range(3):
            reach = reach | np.bitwise_or.reduceat(reach[near], start[:-1])
            all_ = int(np.bitwise_and.reduce(reach))
            whole.append([bool(all_ >> i & 1) for i in range(len(part))])
        if not all(whole[2]):
            return 4
        if not all(whole[1]):
            widest = 3
        close = np.zeros(n, bool)
        for h, done in zip(hubs, whole[1]):
            if done:
                close[near[start[h] : start[h + 1]]] = True
        if len(hubs):
            capped, hubs = close, hubs[:0]
        if widest == 3:
            todo = todo[~capped[todo]]
    return widest
