"""Iterative measures: PageRank, its temporal variant, hubs and authorities, strong components, betweenness.

An iteration is a join of the current vertex values with the edges and an aggregation that
is pre-combined on the map side; lineage is cut by a checkpoint after every round or every
few. Scalars (dangling mass, distance between rounds) are subqueries or one-row results.
``graph_features`` goes through the rounds on arrays where the graph fits a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import held
from ledgerlens.operators.graph import CLOSED_SHARE, DORMANT_CAP, DORMANT_DAYS, aged, clustering, decay_impact, dormant, incident, last_edges, reciprocity, temporal_edges, vertices
from ledgerlens.session import materialise, written

# Damping, tolerance and rounds of both variants; what a closed group's vertex keeps of its rank.
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 100
COLLECTOR, DISTRIBUTOR, BALANCED, SYMMETRIC = 0.25, 0.5, 0.375, 0.5
#: The age of an edge without a day, older than any.
UNDATED = 2**31 - 1


def pagerank(weighted: DataFrame, nodes: DataFrame | None = None, rounds: int | None = None, tolerance: float = TOLERANCE, per_node: bool = False) -> DataFrame:
    """(id, rank) over edges (src, dst, weight), ranks adding up to 1.

    rounds: exactly so many; otherwise until the L1 distance of two rounds is below
    ``tolerance`` (times the number of vertices with per_node), at most 100. A vertex
    without outgoing weight spreads its rank evenly. No edges and no nodes: no rows.
    """
    nodes = vertices(weighted) if nodes is None else nodes
    total = weighted.groupBy("src").agg(F.sum("weight").alias("_t")).where("_t > 0")
    moves = materialise(weighted.join(total, "src").where("weight > 0").select("src", "dst", (F.col("weight") / F.col("_t")).alias("p")))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    loose = moves.select(F.col("src").alias("id")).distinct().withColumn("_gives", F.lit(True))
    ranks = materialise(nodes.select("id").join(loose, "id", "left").select("id", F.col("_gives").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    for i in range(rounds or ROUNDS):
        spread = F.coalesce(ranks.where("dangling").agg(F.sum("rank")).scalar(), F.lit(0.0))
        got = moves.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("_in"))
        now = ranks.select("id", "dangling", F.col("rank").alias("_old")).join(got, "id", "left")
        now = now.withColumn("rank", F.lit((1 - DAMPING) / n) + DAMPING * (F.coalesce("_in", F.lit(0.0)) + spread / n)).drop("_in")
        if rounds is None or (i + 1) % 5 == 0 or i + 1 == rounds:
            now = materialise(now)
        ranks = now
        if rounds is None:
            apart = now.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
            if apart < tolerance * (n if per_node else 1):
                break
        ranks = ranks.drop("_old")
    return ranks.select("id", "rank")


def hits(simple: DataFrame, rounds: int | None = 20, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, hub, authority) of the unweighted graph, each adding up to 1.

    rounds: exactly so many; with None until the L1 distance of the hubs of two rounds is
    below ``tolerance``. Hubs that have not settled within 100 rounds give 1/n everywhere.
    """
    nodes = vertices(simple)
    links = materialise(simple.select("src", "dst").distinct())
    now = materialise(nodes.select("id", F.lit(1.0).alias("hub"), F.lit(0.0).alias("authority")))
    for i in range(rounds or ROUNDS):
        a = links.join(now.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("authority"))
        a = a.withColumn("authority", F.col("authority") / a.agg(F.sum("authority")).scalar())
        h = links.join(a.select(F.col("id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("hub"))
        h = h.withColumn("hub", F.col("hub") / h.agg(F.sum("hub")).scalar())
        before, now = now, materialise(nodes.join(h, "id", "left").join(a, "id", "left").na.fill(0.0))
        if rounds is None:
            apart = now.join(before.select("id", F.col("hub").alias("_old")), "id").agg(F.sum(F.abs(F.col("hub") - F.col("_old")))).first()[0]
            if apart is None or apart < tolerance:
                break
    else:
        if rounds is None:
            even = 1.0 / nodes.count()
            return nodes.select("id", F.lit(even).alias("hub"), F.lit(even).alias("authority"))
    return now.select("id", "hub", "authority")


def strong_components(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, scc, size): scc is the least vertex of the strongly connected component.

    Chains of vertices with one edge in and one out are drawn together first, in rounds
    that grow with the logarithm of their length. Vertices without an edge in or out are
    trimmed. On the rest the least label that reaches a vertex colours it; going backwards
    inside a colour from the vertex of that label finds its component, and what is left goes
    round again. An error where it has not settled after ``most_rounds``.
    """
    every = vertices(edges)
    links = materialise(edges.select("src", "dst").where("src <> dst").distinct())
    rest, chains = _drawn_together(links)
    found: DataFrame | None = None
    for _ in range(most_rounds):
        rest, left = _trimmed(rest)
        if not left:
            break
        colour = _least_label(rest, vertices(rest).withColumn("label", F.col("id")))
        same = (
            rest.join(colour.select(F.col("id").alias("src"), F.col("label").alias("_a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("_b")), "dst")
            .where("_a = _b").select("src", "dst", F.col("_a").alias("label"))
        )
        reached = _reached_backwards(materialise(same), colour.where("id = label").select("id", "label"))
        found = reached if found is None else materialise(found.unionByName(reached))
        rest = materialise(rest.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))
    else:
        raise RuntimeError("the strong components did not settle")
    return _sized(every, found, chains)


def _drawn_together(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(links, chains): links with each chain of vertices that have one edge in and one out as a single link; chains (id, p, n, ring): what lies before and behind each such vertex, or the least vertex of the ring that nothing enters or leaves.

    Pointers are doubled, so a chain of L vertices takes about log2(L) rounds.
    """
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degree = links.select(F.inline(ends)).groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    inner = degree.where("i = 1 AND o = 1").select("id")
    now = links.select(F.col("src").alias("id"), F.col("dst").alias("n")).join(inner, "id").join(links.select(F.col("dst").alias("id"), F.col("src").alias("p")), "id")
    now = written(now.withColumn("least", F.col("id")), "chains")
    size = now.count()
    if not size:
        return links, None
    for i in range(size.bit_length() + 1):
        ahead = now.select(F.col("id").alias("n"), F.col("n").alias("_n"), F.col("least").alias("_least"))
        behind = now.select(F.col("id").alias("p"), F.col("p").alias("_p"))
        now = written(
            now.join(ahead, "n", "left").join(behind, "p", "left").select(
                "id", F.coalesce("_p", "p").alias("p"), F.coalesce("_n", "n").alias("n"), F.least("least", F.coalesce("_least", "least")).alias("least"), (F.col("_n").isNotNull() | F.col("_p").isNotNull()).alias("moved")
            ),
            "chains",
        )
        if now.where("moved").isEmpty():
            break
    # what still moves after more steps than there are vertices goes round in a ring
    chains = now.select("id", "p", "n", F.when(F.col("moved"), F.col("least")).alias("ring"))
    kept = links.join(now.select(F.col("id").alias("src")), "src", "left_anti").join(now.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
    drawn = chains.where("ring IS NULL AND p <> n").select(F.col("p").alias("src"), F.col("n").alias("dst"))
    return materialise(kept.unionByName(drawn).distinct()), chains


def _trimmed(rest: DataFrame) -> tuple[DataFrame, int]:
    """The links without those that begin at a vertex nothing leads to, or end at one nothing leaves, again and again; and their number."""
    before = rest.count()
    while before:
        rest = materialise(
            rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        )
        after = rest.count()
        if after == before:
            break
        before = after
    return rest, before


def _least_label(links: DataFrame, start: DataFrame) -> DataFrame:
    """Labels passed on along the edges until every vertex has the least that reaches it."""
    now = materialise(start.withColumn("_moved", F.lit(True)))
    while not now.where("_moved").isEmpty():
        sent = links.join(now.where("_moved").select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("_got"))
        now = materialise(now.select("id", "label").join(sent, "id", "left").select("id", F.least("label", F.coalesce("_got", "label")).alias("label"), F.coalesce(F.col("_got") < F.col("label"), F.lit(False)).alias("_moved")))
    return now.select("id", "label")


def _reached_backwards(same: DataFrame, start: DataFrame) -> DataFrame:
    """(id, label): what leads to the starts along links (src, dst, label) of their label."""
    reached = materialise(start.withColumn("_new", F.lit(True)))
    while not reached.where("_new").isEmpty():
        back = same.join(reached.where("_new").select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "label").distinct()
        fresh = back.join(reached.select("id"), "id", "left_anti").withColumn("_new", F.lit(True))
        reached = materialise(reached.withColumn("_new", F.lit(False)).unionByName(fresh))
    return reached.select("id", "label")


def _sized(every: DataFrame, found: DataFrame | None, chains: DataFrame | None) -> DataFrame:
    """(id, scc, size) from the labels found; a chain belongs to a component where both of its ends do."""
    label = every.select("id", F.col("id").alias("label")) if found is None else every.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    if chains is not None:
        p, n = label.select(F.col("id").alias("p"), F.col("label").alias("_p")), label.select(F.col("id").alias("n"), F.col("label").alias("_n"))
        drawn = chains.join(p, "p", "left").join(n, "n", "left").select("id", F.when(F.col("ring").isNotNull(), F.col("ring")).when(F.col("_p") == F.col("_n"), F.col("_p")).otherwise(F.col("id")).alias("_label"))
        label = label.join(drawn, "id", "left").select("id", F.coalesce("_label", "label").alias("label"))
    label = materialise(label)
    sizes = label.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("scc"))
    return label.join(sizes, "label").select("id", "scc", "size")


def closed_groups(temporal: DataFrame, scc: DataFrame, least: int = 3) -> DataFrame:
    """(id, scc_size, intra_in, intra_out, intra_share) of the vertices in components of at least ``least``: weight inside the component, and its share of all incident weight."""
    members = scc.where(F.col("size") >= least)
    label = members.select("id", "scc")
    inside = temporal.join(label.withColumnsRenamed({"id": "src", "scc": "_a"}), "src").join(label.withColumnsRenamed({"id": "dst", "scc": "_b"}), "dst").where("_a = _b")
    out = inside.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("intra_out"), F.count("*").alias("intra_out_degree"))
    into = inside.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("intra_in"), F.count("*").alias("intra_in_degree"))
    total = incident(temporal, "weight").groupBy("id").agg(F.sum("weight").alias("_t"))
    joined = members.join(out, "id", "left").join(into, "id", "left").join(total, "id", "left").na.fill(0.0, ["intra_out", "intra_in"]).na.fill(0, ["intra_out_degree", "intra_in_degree"])
    intra = F.col("intra_in") + F.col("intra_out")
    return joined.select(
        "id", F.col("size").alias("scc_size"), "intra_in", "intra_out", (F.col("intra_in_degree") + F.col("intra_out_degree")).alias("intra_degree"),
        F.when(intra > 0, F.col("intra_in") / F.when(intra > 0, intra)).otherwise(0.5).alias("flow_ratio"),
        F.when(F.col("_t") > 0, intra / F.when(F.col("_t") > 0, F.col("_t"))).otherwise(0.0).alias("intra_share"),
    )


def penalties(groups: DataFrame, asymmetric: bool = False) -> DataFrame:
    """(id, factor): what is left of the rank of a vertex with more than ``CLOSED_SHARE`` of its weight inside its component."""
    factor = F.lit(SYMMETRIC)
    if asymmetric:
        factor = F.when(F.col("intra_in") > F.col("intra_out"), COLLECTOR).when(F.col("intra_in") < F.col("intra_out"), DISTRIBUTOR).otherwise(BALANCED)
    return groups.where(F.col("intra_share") > CLOSED_SHARE).select("id", factor.alias("factor"))


def td_pagerank(edges: DataFrame, half_life: float = 7.0, rounds: int | None = None, asymmetric: bool = False, dormant_days: int = DORMANT_DAYS, scc: DataFrame | None = None) -> DataFrame:
    """(id, raw, score, normalised, cycle_member, dormant): PageRank on decayed weights, penalised in closed groups, capped where dormant, then brought to 0..1 (0 where all are equal)."""
    temporal = materialise(temporal_edges(edges, half_life))
    ranks = pagerank(temporal, rounds=rounds)
    scc = materialise(strong_components(edges)) if scc is None else scc
    factor = penalties(closed_groups(temporal, scc), asymmetric)
    out = ranks.join(factor, "id", "left").withColumn("_p", F.col("rank") * F.coalesce("factor", F.lit(1.0)))
    out = out.join(dormant(edges, dormant_days).select("id", F.lit(True).alias("dormant")), "id", "left").join(scc.select("id", (F.col("size") > 2).alias("cycle_member")), "id")
    out = materialise(out)
    cap = DORMANT_CAP * out.agg(F.max("_p")).scalar()
    out = out.withColumn("score", F.when(F.col("dormant"), F.least(F.col("_p"), cap)).otherwise(F.col("_p")))
    low, high = out.agg(F.min("score")).scalar(), out.agg(F.max("score")).scalar()
    return out.select(
        "id", F.col("rank").alias("raw"), "score", F.when(high > low, (F.col("score") - low) / F.when(high > low, high - low)).otherwise(0.0).alias("normalised"),
        "cycle_member", F.coalesce("dormant", F.lit(False)).alias("dormant"),
    )


def betweenness(simple: DataFrame, sources: int = 500, distance: str = "amount", most_rounds: int = 1000) -> DataFrame:
    """(id, betweenness) from ``sources`` vertices taken by a hash of the id, amounts as distances, scaled by n/k over (n-1)(n-2).

    Distances below 1e-9 are longer than nothing and shorter than all others: of paths of
    one length those with the fewest such edges are the shortest. The tasks walk the graph
    held as arrays; one too large for that is walked in rows.
    """
    nodes = vertices(simple)
    n = nodes.count()
    k = min(sources, n)
    arcs = materialise(simple.where("src <> dst").select("src", "dst", F.when(F.col(distance) >= 1e-9, F.col(distance)).otherwise(0.0).alias("w")))
    seeds = materialise(nodes.orderBy(F.xxhash64("id"), "id").limit(k))
    graph = held.hold(arcs, "w")
    if graph is None:
        sums = _dependencies(arcs, seeds, most_rounds)
    else:
        sums = materialise(held.summed_dependencies(graph, "w", seeds, most_rounds).groupBy("id").agg(F.sum("v").alias("v"), F.max("open").alias("open")))
        if not sums.where("open").isEmpty():
            raise RuntimeError("the distances did not settle")
    scale = n / (k * (n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.join(sums.select("id", (F.col("v") * scale).alias("betweenness")), "id", "left").na.fill(0.0, ["betweenness"])


def _dependencies(arcs: DataFrame, seeds: DataFrame, most_rounds: int) -> DataFrame:
    """(id, v): the dependencies of the seeds on each vertex. Distances, path counts and dependencies are rows (source, vertex) that are relaxed until nothing changes, so neither the graph nor a source's tree has to fit a task. A distance is its length and the number of edges that add nothing to it."""
    further = F.struct((F.col("d.l") + F.col("w")).alias("l"), (F.col("d.z") + (F.col("d.l") + F.col("w") == F.col("d.l")).cast("long")).alias("z"))
    now = materialise(seeds.select(F.col("id").alias("o"), "id", F.struct(F.lit(0.0).alias("l"), F.lit(0).cast("long").alias("z")).alias("d")))
    moved = now
    for _ in range(most_rounds):
        step = moved.join(arcs, moved["id"] == arcs["src"]).groupBy("o", F.col("dst").alias("id")).agg(F.min(further).alias("_n"))
        both = materialise(now.join(step, ["o", "id"], "full_outer").select("o", "id", F.least("d", "_n").alias("d"), (F.col("d").isNull() | (F.col("_n") < F.col("d"))).alias("_m")))
        now, moved = both.select("o", "id", "d"), both.where("_m").select("o", "id", "d")
        if moved.isEmpty():
            break
    else:
        raise RuntimeError("the distances did not settle")
    to = now.select("o", F.col("id").alias("dst"), F.col("d").alias("_e"))
    tree = materialise(now.join(arcs, now["id"] == arcs["src"]).join(to, ["o", "dst"]).where(further == F.col("_e")).select("o", "src", "dst"))
    sigma = _settle(now.select("o", "id"), tree, seeds)
    weights = materialise(
        tree.join(sigma.select("o", F.col("id").alias("src"), F.col("v").alias("_s")), ["o", "src"]).join(sigma.select("o", F.col("id").alias("dst"), F.col("v").alias("_t")), ["o", "dst"])
        .select("o", "src", "dst", (F.col("_s") / F.col("_t")).alias("f"))
    )
    delta = materialise(now.select("o", "id", F.lit(0.0).alias("v")))
    for _ in range(most_rounds):
        got = weights.join(delta.select("o", F.col("id").alias("dst"), "v"), ["o", "dst"]).groupBy("o", F.col("src").alias("id")).agg(F.sum(F.col("f") * (1 + F.col("v"))).alias("_n"))
        new = materialise(delta.join(got, ["o", "id"], "left").select("o", "id", F.coalesce("_n", F.lit(0.0)).alias("v"), (F.abs(F.coalesce("_n", F.lit(0.0)) - F.col("v")) > 1e-12 * (1 + F.abs("v"))).alias("_m")))
        delta = new.select("o", "id", "v")
        if new.where("_m").isEmpty():
            break
    else:
        raise RuntimeError("the dependencies did not settle")
    return delta.where("o <> id").groupBy("id").agg(F.sum("v").alias("v"))


def _settle(nodes: DataFrame, tree: DataFrame, seeds: DataFrame) -> DataFrame:
    """(o, id, v): the number of shortest paths from each source, summed along the tree until nothing changes."""
    now = materialise(nodes.withColumn("v", (F.col("o") == F.col("id")).cast("double")))
    while True:
        got = tree.join(now.select("o", F.col("id").alias("src"), "v"), ["o", "src"]).groupBy("o", F.col("dst").alias("id")).agg(F.sum("v").alias("_n"))
        one = (F.col("o") == F.col("id")).cast("double")
        new = materialise(now.join(got, ["o", "id"], "left").select("o", "id", (F.coalesce("_n", F.lit(0.0)) + one).alias("n"), "v"))
        settled = new.where("n <> v").isEmpty()
        now = new.select("o", "id", F.col("n").alias("v"))
        if settled:
            return now


#: What ``_settled`` gives of every vertex.
SETTLED = "hub double, authority double, normalised double, cycle_member boolean, in_cycle int"


def _settled(g: held.Held, dormant_days: int = DORMANT_DAYS) -> dict[str, np.ndarray]:
    """(id, *SETTLED) of every vertex of a graph with weights and ages: what ``hits``, ``td_pagerank`` and ``strong_components`` give."""
    weight, age = g.columns["weight"], g.columns["age"]
    hub, authority = held.hubs(g, TOLERANCE, ROUNDS)
    label = held.strong(g)
    size = np.bincount(label, minlength=g.n)[label]
    inside = (label[g.src] == label[g.dst]) & (size[g.src] >= 3)
    intra, total = (np.bincount(g.src[x], weight[x], g.n) + np.bincount(g.dst[x], weight[x], g.n) for x in (inside, slice(None)))
    closed = np.divide(intra, total, out=np.zeros(g.n), where=total > 0) > CLOSED_SHARE
    score = held.ranks(g, weight, DAMPING, TOLERANCE, ROUNDS) * np.where(closed, SYMMETRIC, 1.0)
    youngest = np.full(g.n, UNDATED)
    np.minimum.at(youngest, g.src, age)
    np.minimum.at(youngest, g.dst, age)
    score = np.where((youngest > dormant_days) & (youngest < UNDATED), np.minimum(score, DORMANT_CAP * score.max()), score)
    low, high = score.min(), score.max()
    normalised = (score - low) / (high - low) if high > low else np.zeros(g.n)
    return {"id": g.ids, "hub": hub, "authority": authority, "normalised": normalised, "cycle_member": size > 2, "in_cycle": (size > 1).astype(np.int32)}


def _settled_in_rows(edges: DataFrame, simple: DataFrame, half_life: float) -> DataFrame:
    """(id, *SETTLED), each measure in plans of its own."""
    scc = materialise(strong_components(edges))
    out = scc.select("id", (F.col("size") > 1).cast("int").alias("in_cycle"))
    for other in (hits(simple, None), td_pagerank(edges, half_life, scc=scc).select("id", "normalised", "cycle_member")):
        out = out.join(materialise(other), "id", "left")
    return out


def graph_features(edges: DataFrame, half_life: float = 7.0, sources: int = 500) -> DataFrame:
    """(account_id, gf_*): every measure of a vertex that models take, one row per vertex of the edges.

    The measures that go on in rounds are taken from the graph held as arrays, in one task;
    in a graph too large for that they are plans.
    """
    ages = aged(edges).groupBy("src", "dst").agg(F.coalesce(F.min("age"), F.lit(UNDATED)).alias("age"))
    arcs = materialise(last_edges(edges).join(temporal_edges(edges, half_life), ["src", "dst"]).join(ages, ["src", "dst"]))
    simple = arcs.select("src", "dst", "amount")
    whole = held.hold(arcs.withColumn("weight", F.coalesce("weight", F.lit(0.0))), "weight", "age")
    if whole is None:
        settled = _settled_in_rows(edges, simple, half_life)
    else:
        settled = held.once(whole, edges.sparkSession, _settled, f"id {edges.schema['src'].dataType.simpleString()}, {SETTLED}")
    out = reciprocity(simple)
    for other in (clustering(simple).select("id", "clustering"), betweenness(simple, sources), settled, decay_impact(arcs)):
        out = out.join(materialise(other), "id", "left")
    names = {
        "in_degree": "in_degree", "out_degree": "out_degree", "weighted_in_degree": "weighted_in", "weighted_out_degree": "weighted_out", "clustering_coefficient": "clustering",
        "betweenness": "betweenness", "hub_score": "hub", "authority_score": "authority", "degree_ratio": "degree_ratio", "flow_ratio": "flow_ratio",
        "unique_in_neighbors": "in_degree", "unique_out_neighbors": "out_degree", "reciprocity": "reciprocity", "in_cycle": "in_cycle", "pagerank": "normalised",
        "td_pagerank_score": "normalised", "decay_impact": "decay_impact",
    }
    return out.select(F.col("id").alias("account_id"), *(F.col(c).alias(f"gf_{n}") for n, c in names.items()), F.col("cycle_member").cast("int").alias("gf_cycle_member"))
