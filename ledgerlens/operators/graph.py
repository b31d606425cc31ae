"""Measures of a directed graph given as edges (src, dst, amount, day, at).

Degrees, reciprocity, triangles, temporal weights and neighbourhoods are joins and
aggregates on edge tables; nothing collects the neighbours of a vertex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators import held
from ledgerlens.operators.ordering import in_order
from ledgerlens.session import materialise

# Decay per half-life, days and count of a burst, share of a closed group, days of dormancy and its cap.
DECAY = 0.693
BURST_DAYS, BURST_MORE_THAN = 3, 5
CLOSED_SHARE = 0.8
DORMANT_DAYS, DORMANT_CAP = 30, 0.1


def last_edges(edges: DataFrame) -> DataFrame:
    """The simple graph: one edge for each (src, dst) with the amount of its latest row (ties: the largest amount). Self-loops stay."""
    return edges.groupBy("src", "dst").agg(F.max(F.struct("at", "amount")).getField("amount").alias("amount"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def summed_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, n_edges, amount): parallel edges added up."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n_edges"), F.sum("amount").alias("amount"))


def degrees(simple: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, weighted_in, weighted_out) of the simple graph, 0 where there is nothing."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0.0).alias("wi"), F.col("amount").alias("wo")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("amount").alias("wi"), F.lit(0.0).alias("wo")),
    )
    return simple.select(F.explode(ends).alias("e")).groupBy(F.col("e.id").alias("id")).agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum("e.wi").alias("weighted_in"), F.sum("e.wo").alias("weighted_out")
    )


def share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(empty))


def reciprocity(simple: DataFrame) -> DataFrame:
    """degrees with mutual neighbours, reciprocity (mutual over all neighbours, 0 without any), degree_ratio and flow_ratio (0.5 without any)."""
    back = simple.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    mutual = simple.join(back, ["src", "dst"], "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("mutual"))
    d = degrees(simple).join(mutual, "id", "left").withColumn("mutual", F.coalesce("mutual", F.lit(0)))
    both = F.col("in_degree") + F.col("out_degree")
    flow = F.col("weighted_in") + F.col("weighted_out")
    return d.withColumns({
        "reciprocity": share(F.col("mutual"), both - F.col("mutual"), 0.0),
        "degree_ratio": share(F.col("in_degree"), both, 0.5),
        "flow_ratio": share(F.col("weighted_in"), flow, 0.5),
    })


def undirected(simple: DataFrame) -> DataFrame:
    """(a, b) with a < b: neighbours, without self-loops."""
    return simple.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def corners(pairs: DataFrame, *groups: str) -> DataFrame:
    """(groups, id, degree, triangles) of undirected edges (groups, a, b), a < b.

    Every edge points to its end with more neighbours, so a hub opens no wedges: the wedges
    of a vertex stay below the square root of twice the number of edges, squared.
    """
    degree = pairs.select(*groups, F.explode(F.array("a", "b")).alias("id")).groupBy(*groups, "id").agg(F.count("*").alias("degree"))
    ends = [degree.withColumnsRenamed({"id": end, "degree": f"d{end}"}) for end in ("a", "b")]
    known = pairs.join(ends[0], [*groups, "a"]).join(ends[1], [*groups, "b"])
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = known.select(*groups, F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = arcs.join(arcs.withColumnRenamed("y", "z"), [*groups, "x"]).where("y < z")
    closed = wedges.join(pairs.withColumnsRenamed({"a": "y", "b": "z"}), [*groups, "y", "z"], "left_semi")
    found = closed.select(*groups, F.explode(F.array("x", "y", "z")).alias("id")).groupBy(*groups, "id").agg(F.count("*").alias("triangles"))
    return degree.join(found, [*groups, "id"], "left").na.fill(0, ["triangles"])


def local_clustering(degree: Column, triangles: Column) -> Column:
    wedge = degree * (degree - 1)
    return F.when(wedge > 0, 2 * triangles / F.when(wedge > 0, wedge)).otherwise(0.0)


def clustering(simple: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering) of the undirected simple projection; vertices with only self-loops come out with 0."""
    out = vertices(simple).join(corners(undirected(simple)), "id", "left").na.fill(0, ["degree", "triangles"])
    return out.withColumn("clustering", local_clustering(F.col("degree"), F.col("triangles")))


def reference_day(edges: DataFrame) -> Column:
    return edges.agg(F.max("day")).scalar()


def aged(edges: DataFrame, reference: Column | None = None) -> DataFrame:
    """edges with age in days before the reference day, the latest day by default."""
    return edges.withColumn("age", F.datediff(reference_day(edges) if reference is None else reference, "day"))


def bursts(edges: DataFrame, reference: Column | None = None) -> DataFrame:
    """(src, n_window, n_total, multiplier): senders with more than ``BURST_MORE_THAN`` edges of at most ``BURST_DAYS`` days of age."""
    counts = aged(edges, reference).groupBy("src").agg(F.count_if(F.col("age") <= BURST_DAYS).alias("n_window"), F.count("*").alias("n_total"))
    return counts.where(F.col("n_window") > BURST_MORE_THAN).withColumn("multiplier", 1 + F.col("n_window") / F.col("n_total"))


def temporal_edges(edges: DataFrame, half_life: float, reference: Column | None = None, log_amount: bool = False, burst: bool = True) -> DataFrame:
    """(src, dst, weight, original): amounts decayed by age, raised by the sender's burst, parallel edges added up."""
    old = aged(edges, reference)
    amount = F.log1p("amount") if log_amount else F.col("amount")
    weight = amount * F.exp(-F.lit(DECAY / half_life) * F.greatest(F.col("age"), F.lit(0)))
    if burst:
        old = old.join(bursts(edges, reference).select("src", "multiplier"), "src", "left")
        weight = weight * F.coalesce("multiplier", F.lit(1.0))
    return old.withColumn("_w", weight).groupBy("src", "dst").agg(F.sum("_w").alias("weight"), F.sum("amount").alias("original"))


def incident(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge once for each of its ends (a self-loop twice) as (id, *columns)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), *columns)


def decay_impact(temporal: DataFrame) -> DataFrame:
    """(id, decay_impact): 1 minus the incident temporal over the incident original weight; 0 without weight."""
    sums = incident(temporal, "weight", "original").groupBy("id").agg(F.sum("weight").alias("w"), F.sum("original").alias("o"))
    return sums.select("id", F.when(F.col("o") > 0, 1 - F.col("w") / F.when(F.col("o") > 0, F.col("o"))).otherwise(0.0).alias("decay_impact"))


def dormant(edges: DataFrame, days: int = DORMANT_DAYS, reference: Column | None = None) -> DataFrame:
    """(id, min_age): vertices whose every edge is older than ``days``."""
    return incident(aged(edges, reference), "age").groupBy("id").agg(F.min("age").alias("min_age")).where(F.col("min_age") > days)


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges with an end among the seeds (id), each once."""
    hit = seeds.select("id").distinct().withColumn("_x", F.lit(True))
    out = edges.join(hit.withColumnsRenamed({"id": "src", "_x": "_s"}), "src", "left").join(hit.withColumnsRenamed({"id": "dst", "_x": "_d"}), "dst", "left")
    return out.where("_s OR _d").drop("_s", "_d").select(*edges.columns)


def two_hop(simple: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id): every vertex within two steps in any direction, the seed included; a seed that is no vertex gives nothing."""
    near = simple.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(simple.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    start = seeds.select(F.col("id").alias("seed")).distinct().join(near.select(F.col("a").alias("seed")).distinct(), "seed", "left_semi").withColumn("id", F.col("seed"))
    first = start.join(near, start["id"] == near["a"]).select("seed", F.col("b").alias("id")).distinct()
    second = first.join(near, first["id"] == near["a"]).select("seed", F.col("b").alias("id"))
    return start.unionByName(first).unionByName(second).distinct()


def ego_to_three(simple: DataFrame) -> DataFrame:
    """(id, ego_nodes): the vertices within two steps in any direction, the vertex included, counted up to three.

    A second neighbour makes three, as does an only neighbour that has others; what is left
    are pairs that know only each other (2) and vertices without a neighbour (1).
    """
    pairs = undirected(simple)
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    near = pairs.select(F.explode(ends).alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.count("*").alias("n"), F.min("e.other").alias("other"))
    single = near.where("n = 1").select("id", "other")
    closed = single.join(single.select(F.col("other").alias("id"), F.col("id").alias("other")), ["id", "other"], "left_semi").select("id", F.lit(2).alias("two"))
    out = vertices(simple).join(near.select("id", "n"), "id", "left").join(closed, "id", "left")
    return out.select("id", F.when(F.col("n").isNull(), 1).otherwise(F.coalesce("two", F.lit(3))).alias("ego_nodes"))


def induced(simple: DataFrame, members: DataFrame) -> DataFrame:
    """(seed, src, dst, *): for each seed the edges with both ends among its members (seed, id)."""
    one = simple.join(members.select("seed", F.col("id").alias("src")), "src")
    return one.join(members.select("seed", F.col("id").alias("dst")), ["seed", "dst"], "left_semi")


def topology(simple: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per seed the shape of its two-hop network: n_nodes, n_edges, edge_density, diameter, avg_clustering, degree_asymmetry, component_ratio.

    Ego networks are connected, so component_ratio is 1; with fewer than three vertices
    clustering and asymmetry are 0. The tasks cut the networks out of the graph held as
    arrays, so that no row of a network is kept or moved; in a graph too large for that
    the networks are rows.
    """
    whole = held.hold(simple)
    whole = whole and whole.with_triangles()
    out = _shapes(simple, seeds) if whole is None else held.per_seed(whole.with_neighbours(), seeds, held.shape, held.SHAPE)
    n, big = F.col("n_nodes"), F.col("n_nodes") >= 3
    return out.select(
        "seed", "n_nodes", "n_edges", F.when(n > 1, F.col("n_edges") / F.when(n > 1, n * (n - 1))).otherwise(0.0).alias("edge_density"), "diameter",
        F.when(big, F.col("clustering")).otherwise(0.0).alias("avg_clustering"), F.when(big, F.col("asymmetry")).otherwise(0.0).alias("degree_asymmetry"), F.lit(1.0).alias("component_ratio"),
    )


def _shapes(simple: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, n_nodes, n_edges, asymmetry, clustering, diameter) from rows (seed, member) and the edges among them."""
    members = materialise(two_hop(simple, seeds))
    inside = materialise(induced(simple, members))
    size = members.groupBy("seed").agg(F.count("*").alias("n_nodes"))
    n_edges = inside.groupBy("seed").agg(F.count("*").alias("n_edges"))
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    per = inside.select("seed", F.explode(ends).alias("e")).groupBy("seed", "e.id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    per = members.join(per, ["seed", "id"], "left").na.fill(0, ["i", "o"])
    spread = per.groupBy("seed").agg((F.var_pop("i") / F.greatest(F.var_pop("o"), F.lit(1e-10))).alias("asymmetry"))
    pairs = materialise(inside.where("src <> dst").select("seed", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    local = members.join(corners(pairs, "seed"), ["seed", "id"], "left").na.fill(0, ["degree", "triangles"])
    mean = local.groupBy("seed").agg(F.avg(local_clustering(F.col("degree"), F.col("triangles"))).alias("clustering"))
    return size.join(n_edges, "seed", "left").join(spread, "seed", "left").join(mean, "seed", "left").join(diameters(pairs), "seed", "left").na.fill(0, ["n_edges", "diameter"])


def diameters(pairs: DataFrame, batch: int = 8) -> DataFrame:
    """(seed, diameter) of undirected two-hop networks (seed, a, b) around their seeds, exact.

    No vertex is more than two steps from its seed, so the diameter is at most four, and
    between vertices next to the seed at most two: only vertices two steps away can widen
    it. Their reach is searched in growing batches, those with few neighbours first, and a
    network is done when one of them has some vertex four steps away or all are searched.
    """
    near = materialise(pairs.select("seed", "a", "b").unionByName(pairs.select("seed", F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = near.groupBy("seed", "a").agg(F.count("*").alias("d"))
    total = degree.groupBy("seed").agg(F.count("*").alias("v"), F.sum("d").alias("e"))
    first = near.where("a = seed").select("seed", F.col("b").alias("a"))
    far = degree.where("a <> seed").join(first, ["seed", "a"], "left_anti")
    order = W.partitionBy("seed").orderBy("d", "a")
    far = materialise(far.withColumn("place", F.row_number().over(order)).select("seed", "a", "place"))
    bound = materialise(total.join(far.groupBy("seed").agg(F.count("*").alias("f")), "seed", "left").na.fill(0, ["f"]).withColumn("k", F.when(F.col("e") == F.col("v") * (F.col("v") - 1), 1).otherwise(2)))
    done = 0
    while bound.where(f"k < 4 AND f > {done}").limit(1).count():
        live = bound.where("k < 4").select("seed")
        sources = far.where(f"place > {done} AND place <= {done + batch}").join(live, "seed", "left_semi").select("seed", F.col("a").alias("o"))
        reach = sources.withColumn("a", F.col("o"))
        counts = []
        for step in range(3):
            wider = reach.join(near, ["seed", "a"]).select("seed", "o", F.col("b").alias("a"))
            reach = reach.unionByName(wider).distinct()
            if step:
                reach = materialise(reach)
                counts.append(reach.groupBy("seed", "o").agg(F.count("*").alias(f"n{step}")))
        each = counts[0].join(counts[1], ["seed", "o"]).join(total, "seed")
        ecc = each.groupBy("seed").agg(F.max(F.when(F.col("n1") == F.col("v"), 2).when(F.col("n2") == F.col("v"), 3).otherwise(4)).alias("_k"))
        bound = materialise(bound.join(ecc, "seed", "left").withColumn("k", F.greatest("k", F.coalesce("_k", "k"))).drop("_k"))
        done, batch = done + batch, batch * 4
    return bound.select("seed", F.col("k").alias("diameter"))


def recent_share(edges: DataFrame, members: DataFrame, days: int = 7, reference: Column | None = None) -> DataFrame:
    """(seed, velocity_ratio): of the edges inside a seed's network the share of at most ``days`` of age, 0 without edges."""
    inside = induced(aged(edges, reference), members)
    return inside.groupBy("seed").agg(F.avg((F.col("age") <= days).cast("double")).alias("velocity_ratio"))


def recent_within_two(edges: DataFrame, seeds: DataFrame, days: int = 7, reference: Column | None = None) -> DataFrame:
    """``recent_share`` of the seeds' two-hop networks, from the counts of each pair's rows in the graph held as arrays; in rows where the graph is too large for that."""
    counts = aged(edges, reference).groupBy("src", "dst").agg(F.count("age").alias("n"), F.count_if(F.col("age") <= days).alias("recent"))
    whole = held.hold(materialise(counts), "n", "recent")
    if whole is None:
        return recent_share(edges, two_hop(last_edges(edges), seeds), days, reference)
    return held.per_seed(whole.with_neighbours(), seeds, held.recent, "velocity_ratio double")


def qcut(df: DataFrame, columns: list[str], bins: int, key: str) -> DataFrame:
    """Each column's equal-frequency bin 0..bins-1 by rank, ties by key, as <column>_bin. NULL counts as 0.

    Ranks come from sorted splits with counted offsets, not from one task's window.
    """
    out = df
    for c in columns:
        out = in_order(out.withColumn("_v", F.coalesce(c, F.lit(0)).cast("double")), "_v", key)
        bin_ = F.greatest(F.expr(f"((_rank - 1) * {bins} + _n - 2) div greatest(_n - 1, 1) - 1"), F.lit(0))
        out = out.withColumn(f"{c}_bin", F.when(F.col("_n") > 1, bin_).otherwise(0).cast("int")).drop("_v", "_rank", "_n")
    return out
