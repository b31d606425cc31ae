"""Queries over the transfer graph, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import flow
from ledgerlens.operators import graph as g
from ledgerlens.session import materialise
from ledgerlens.sources.views import EDGE_SQL, edges

HALF_LIFE, RANK_ROUNDS, HITS_ROUNDS, SOURCES, SEED_STEP = 7.0, 10, 8, 500, 100


def _r(*columns, digits=6):
    return [F.round(c, digits).alias(c) for c in columns]


def edge_accumulate(spark, folder):
    return g.summed_edges(edges(spark, folder)).select("src", "dst", "n_edges", *_r("amount", digits=2))


def edge_dedup_last(spark, folder):
    return g.last_edges(edges(spark, folder))


def temporal_edge_weights(spark, folder):
    return g.temporal_edges(edges(spark, folder), HALF_LIFE).select("src", "dst", *_r("weight", digits=4), *_r("original", digits=2))


def degrees(spark, folder):
    return g.degrees(g.last_edges(edges(spark, folder))).select("id", "in_degree", "out_degree", *_r("weighted_in", "weighted_out", digits=2))


def reciprocity_ratios(spark, folder):
    return g.reciprocity(g.last_edges(edges(spark, folder))).select("id", "mutual", *_r("reciprocity", "degree_ratio", "flow_ratio"))


def clustering(spark, folder):
    return g.clustering(g.last_edges(edges(spark, folder))).select("id", "degree", "triangles", *_r("clustering"))


def burst_log(spark, folder):
    return g.bursts(edges(spark, folder)).select("src", "n_window", "n_total", *_r("multiplier"))


def dormant_nodes(spark, folder):
    return g.dormant(edges(spark, folder))


def decay_impact(spark, folder):
    return g.decay_impact(g.temporal_edges(edges(spark, folder), HALF_LIFE)).select("id", *_r("decay_impact"))


def scc_members(spark, folder):
    return flow.strong_components(edges(spark, folder)).select("id", "scc", "size", (F.col("size") > 1).cast("int").alias("in_cycle"), (F.col("size") > 2).alias("cycle_member"))


def scc_flow(spark, folder):
    e = edges(spark, folder)
    groups = flow.closed_groups(g.temporal_edges(e, HALF_LIFE), flow.strong_components(e))
    return groups.select("id", "scc_size", "intra_degree", *_r("intra_in", "intra_out", digits=3), *_r("flow_ratio", "intra_share"))


def pagerank(spark, folder, rounds=None):
    """Until the ranks settle; the fixed form is what SQL can replay, as with the next two."""
    simple = g.last_edges(edges(spark, folder)).withColumnRenamed("amount", "weight")
    return flow.pagerank(materialise(simple), rounds=rounds).select("id", *_r("rank", digits=9))


def pagerank_fixed(spark, folder):
    return pagerank(spark, folder, RANK_ROUNDS)


def td_pagerank(spark, folder, rounds=None):
    out = flow.td_pagerank(materialise(edges(spark, folder)), HALF_LIFE, rounds=rounds)
    return out.select("id", *_r("raw", "score", digits=9), *_r("normalised"), "cycle_member", "dormant")


def td_pagerank_fixed(spark, folder):
    return td_pagerank(spark, folder, RANK_ROUNDS)


def hits(spark, folder, rounds=None):
    return flow.hits(g.last_edges(edges(spark, folder)), rounds).select("id", *_r("hub", "authority", digits=9))


def hits_fixed(spark, folder):
    return hits(spark, folder, HITS_ROUNDS)


def betweenness(spark, folder):
    return flow.betweenness(materialise(g.last_edges(edges(spark, folder))), SOURCES).select("id", *_r("betweenness"))


def _seeds(simple):
    return g.vertices(simple).where(F.col("id") % SEED_STEP == 0)  # the stated query set


def ego_one_hop(spark, folder):
    simple = g.last_edges(edges(spark, folder))
    return g.one_hop(simple, _seeds(simple))


def ego_two_hop(spark, folder):
    simple = materialise(g.last_edges(edges(spark, folder)))
    return g.two_hop(simple, _seeds(simple)).groupBy("seed").agg(F.count("*").alias("n_nodes"))


def topology_counts(spark, folder):
    simple = materialise(g.last_edges(edges(spark, folder)))
    out = g.topology(simple, _seeds(simple))
    return out.select("seed", "n_nodes", "n_edges", "diameter", *_r("edge_density", "avg_clustering", "degree_asymmetry", "component_ratio"))


def decile_bins(spark, folder):
    d = g.reciprocity(g.last_edges(edges(spark, folder)))
    out = g.qcut(materialise(d), ["in_degree", "weighted_out"], 10, "id")
    return g.qcut(materialise(out), ["reciprocity"], 5, "id").select("id", "in_degree_bin", "weighted_out_bin", "reciprocity_bin")


QUERIES = {x.__name__: x for x in (
    edge_accumulate, edge_dedup_last, temporal_edge_weights, degrees, reciprocity_ratios, clustering, burst_log, dormant_nodes, decay_impact,
    scc_members, scc_flow, pagerank, pagerank_fixed, td_pagerank, td_pagerank_fixed, hits, hits_fixed, betweenness, ego_one_hop, ego_two_hop, topology_counts, decile_bins,
)}

SIMPLE_SQL = "g AS (SELECT src, dst, arg_max(amount, row(moment, amount)) AS amount FROM e GROUP BY 1, 2), v AS (SELECT DISTINCT unnest([src, dst]) AS id FROM g)"
DEGREE_SQL = """deg AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, sum(wi) AS weighted_in, sum(wo) AS weighted_out FROM (
  SELECT src AS id, 0 AS i, 1 AS o, 0e0 AS wi, amount AS wo FROM g UNION ALL SELECT dst, 1, 0, amount, 0e0 FROM g) GROUP BY 1)"""
MUTUAL_SQL = "mu AS (SELECT src AS id, count(*) AS mutual FROM g x WHERE EXISTS (SELECT 1 FROM g y WHERE y.src = x.dst AND y.dst = x.src) GROUP BY 1)"
AGED_SQL = "ag AS (SELECT *, date_diff('day', day, (SELECT max(day) FROM e)) AS age FROM e), bu AS (SELECT src, count(*) FILTER (age <= 3) AS n_window, count(*) AS n_total, 1 + count(*) FILTER (age <= 3) / count(*) AS multiplier FROM ag GROUP BY 1 HAVING count(*) FILTER (age <= 3) > 5)"
TEMPORAL_SQL = f"{AGED_SQL}, te AS (SELECT ag.src, dst, sum(amount * exp(-0.693e0 / {HALF_LIFE}e0 * greatest(age, 0)) * coalesce(multiplier, 1)) AS weight, sum(amount) AS original FROM ag LEFT JOIN bu USING (src) GROUP BY 1, 2)"


def _ranks(source: str, rounds: int, name: str) -> str:
    parts = [f"tot AS (SELECT src, sum(weight) AS t FROM {source} GROUP BY 1 HAVING sum(weight) > 0), mv AS (SELECT s.src, dst, weight / t AS p FROM {source} s JOIN tot USING (src) WHERE weight > 0)",
             f"nn AS (SELECT DISTINCT unnest([src, dst]) AS id FROM {source}), r0 AS (SELECT id, id NOT IN (SELECT src FROM tot) AS dangling, 1.0e0 / (SELECT count(*) FROM nn) AS rank FROM nn)"]
    for i in range(rounds):
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT r.id, r.dangling, 0.15e0 / (SELECT count(*) FROM nn) + 0.85e0 * (coalesce(q.x, 0) + coalesce((SELECT sum(rank) FROM r{i} WHERE dangling), 0) / (SELECT count(*) FROM nn)) AS rank
FROM r{i} r LEFT JOIN (SELECT dst AS id, sum(rank * p) AS x FROM mv JOIN r{i} z ON z.id = mv.src GROUP BY 1) q ON q.id = r.id)""")
    return ", ".join(parts) + f", {name} AS (SELECT id, rank FROM r{rounds})"


def _hits(rounds: int) -> str:
    parts = ["h0 AS (SELECT id, 1.0e0 AS hub FROM v)"]
    for i in range(rounds):
        parts.append(f"a{i + 1} AS MATERIALIZED (SELECT dst AS id, sum(hub) / sum(sum(hub)) OVER () AS authority FROM g JOIN h{i} ON h{i}.id = g.src GROUP BY 1)")
        parts.append(f"h{i + 1} AS MATERIALIZED (SELECT src AS id, sum(authority) / sum(sum(authority)) OVER () AS hub FROM g JOIN a{i + 1} ON a{i + 1}.id = g.dst GROUP BY 1)")
    return ", ".join(parts)


# Reachability as a transitive closure: right on the small oracle inputs, not meant to scale.
SCC_SQL = """reach AS (SELECT src AS a, dst AS b FROM pairs UNION SELECT reach.a, pairs.dst FROM reach JOIN pairs ON pairs.src = reach.b),
scc AS (SELECT v.id, least(v.id, coalesce(min(y.b), v.id)) AS scc FROM v LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach z ON z.a = x.b AND z.b = x.a) y ON y.a = v.id GROUP BY v.id),
sized AS (SELECT id, scc, count(*) OVER (PARTITION BY scc) AS size FROM scc)"""
_QC = lambda c, q: f"CAST(greatest(((row_number() OVER (ORDER BY {c}, id) - 1) * {q} + count(*) OVER () - 2) // (count(*) OVER () - 1) - 1, 0) AS INTEGER)"

GROUP_SQL = f"""lab AS (SELECT id, scc, size FROM sized WHERE size >= 3), ins AS (SELECT te.* FROM te JOIN lab a ON a.id = src JOIN lab b ON b.id = dst WHERE a.scc = b.scc),
io AS (SELECT src AS id, weight AS o, 0e0 AS i FROM ins UNION ALL SELECT dst, 0e0, weight FROM ins), tw AS (SELECT id, sum(weight) AS t FROM (SELECT src AS id, weight FROM te UNION ALL SELECT dst, weight FROM te) GROUP BY 1),
gr AS (SELECT lab.id, size AS scc_size, count(o) AS intra_degree, coalesce(sum(i), 0) AS intra_in, coalesce(sum(o), 0) AS intra_out, any_value(t) AS t FROM lab LEFT JOIN io USING (id) LEFT JOIN tw USING (id) GROUP BY 1, 2)"""
_SCC = f"WITH RECURSIVE {EDGE_SQL}, pairs AS (SELECT DISTINCT src, dst FROM e), v AS (SELECT DISTINCT unnest([src, dst]) AS id FROM e), {SCC_SQL}"

ORACLES = {
    "scc_members": f"{_SCC} SELECT id, scc, size, CAST(size > 1 AS INTEGER) AS in_cycle, size > 2 AS cycle_member FROM sized",
    "scc_flow": f"""{_SCC}, {TEMPORAL_SQL}, {GROUP_SQL} SELECT id, scc_size, intra_degree, round(intra_in, 3) AS intra_in, round(intra_out, 3) AS intra_out,
  round(CASE WHEN intra_in + intra_out > 0 THEN intra_in / (intra_in + intra_out) ELSE 0.5 END, 6) AS flow_ratio, round(CASE WHEN t > 0 THEN (intra_in + intra_out) / t ELSE 0.0 END, 6) AS intra_share FROM gr""",
    "td_pagerank_fixed": f"""{_SCC}, {TEMPORAL_SQL}, w AS (SELECT src, dst, weight FROM te), {_ranks('w', RANK_ROUNDS, 'pr')}, {GROUP_SQL},
dm AS (SELECT id FROM (SELECT src AS id, age FROM ag UNION ALL SELECT dst, age FROM ag) GROUP BY 1 HAVING min(age) > 30),
pe AS (SELECT pr.id, rank AS raw, rank * CASE WHEN gr.t > 0 AND (intra_in + intra_out) / gr.t > 0.8 THEN 0.5 ELSE 1 END AS p, size > 2 AS cycle_member, pr.id IN (SELECT id FROM dm) AS dormant FROM pr JOIN sized USING (id) LEFT JOIN gr ON gr.id = pr.id),
sc AS (SELECT *, CASE WHEN dormant THEN least(p, 0.1 * (SELECT max(p) FROM pe)) ELSE p END AS score FROM pe)
SELECT id, round(raw, 9) AS raw, round(score, 9) AS score, round((score - (SELECT min(score) FROM sc)) / (SELECT max(score) - min(score) FROM sc), 6) AS normalised, cycle_member, dormant FROM sc""",
    "edge_accumulate": f"WITH {EDGE_SQL} SELECT src, dst, count(*) AS n_edges, round(sum(amount), 2) AS amount FROM e GROUP BY 1, 2",
    "edge_dedup_last": f"WITH {EDGE_SQL}, {SIMPLE_SQL} SELECT * FROM g",
    "temporal_edge_weights": f"WITH {EDGE_SQL}, {TEMPORAL_SQL} SELECT src, dst, round(weight, 4) AS weight, round(original, 2) AS original FROM te",
    "degrees": f"WITH {EDGE_SQL}, {SIMPLE_SQL}, {DEGREE_SQL} SELECT id, in_degree, out_degree, round(weighted_in, 2) AS weighted_in, round(weighted_out, 2) AS weighted_out FROM deg",
    "reciprocity_ratios": f"""WITH {EDGE_SQL}, {SIMPLE_SQL}, {DEGREE_SQL}, {MUTUAL_SQL} SELECT id, coalesce(mutual, 0) AS mutual, round(coalesce(mutual, 0) / (in_degree + out_degree - coalesce(mutual, 0)), 6) AS reciprocity,
  round(in_degree / (in_degree + out_degree), 6) AS degree_ratio, round(CASE WHEN weighted_in + weighted_out <> 0 THEN weighted_in / (weighted_in + weighted_out) ELSE 0.5 END, 6) AS flow_ratio FROM deg LEFT JOIN mu USING (id)""",
    "clustering": f"""WITH {EDGE_SQL}, {SIMPLE_SQL}, u AS (SELECT DISTINCT src AS a, dst AS b FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst),
d AS (SELECT a AS id, count(*) AS degree FROM u GROUP BY 1), t AS (SELECT x.a AS id, count(*) // 2 AS triangles FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = y.b AND z.b = x.a GROUP BY 1)
SELECT v.id, coalesce(degree, 0) AS degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS clustering FROM v LEFT JOIN d USING (id) LEFT JOIN t USING (id)""",
    "burst_log": f"WITH {EDGE_SQL}, {AGED_SQL} SELECT src, n_window, n_total, round(multiplier, 6) AS multiplier FROM bu",
    "dormant_nodes": f"WITH {EDGE_SQL}, {AGED_SQL} SELECT id, CAST(min(age) AS INTEGER) AS min_age FROM (SELECT src AS id, age FROM ag UNION ALL SELECT dst, age FROM ag) GROUP BY 1 HAVING min(age) > 30",
    "decay_impact": f"WITH {EDGE_SQL}, {TEMPORAL_SQL} SELECT id, round(CASE WHEN sum(original) > 0 THEN 1 - sum(weight) / sum(original) ELSE 0.0 END, 6) AS decay_impact FROM (SELECT src AS id, weight, original FROM te UNION ALL SELECT dst, weight, original FROM te) GROUP BY 1",
    "pagerank_fixed": f"WITH {EDGE_SQL}, {SIMPLE_SQL}, w AS (SELECT src, dst, amount AS weight FROM g), {_ranks('w', RANK_ROUNDS, 'pr')} SELECT id, round(rank, 9) AS rank FROM pr",
    "hits_fixed": f"WITH {EDGE_SQL}, {SIMPLE_SQL}, {_hits(HITS_ROUNDS)} SELECT v.id, round(coalesce(hub, 0.0), 9) AS hub, round(coalesce(authority, 0.0), 9) AS authority FROM v LEFT JOIN h{HITS_ROUNDS} h USING (id) LEFT JOIN a{HITS_ROUNDS} a USING (id)",
    "ego_one_hop": f"WITH {EDGE_SQL}, {SIMPLE_SQL} SELECT src, dst, amount FROM g WHERE src % {SEED_STEP} = 0 OR dst % {SEED_STEP} = 0",
    "ego_two_hop": f"""WITH {EDGE_SQL}, {SIMPLE_SQL}, u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), s AS (SELECT id AS seed FROM v WHERE id % {SEED_STEP} = 0),
n AS (SELECT seed, seed AS id FROM s UNION SELECT seed, b FROM s JOIN u ON a = seed UNION SELECT seed, y.b FROM s JOIN u x ON x.a = seed JOIN u y ON y.a = x.b) SELECT seed, count(*) AS n_nodes FROM n GROUP BY 1""",
    "decile_bins": f"""WITH {EDGE_SQL}, {SIMPLE_SQL}, {DEGREE_SQL}, {MUTUAL_SQL}, x AS (SELECT id, in_degree, weighted_out, coalesce(mutual, 0) / (in_degree + out_degree - coalesce(mutual, 0)) AS reciprocity FROM deg LEFT JOIN mu USING (id))
SELECT id, {_QC('in_degree', 10)} AS in_degree_bin, {_QC('weighted_out', 10)} AS weighted_out_bin, {_QC('reciprocity', 5)} AS reciprocity_bin FROM x""",
}
