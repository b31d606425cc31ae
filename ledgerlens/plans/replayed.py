"""Fixed-round forms of queries that go on until values settle, and SQL that replays step by step what other queries fold."""

from __future__ import annotations

from ledgerlens.plans import study_queries
from ledgerlens.plans.feature_queries import VELOCITY_SQL
from ledgerlens.plans.graph_queries import DEGREE_SQL, RANK_ROUNDS, SIMPLE_SQL, _ranks
from ledgerlens.plans.graph_queries import ORACLES as graph_oracles
from ledgerlens.plans.measure_queries import ARRIVED_SQL, _MONTHS, states_sql
from ledgerlens.plans.report_queries import _ENT
from ledgerlens.plans.risk_queries import K, TX_RULES, _points
from ledgerlens.sources.views import EDGE_SQL, TX_SQL


def adaptive_fusion_fixed(spark, folder):
    return study_queries.adaptive_fusion(spark, folder, RANK_ROUNDS)


def fusion_gain_fixed(spark, folder):
    return study_queries.fusion_gain(spark, folder, RANK_ROUNDS)


QUERIES = {x.__name__: x for x in (adaptive_fusion_fixed, fusion_gain_fixed)}

# Weights of every vertex: raised by isolation, six times clamped and brought to 1, with the floor of small networks.
_WEIGHTS = f"""{EDGE_SQL}, {SIMPLE_SQL}, {DEGREE_SQL}, un AS (SELECT DISTINCT src AS a, dst AS b FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst),
nb AS (SELECT a AS id, count(*) AS n, min(b) AS other FROM un GROUP BY 1),
eg AS (SELECT v.id, CASE WHEN n IS NULL THEN 1 WHEN n > 1 THEN 3 WHEN (SELECT m.n FROM nb m WHERE m.id = nb.other) = 1 THEN 2 ELSE 3 END AS ego FROM v LEFT JOIN nb USING (id)),
w0 AS (SELECT id, ml, (1 - ml) * 0.6e0 AS gr, (1 - ml) * 0.4e0 AS ru FROM (SELECT id, least(greatest(0.5e0 + 0.4e0 / (1 + in_degree + out_degree), 0.05e0), 0.9e0) AS ml FROM deg))""" + "".join(
    f""", w{i + 1} AS (SELECT id, ml / (ml + gr + ru) AS ml, gr / (ml + gr + ru) AS gr, ru / (ml + gr + ru) AS ru
FROM (SELECT id, least(greatest(ml, 0.05e0), 0.9e0) AS ml, least(greatest(gr, 0.05e0), 0.9e0) AS gr, least(greatest(ru, 0.05e0), 0.9e0) AS ru FROM w{i}))""" for i in range(6)
) + """, fl AS (SELECT *, 0.30e0 * gr / (gr + ru) AS g1, 0.30e0 * ru / (gr + ru) AS r1, ego < 3 AND ml < 0.70e0 AS small FROM w6 JOIN eg USING (id)),
ww AS (SELECT id, CASE WHEN small THEN 0.70e0 ELSE ml END AS w_ml, CASE WHEN NOT small THEN gr WHEN ov THEN 0.15e0 ELSE greatest(g1, 0.05e0) END AS w_graph, CASE WHEN NOT small THEN ru WHEN ov THEN 0.15e0 ELSE greatest(r1, 0.05e0) END AS w_rules
FROM (SELECT *, (g1 < 0.05e0 OR r1 < 0.05e0) AND greatest(g1, 0.05e0) + greatest(r1, 0.05e0) > 0.30e0 AS ov FROM fl))"""
_FUSED = f"""{TX_SQL}, {VELOCITY_SQL}, {_WEIGHTS}, pw AS (SELECT src, dst, amount AS weight FROM g), {_ranks('pw', RANK_ROUNDS, 'pr')},
pl AS (SELECT id, (rank - (SELECT min(rank) FROM pr)) / (SELECT max(rank) - min(rank) FROM pr) AS place FROM pr), vx AS (SELECT * FROM ww JOIN pl USING (id)), pt AS (SELECT *, {_points(TX_RULES, 'points')} FROM vel),
ff AS (SELECT row_index, label, score, least(greatest(coalesce(w_ml, 0.70e0) * coalesce(score, 0e0) + coalesce(w_graph, 0.15e0) * coalesce(place, 0e0) + coalesce(w_rules, 0.15e0) * 0.25e0 * (1 - exp(-points / 50)), 0), 1) AS fused FROM pt LEFT JOIN vx ON vx.id = s)"""

# Each path's months one after another: the divergence from the reference, the budget, and whether the month moves the reference.
_EVALUATED = f"""{_MONTHS}, me AS (SELECT path_id, seq, avg(label) AS precision FROM fm GROUP BY 1, 2),
mh AS (SELECT me.*, h, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS i FROM me JOIN (SELECT path_id, seq, list(p ORDER BY bin) AS h FROM hm GROUP BY 1, 2) USING (path_id, seq)),
ev AS (SELECT path_id, CAST(0 AS BIGINT) AS i, CAST(0 AS INTEGER) AS seq, 0e0 AS precision, 0e0 AS kl, 0e0 AS mean_10, 0e0 AS budget, CAST(NULL AS DOUBLE[]) AS ref, CAST([] AS DOUBLE[]) AS seen FROM (SELECT DISTINCT path_id FROM mh)
UNION ALL SELECT path_id, i, seq, precision, kl, mean_10, budget, CASE WHEN precision < budget - 0.05 THEN ref WHEN ref IS NULL THEN h ELSE [x / list_sum(y) FOR x IN y] END, seen
FROM (SELECT *, round(least(CASE WHEN mean_10 > 0.70 THEN 0.65e0 WHEN mean_10 < 0.65 THEN 0.58e0 ELSE 0.60e0 END + CASE WHEN kl > 0.10 THEN 0.03e0 ELSE 0e0 END, 0.75e0), 4) AS budget, [0.9e0 * ref[j] + 0.1e0 * h[j] FOR j IN range(1, 21)] AS y
 FROM (SELECT *, list_avg(seen) AS mean_10 FROM (SELECT mh.path_id, mh.i, mh.seq, mh.precision, mh.h, ev.ref, list_append(ev.seen, mh.precision)[-10:] AS seen,
  coalesce(list_sum([mh.h[j] * ln(mh.h[j] / ev.ref[j]) FOR j IN range(1, 21)]), 0e0) AS kl FROM ev JOIN mh ON mh.path_id = ev.path_id AND mh.i = ev.i + 1))))"""
_WEEKLY = """wk AS (SELECT path_id, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS week, score, label, row_number() OVER (PARTITION BY path_id ORDER BY ts, account_id NULLS FIRST, score, label) AS pos FROM fb),
we AS (SELECT path_id, week, max(pos) AS last FROM wk GROUP BY 1, 2), wp AS (SELECT path_id, week, CASE WHEN count(*) >= 200 THEN avg(label) FILTER (rk <= 50) END AS precision
 FROM (SELECT we.path_id, we.week, wk.label, row_number() OVER (PARTITION BY we.path_id, we.week ORDER BY wk.score DESC, wk.pos) AS rk FROM we JOIN wk ON wk.path_id = we.path_id AND wk.pos <= last AND wk.pos > last - 500) GROUP BY 1, 2),
wi AS (SELECT path_id, precision AS p, row_number() OVER (PARTITION BY path_id ORDER BY week) AS i, count(*) OVER (PARTITION BY path_id) AS n FROM wp WHERE precision IS NOT NULL),
ad AS (SELECT path_id, CAST(0 AS BIGINT) AS i, 0e0 AS adj, 0 AS high, 0 AS near FROM (SELECT DISTINCT path_id FROM me)
UNION ALL SELECT path_id, i, CASE WHEN near >= 3 THEN greatest(up - 0.02e0, -0.05e0) ELSE up END, high, near FROM (SELECT *, CASE WHEN high >= 5 THEN least(adj + 0.05e0, 0.15e0) ELSE adj END AS up
 FROM (SELECT ad.path_id, wi.i, ad.adj, CASE WHEN p > 0.70e0 THEN ad.high + 1 ELSE 0 END AS high, CASE WHEN abs(p - 0.60e0) <= 0.05e0 THEN ad.near + 1 ELSE 0 END AS near FROM ad JOIN wi ON wi.path_id = ad.path_id AND wi.i = ad.i + 1)))"""

_EVERY = "list_concat(list_concat(accounts, amounts), dates)"
_PARTS = "[trim(x) FOR x IN str_split(coalesce(reason, ''), '.') IF trim(x) <> '']"


def _summary(sentences: int) -> str:
    return f"""{_ENT}, pa AS (SELECT *, {_PARTS} AS parts, {_EVERY} AS every FROM en),
su AS (SELECT *, array_to_string([x.s FOR x IN list_sort([{{'n': -len([e FOR e IN every IF contains(lower(s), lower(e))]), 'i': i, 's': s}} FOR s, i IN parts])[1:{sentences}]], '. ') || '.' AS summary FROM pa)"""


def _values(x: str) -> str:
    clean = "replace(regexp_replace(upper(trim(a)), '(NPR|USD|EUR|GBP|\\$|€|£)\\s*', '', 'g'), ',', '')"
    head = "left(t, length(t) - 1)"
    return f"""[CASE right(t, 1) WHEN 'K' THEN try_cast({head} AS DOUBLE) * 1e3 WHEN 'M' THEN try_cast({head} AS DOUBLE) * 1e6 WHEN 'B' THEN try_cast({head} AS DOUBLE) * 1e9 ELSE try_cast(t AS DOUBLE) END FOR t IN [{clean} FOR a IN {x}]]"""


_YEAR = "CASE WHEN regexp_matches(d, '\\d{4}-\\d{2}-\\d{2}') THEN CAST(CAST(left(d, 4) AS INTEGER) AS VARCHAR) WHEN regexp_matches(d, '/') THEN CAST(CAST(split_part(d, '/', 3) AS INTEGER) AS VARCHAR) END"
_DAY = "CASE WHEN regexp_matches(d, '\\d{4}-\\d{2}-\\d{2}') THEN CAST(CAST(substr(d, 9, 2) AS INTEGER) AS VARCHAR) WHEN regexp_matches(d, '/') THEN CAST(CAST(split_part(d, '/', 1) AS INTEGER) AS VARCHAR) END"
_KEPT = f"""{_summary(1)}, nu AS (SELECT *, lower(summary) AS low, {_values("regexp_extract_all(summary, '[\\d,]+\\.?\\d*[KMBkmb]?')")} AS numbers, {_values('amounts')} AS worth FROM su),
ke AS (SELECT *, len([a FOR a, i IN amounts IF contains(low, lower(a)) OR coalesce(len([x FOR x IN numbers IF x IS NOT NULL AND abs(x - worth[i]) / greatest(worth[i], 1) < 0.01]) > 0, false)]) AS ka,
 len([a FOR a IN accounts IF contains(low, lower(a))]) AS kc, len([d FOR d IN dates IF contains(low, lower(d)) OR coalesce(contains(summary, {_YEAR}) AND contains(summary, {_DAY}), false)]) AS kd FROM nu),
fa AS (SELECT str_id, CASE WHEN 3e0 * len(amounts) + 2e0 * len(accounts) + 1.5e0 * len(dates) > 0 THEN (3e0 * ka + 2e0 * kc + 1.5e0 * kd) / (3e0 * len(amounts) + 2e0 * len(accounts) + 1.5e0 * len(dates)) * 100 ELSE 100 END AS f FROM ke)"""

# Two-hop networks of the stated seeds: members, edges inside, neighbours inside, and how far vertices are apart.
_EGO = f"""{EDGE_SQL}, {SIMPLE_SQL}, u2 AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), sd AS (SELECT id AS seed FROM v WHERE id % 100 = 0),
mb AS (SELECT seed, seed AS id FROM sd UNION SELECT seed, b FROM sd JOIN u2 ON a = seed UNION SELECT seed, y.b FROM sd JOIN u2 x ON x.a = seed JOIN u2 y ON y.a = x.b)"""
_SHAPE = f"""{_EGO}, ie AS (SELECT p.seed, g.src, g.dst FROM mb p JOIN g ON g.src = p.id JOIN mb q ON q.seed = p.seed AND q.id = g.dst), iu AS (SELECT DISTINCT seed, src AS a, dst AS b FROM ie WHERE src <> dst UNION SELECT seed, dst, src FROM ie WHERE src <> dst),
sz AS (SELECT seed, count(*) AS n FROM mb GROUP BY 1), ne AS (SELECT seed, count(*) AS m FROM ie GROUP BY 1),
io AS (SELECT mb.seed, mb.id, count(i.src) AS i, coalesce(any_value(o), 0) AS o FROM mb LEFT JOIN ie i ON i.seed = mb.seed AND i.dst = mb.id LEFT JOIN (SELECT seed, src, count(*) AS o FROM ie GROUP BY 1, 2) o ON o.seed = mb.seed AND o.src = mb.id GROUP BY 1, 2),
sp AS (SELECT seed, var_pop(i) / greatest(var_pop(o), 1e-10) AS asym FROM io GROUP BY 1),
dg AS (SELECT seed, a AS id, count(*) AS d FROM iu GROUP BY 1, 2), tr AS (SELECT x.seed, x.a AS id, count(*) // 2 AS t FROM iu x JOIN iu y ON y.seed = x.seed AND y.a = x.b JOIN iu z ON z.seed = x.seed AND z.a = y.b AND z.b = x.a GROUP BY 1, 2),
lc AS (SELECT mb.seed, avg(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END) AS c FROM mb LEFT JOIN dg USING (seed, id) LEFT JOIN tr USING (seed, id) GROUP BY 1),
r1 AS (SELECT seed, a, b FROM iu UNION SELECT seed, id, id FROM mb), r2 AS (SELECT DISTINCT x.seed, x.a, y.b FROM r1 x JOIN r1 y ON y.seed = x.seed AND y.a = x.b),
c1 AS (SELECT seed, a, count(*) AS k1 FROM r1 GROUP BY 1, 2), c2 AS (SELECT seed, a, count(*) AS k2 FROM r2 GROUP BY 1, 2),
c3 AS (SELECT seed, a, count(DISTINCT b) AS k3 FROM (SELECT x.seed, x.a, y.b FROM r2 x JOIN c2 USING (seed, a) JOIN sz USING (seed) JOIN r1 y ON y.seed = x.seed AND y.a = x.b WHERE k2 < n) GROUP BY 1, 2),
ec AS (SELECT seed, max(CASE WHEN n = 1 THEN 0 WHEN k1 = n THEN 1 WHEN k2 = n THEN 2 WHEN k3 = n THEN 3 ELSE 4 END) AS diameter FROM c1 JOIN c2 USING (seed, a) JOIN sz USING (seed) LEFT JOIN c3 USING (seed, a) GROUP BY 1)"""

ORACLES = {
    "feedback_in_order": f"WITH {ARRIVED_SQL} SELECT path_id, count(*) AS n, max(ts) AS newest FROM ki GROUP BY 1",
    "online_precision": f"""WITH {ARRIVED_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY score DESC, pos) AS rk FROM la)
SELECT path_id, count(*) AS n, CASE WHEN count(*) >= 200 THEN avg(label) FILTER (rk <= 50) END AS precision FROM rk GROUP BY 1""",
    "health_by_path": f"""WITH RECURSIVE {ARRIVED_SQL}, bo AS (SELECT path_id AS component, ts, (score >= 0.5) <> (label = 1) AS bad FROM ar), {states_sql('bo')}
SELECT component, count(*) FILTER (switched) AS n_switches, arg_max(state, i) AS state FROM st WHERE i > 0 GROUP BY 1""",
    "drift_budget": f"WITH RECURSIVE {_EVALUATED} SELECT path_id, CAST(seq AS BIGINT) AS seq, round(precision, 6) AS precision, round(kl, 6) AS kl, round(mean_10, 6) AS mean_10, budget FROM ev WHERE i > 0",
    "adjusted_budget": f"""WITH RECURSIVE {_EVALUATED}, {_WEEKLY}, lm AS (SELECT path_id, arg_max(kl, seq) AS kl, arg_max(mean_10, seq) AS shadow FROM ev WHERE i > 0 GROUP BY 1),
la AS (SELECT path_id, arg_max(adj, i) AS adj FROM ad GROUP BY 1), lw AS (SELECT path_id, avg(p) AS online FROM wi WHERE i > n - 10 GROUP BY 1)
SELECT path_id, round(greatest(least(adj + CASE WHEN kl > 0.10 THEN 0.03e0 ELSE 0e0 END + 0.60e0, 0.75e0), 0.55e0), 4) AS budget, round(coalesce(0.7e0 * online + 0.3e0 * shadow, online, shadow), 6) AS blended FROM lm JOIN la USING (path_id) LEFT JOIN lw USING (path_id)""",
    "adaptive_weights": f"WITH {_WEIGHTS} SELECT id, round(w_ml, 6) AS w_ml, round(w_graph, 6) AS w_graph, round(w_rules, 6) AS w_rules FROM ww",
    "adaptive_fusion_fixed": f"WITH {_FUSED} SELECT row_index, round(fused, 6) AS fused, round(2 * abs(coalesce(score, 0e0) - 0.5e0), 6) AS confidence FROM ff",
    "fusion_gain_fixed": f"""WITH {_FUSED}, kn AS (SELECT * FROM ff WHERE score IS NOT NULL), x AS (SELECT (SELECT sum(label) FROM (SELECT label FROM kn ORDER BY score DESC, row_index LIMIT {K})) / {K} AS b,
(SELECT sum(label) FROM (SELECT label FROM kn ORDER BY round(fused, 6) DESC, row_index LIMIT {K})) / {K} AS a)
SELECT 'precision' AS metric, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS gain, CASE WHEN b <> 0 THEN (a - b) / b >= 0.10 ELSE a > b END AS enough FROM x""",
    "extractive_summary": f"WITH {_summary(3)} SELECT str_id, summary FROM su",
    "faithfulness": f"WITH {_KEPT} SELECT str_id, round(f, 4) AS faithfulness, CASE WHEN f >= 90 THEN 'A' WHEN f >= 70 THEN 'B' WHEN f >= 50 THEN 'C' ELSE 'F' END AS grade, f >= 95 AS faithful FROM fa",
    "recent_ego_share": f"""WITH {_EGO}, ag AS (SELECT src, dst, date_diff('day', day, (SELECT max(day) FROM e)) AS age FROM e)
SELECT p.seed, round(avg(CASE WHEN age <= 7 THEN 1e0 ELSE 0e0 END), 6) AS velocity_ratio FROM mb p JOIN ag ON ag.src = p.id JOIN mb q ON q.seed = p.seed AND q.id = ag.dst GROUP BY 1""",
    "topology_counts": f"""WITH {_SHAPE} SELECT seed, n AS n_nodes, coalesce(m, 0) AS n_edges, CAST(diameter AS INTEGER) AS diameter, round(CASE WHEN n > 1 THEN coalesce(m, 0) / (n * (n - 1)) ELSE 0.0 END, 6) AS edge_density, round(CASE WHEN n >= 3 THEN c ELSE 0.0 END, 6) AS avg_clustering,
  round(CASE WHEN n >= 3 THEN asym ELSE 0.0 END, 6) AS degree_asymmetry, 1.0e0 AS component_ratio FROM sz LEFT JOIN ne USING (seed) JOIN sp USING (seed) JOIN lc USING (seed) JOIN ec USING (seed)""",
}

_TD = graph_oracles["td_pagerank_fixed"].rpartition("SELECT id, round(raw")[0]
ORACLES["graph_assertions"] = f"""{_TD} SELECT 'decay' AS name, count(*) FILTER (abs(w1 - w2) > 1e-9 * greatest(w2, 1)) AS broken FROM (SELECT amount * exp(-0.693e0 / 7e0 * greatest(age, 0)) AS w1, amount * pow(exp(-0.693e0 / 7e0), greatest(age, 0)) AS w2 FROM ag)
UNION ALL SELECT 'range', count(*) FILTER (score < 0 OR (score - (SELECT min(score) FROM sc)) / (SELECT max(score) - min(score) FROM sc) NOT BETWEEN 0 AND 1) FROM sc
UNION ALL SELECT 'dormancy', count(*) FILTER (dormant AND score > 0.1 * greatest((SELECT max(score) FROM sc WHERE NOT dormant), raw) + 1e-12) FROM sc
UNION ALL SELECT 'bursts', count(*) FILTER (multiplier <= 1 OR src NOT IN (SELECT id FROM v)) FROM bu"""
