"""Shares of recent rows in two-hop networks come without rows of members, and are those of the rows."""

import random
from datetime import date

from ledgerlens.operators import graph, held
from ledgerlens.plans import study_queries


def unused(*_):
    raise AssertionError("rows (seed, member) are made")


def test_recent_share_without_rows_of_members(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(50), rng.randrange(50) // rng.randint(1, 6), 1.0, date(2025, 1, rng.randint(1, 28)), str(i)) for i in range(150)] + [(100, 101, 1.0, date(2025, 1, 1), ""), (102, 102, 1.0, date(2025, 1, 28), "")]
    data = spark.createDataFrame(rows, "src bigint, dst bigint, amount double, day date, at string")
    seeds = spark.createDataFrame([(i,) for i in (0, 1, 9, 17, 100, 102, 999)], "id bigint")
    want = {r[0]: r[1] for r in graph.recent_share(data, graph.two_hop(graph.last_edges(data), seeds)).collect()}
    with monkeypatch.context() as m:
        m.setattr(graph, "two_hop", unused)
        m.setattr(study_queries, "edges", lambda *_: data)
        assert {r[0]: r[1] for r in graph.recent_within_two(data, seeds).collect()} == want
        assert {r[0] for r in study_queries.recent_ego_share(spark, "").collect()} == {0, 100}
    monkeypatch.setattr(held, "MOST_ARCS", 1)
    assert {r[0]: r[1] for r in graph.recent_within_two(data, seeds).collect()} == want and want[100] == 0 and want[102] == 1
