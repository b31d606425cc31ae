"""p2 against brute force."""

import random
from collections import defaultdict

from ledgerlens.llm.top_items import top_items

SCHEMA = "Sender_account bigint, row_index bigint, tx_score double, _salt int, rank string"


def test_against_brute_force(spark):
    rnd = random.Random(2)
    data = []
    for i in range(1500):
        row = (rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([i, i, None]), rnd.choice([0.5, 0.5, 0.9, 0.1, None, float("nan"), -0.0, 0.0]), 7, "x")
        data += [row] * rnd.choice([1, 1, 2])
    want = defaultdict(set)
    for s, i, x, *_ in data:
        if s is not None and i is not None and x is not None and x == x:
            want[s].add((-x, i))
    best = {(s, i, -x, k + 1) for s, v in want.items() for k, (x, i) in enumerate(sorted(v)[:5])}
    for salts in (1, 4):
        got = top_items(spark.createDataFrame(data, SCHEMA).repartition(5), "Sender_account", "row_index", "tx_score", 5, salts).collect()
        assert {tuple(r) for r in got} == best and len(got) == len(best)


def test_nothing(spark):
    assert top_items(spark.createDataFrame([], SCHEMA), "Sender_account", "row_index", "tx_score", 5).collect() == []
