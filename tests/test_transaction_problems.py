"""p1, p4 and p5 against brute force, with dirt in every column."""

import datetime
import math
import random
from collections import defaultdict

import pytest
from conftest import rows

from ledgerlens.operators import dense_totals, entity_features, rolling
from ledgerlens.sources.tables import distinct_transactions, valid_date

SCHEMA = "row_index bigint, Date string, Sender_account bigint, Receiver_account bigint, amount_local_npr double, tx_code string, tx_score double, side string, block int, day string, key string"
NAN = float("nan")


def made(n=400, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = rnd.choice([1, 1, 1, 2, 3, 4, None, -7, 10**15])
        r = rnd.choice([9, 9, 9, 1, 5, None])
        d = rnd.choice(["2025-01-%02d" % rnd.randint(1, 28), "%d/%d/2025" % (rnd.randint(1, 28), rnd.randint(1, 4)), "31/04/2025", "", None, "n.a."])
        code = rnd.choice(["A", " a ", "B", "b", None, " ", "C"])
        row = (i, d, s, r, rnd.choice([1.5, 2.25, -3.0, 0.0, None, NAN]), code, rnd.choice([0.1, 0.5, 1.0, None, NAN, 2.0, -1.0]), "x", 3, "y", "z")
        out += [row] * rnd.choice([1, 1, 1, 3])
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def data():
    return made()


def day_of(text):
    for f in ("%Y-%m-%d", "%d/%m/%Y"):
        try:
            return datetime.datetime.strptime(text or "", f).date()
        except ValueError:
            pass
    return None


def once(data):
    return list({r[0]: r for r in data}.values())


def tx(spark, data, *columns):
    return distinct_transactions(spark.createDataFrame(data, SCHEMA).repartition(3), *columns)


def test_dates(spark):
    good = [("2025-1-5", "2025-01-05"), ("05/1/2025", "2025-01-05"), ("2024-02-29", "2024-02-29")]
    bad = ["2025-02-29", "31/04/2025", "2025-13-05", "0000-00-00", "pending", "", None, " 2025-01-01", "2025-01-01x", "1/1/25"]
    df = spark.createDataFrame([(a,) for a, _ in good] + [(b,) for b in bad], "t string")
    got = {r[0]: r[1] for r in df.select("t", valid_date("t").cast("string")).collect()}
    assert got == dict(good) | dict.fromkeys(bad)


def test_dense_totals(spark, data):
    sides = {"sender": "Sender_account", "receiver": "Receiver_account"}
    got = dense_totals.dense_key_totals(tx(spark, data, "Sender_account", "Receiver_account", "amount_local_npr", "side", "block", "key"), sides, "amount_local_npr", fan=2)
    want = defaultdict(lambda: [0, 0.0])
    for r in once(data):
        for side, k in (("sender", r[2]), ("receiver", r[3])):
            want[side, k][0] += 1
            want[side, k][1] += 0 if r[4] is None or math.isnan(r[4]) else r[4]
    assert {(r[0], r[1]): [r[2], round(r[3], 6)] for r in got.collect()} == {k: [a, round(b, 6)] for k, (a, b) in want.items()}
    heavy = {(r[0], r[1]) for r in dense_totals.heavy_keys(got, 0.2).collect()}
    n = len(once(data))
    assert heavy == {k for k, (a, _) in want.items() if a >= 0.2 * n and k[1] is not None}


def test_reduction_groups_stay_bounded(spark, monkeypatch):
    """Many splits of many keys: a group of the reduction holds at most about FAN blocks of BLOCK_KEYS slots, NULL and string keys included."""
    monkeypatch.setattr(dense_totals, "BLOCK_KEYS", 64)
    summed = dense_totals._sum_blocks

    def watched(schema):
        run = summed(schema)

        def inner(group):
            import pyarrow.compute as pc

            slots = sum(pc.list_value_length(group.column("keys")).to_pylist())
            if slots > 4 * 4 * 64:
                raise AssertionError(f"{slots} slots in a group")
            return run(group)

        return inner

    monkeypatch.setattr(dense_totals, "_sum_blocks", watched)
    df = spark.range(0, 200_000, 1, 40).selectExpr("IF(id % 3 = 0, 7, id % 60000) AS k", "1.0D AS v", "IF(id % 1000 = 0, NULL, concat('k', id % 5)) AS s", "id AS _value")
    got = dense_totals.dense_key_totals(df, {"a": "k"}, "v", fan=4)
    want = {r[0]: (r[1], r[2]) for r in df.groupBy("k").agg({"v": "count", "*": "count"}).selectExpr("k", "`count(1)`", "double(`count(v)`)").collect()}
    assert {r["key"]: (r["n_rows"], r["total"]) for r in got.collect()} == want
    words = {r["key"]: r["n_rows"] for r in dense_totals.dense_key_totals(df, {"a": "s"}, fan=4).collect()}
    assert words == {r[0]: r[1] for r in df.groupBy("s").count().collect()}


def test_dictionaries_beyond_the_bound_are_given_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dense_totals, "MOST_HELD", 10)
    df = spark.range(0, 3000, 1, 2).selectExpr("id % 100 AS k")
    assert {(r["key"], r["n_rows"]) for r in dense_totals.dense_key_totals(df, {"a": "k"}).collect()} == {(i, 30) for i in range(100)}


def test_dense_totals_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = dense_totals.dense_key_totals(empty, {"sender": "Sender_account"})
    assert got.collect() == [] and dense_totals.heavy_keys(got, 0.03).collect() == []


def brute_types(data):
    out = defaultdict(lambda: [0, None, 0.0])
    for r in once(data):
        d, c = day_of(r[1]), (r[5] or "").strip().upper()
        if d and c:
            for role, a in (("sender", r[2]), ("receiver", r[3])):
                if a is not None:
                    x = out[a, role, c]
                    x[0] += 1
                    x[1] = max(x[1] or d, d)
                    x[2] += r[6] if r[6] is not None and 0 <= r[6] <= 1 else 0
    return out


def test_entity_features(spark, data):
    events = entity_features.role_events(tx(spark, data, "Date", "Sender_account", "Receiver_account", "tx_code", "tx_score", "side"))
    want = brute_types(data)
    got = {tuple(r[:3]): [r[3], r[4], round(r[5], 6)] for r in entity_features.entity_type_stats(events, 3).collect()}
    assert got == {k: [a, b, round(c, 6)] for k, (a, b, c) in want.items()}
    best = {}
    for (a, role, c), (n, d, _) in want.items():
        best.setdefault((a, role), []).append((-n, -d.toordinal(), c))
    codes = entity_features.event_types(spark.createDataFrame(data, SCHEMA).withColumn("day", valid_date("Date")))
    assert codes == ["A", "B", "C"]
    small = entity_features.feature_table(events, codes, 3, ("n", "last"))
    assert {(r[0], r[1]): r[2] for r in entity_features.most_frequent_type(small).collect()} == {k: min(v)[2] for k, v in best.items()}
    with pytest.raises(Exception, match="not in the list of types"):
        entity_features.feature_table(events, ["A", "C"]).collect()
    table = entity_features.feature_table(events, codes).collect()
    assert {r["account_id"] for r in table} == {k[0] for k in want}
    for r in table:
        assert list(r["tx_codes"]) == ["A", "B", "C"]
        for i, c in enumerate("ABC"):
            x = want.get((r["account_id"], "sender", c), [0, None, 0.0])
            assert (r["sender_n"][i], r["sender_last"][i], round(r["sender_score"][i], 6)) == (x[0], x[1], round(x[2], 6))


def test_entity_features_of_nothing(spark):
    events = entity_features.role_events(distinct_transactions(spark.createDataFrame([], SCHEMA), "Date", "Sender_account", "Receiver_account", "tx_code", "tx_score"))
    assert entity_features.event_types(spark.createDataFrame([], SCHEMA).withColumn("day", valid_date("Date"))) == []
    for codes in ([], ["A"]):
        table = entity_features.feature_table(events, codes)
        assert table.collect() == [] and entity_features.most_frequent_type(table).collect() == []


def brute_rolling(data):
    days = defaultdict(lambda: defaultdict(lambda: [0.0, 0]))
    for r in once(data):
        d = day_of(r[1])
        if d and r[2] is not None:
            x = days[r[2]][d.toordinal() - 719163]
            x[0] += 0 if r[4] is None or math.isnan(r[4]) else r[4]
            x[1] += 1
    out = {}
    for s, by in days.items():
        for d in range(min(by), max(by) + 1):
            out[s, d] = [(sum(by[x][0] for x in range(d - k + 1, d + 1) if x in by), sum(by[x][1] for x in range(d - k + 1, d + 1) if x in by)) for k in (7, 30)]
    return out


def check_rolling(trees, want):
    got = {(r[0], r[1].toordinal() - 719163): r for r in rolling.rolling_totals(trees).collect()}
    assert got.keys() == want.keys()
    for k, ((t7, n7), (t30, n30)) in want.items():
        r = got[k]
        assert (r["n_7"], r["n_30"]) == (n7, n30)
        assert r["total_7"] == pytest.approx(t7) and r["total_30"] == pytest.approx(t30) and r["avg_7"] == pytest.approx(t7 / 7) and r["avg_30"] == pytest.approx(t30 / 30)
    peaks = {(r[0], r[2]): r[1].toordinal() - 719163 for r in rolling.peaks_and_lapses(trees).collect()}
    for s in {k[0] for k in want}:
        own = sorted((d, v) for (a, d), v in want.items() if a == s)
        top = max(round(v[1][0], 2) for _, v in own)
        assert peaks[s, "peak_30"] == next(d for d, v in own if round(v[1][0], 2) == top)
        assert peaks.get((s, "lapse_7")) == next((d for d, v in own if not v[0][1]), None)


def test_rolling(spark, data):
    days = rolling.daily(tx(spark, data, "Date", "Sender_account", "amount_local_npr"))
    check_rolling(rolling.segment_trees(days), brute_rolling(data))


def wide():
    """Senders with gaps of several shards, totals below zero, days before 1970, one day only."""
    rnd = random.Random(8)
    dates = [datetime.date(1969, 12, 1) + datetime.timedelta(days=rnd.choice([rnd.randint(0, 90), rnd.randint(0, 900)])) for _ in range(60)]
    out = [(i, str(d), rnd.choice([1, 2, 3, 4]), None, rnd.choice([-5.0, -2.0, 1.0, 3.0]), "A", 0.5, "x", 3, "y", "z") for i, d in enumerate(dates)]
    return out + [(900, "2024-01-01", 9, None, -4.0, "A", 0.5, "x", 3, "y", "z"), (901, "2024-01-01", 10, None, -4.0, "A", 0.5, "x", 3, "y", "z"), (902, "2025-06-01", 10, None, -4.0, "A", 0.5, "x", 3, "y", "z")]


def test_rolling_over_gaps(spark):
    data = wide()
    check_rolling(rolling.segment_trees(rolling.daily(tx(spark, data, "Date", "Sender_account", "amount_local_npr"))), brute_rolling(data))


def test_rolling_of_nothing(spark):
    days = rolling.daily(distinct_transactions(spark.createDataFrame([], SCHEMA), "Date", "Sender_account", "amount_local_npr"))
    trees = rolling.segment_trees(days)
    assert trees.collect() == [] and rolling.rolling_totals(trees).collect() == [] and rolling.peaks_and_lapses(trees).collect() == []
    assert rolling.correct(trees, days).collect() == [] and rolling.touched_blocks(trees, trees, days).collect() == []


def nodes_of(trees):
    return {(r["entity"], r["shard"]): dict(zip(r["nodes"], zip(r["sums"], r["counts"]))) for r in trees.collect()}


def test_late_corrections_change_only_ancestors(spark, data):
    days = rolling.daily(tx(spark, data, "Date", "Sender_account", "amount_local_npr"))
    trees = rolling.segment_trees(days).cache()
    old = nodes_of(trees)
    (entity, shard), some = next(iter(sorted(old.items())))
    changes = spark.createDataFrame([(entity, shard * rolling.SHARD + 5, 10.0, 1), (77, 3, 4.0, 2)], "entity bigint, day int, total double, n bigint")
    new = nodes_of(rolling.correct(trees, changes))
    path = {(5 + rolling.SHARD) >> i for i in range(7)}
    for i in range(1, 2 * rolling.SHARD):
        a, b = some.get(i, (0, 0)), new[entity, shard].get(i, (0, 0))
        assert b[0] == pytest.approx(a[0] + (10 if i in path else 0)) and b[1] == a[1] + (1 if i in path else 0)
    assert new[77, 0][1] == (4.0, 2)
    assert {k: v for k, v in new.items() if k not in ((entity, shard), (77, 0))} == {k: v for k, v in old.items() if k != (entity, shard)}


def test_answers_after_kept_trees_are_corrected(spark, tmp_path):
    """Late rows, rows taken away again, senders that appear, vanish, or whose span grows or shrinks."""
    data = wide()
    rnd = random.Random(9)
    out = [r for r in data if rnd.random() < 0.2]
    late = [(2000 + i, str(datetime.date(1968, 1, 1) + datetime.timedelta(days=rnd.randint(0, 2500))), rnd.choice([1, 2, 77]), None, 2.0, "A", 0.5, "x", 3, "y", "z") for i in range(8)]
    gone = [r for r in data if r[2] == 9] + out
    gone = list({r[0]: r for r in gone}.values())
    days = rolling.daily(tx(spark, data, "Date", "Sender_account", "amount_local_npr"))
    plus = rolling.daily(tx(spark, late, "Date", "Sender_account", "amount_local_npr"))
    minus = rolling.daily(tx(spark, gone, "Date", "Sender_account", "amount_local_npr")).selectExpr("entity", "day", "-total AS total", "-n AS n")
    changes = plus.unionByName(minus).cache()
    before = rolling.segment_trees(days).cache()
    folder = str(tmp_path / "trees")
    rolling.keep_trees(before, folder)
    rolling.correct_kept(spark, folder, changes)
    after = rolling.kept_trees(spark, folder)
    want = brute_rolling([r for r in data if r not in gone] + late)
    check_rolling(after, want)
    touched = rolling.touched_blocks(before, after, changes).cache()
    both = rolling.rolling_totals(before, without=touched).unionByName(rolling.rolling_totals(after, only=touched))
    got = [(r["entity"], r["day"].toordinal() - 719163, r["n_7"], r["n_30"], round(r["total_30"], 6)) for r in both.collect()]
    assert sorted(got) == sorted((s, d, v[0][1], v[1][1], round(v[1][0], 6)) for (s, d), v in want.items())


def test_sparse_entities_take_no_memory_by_their_span():
    """Answers of blocks ten years apart, as one Arrow stream in one process."""
    import tracemalloc

    import numpy as np

    assert rolling.query_nodes(30).shape == (rolling.SHARD, rolling.query_nodes(30).shape[1]) and rolling.query_nodes(30).max() < 4 * rolling.SHARD
    tracemalloc.start()
    nodes = np.zeros((rolling.BLOCKS_AT_ONCE, 4 * rolling.SHARD))
    for _ in range(3):
        rolling.range_sums(nodes, rolling.query_nodes(30))
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("k", [1, 2, 7, 30, 63, 64])
def test_query_nodes(k):
    import numpy as np

    rnd = np.random.default_rng(k)
    leaves = rnd.integers(0, 9, 2 * rolling.SHARD)
    trees = np.zeros((1, 4 * rolling.SHARD), dtype=np.int64)
    for side, part in ((0, leaves[rolling.SHARD :]), (1, leaves[: rolling.SHARD])):
        own = np.zeros((1, 2 * rolling.SHARD), dtype=np.int64)
        rolling.climb(own, np.zeros(rolling.SHARD, dtype=int), np.arange(rolling.SHARD), part)
        own[0, 0] = 0
        trees[:, side * 2 * rolling.SHARD : (side + 1) * 2 * rolling.SHARD] = own
    got = rolling.range_sums(trees, rolling.query_nodes(k))[0]
    assert got.tolist() == [leaves[rolling.SHARD + i - k + 1 : rolling.SHARD + i + 1].sum() for i in range(rolling.SHARD)]
    with pytest.raises(ValueError):
        rolling.query_nodes(rolling.SHARD + 1)


def test_rows_without_index_are_no_transactions(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 2)], "row_index bigint, Sender_account bigint")
    assert rows(distinct_transactions(df, "Sender_account")) == [(1, 2)]
