"""Small networks, choices among paths, and typed vertices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import network, neural, paths


def fixed_layers(sizes, last="sigmoid", seed=0):
    g = np.random.default_rng(seed)
    return neural.Layers(tuple((g.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])), last)


def test_layers_match_numpy(spark):
    net = fixed_layers((2, 4, 3), "softmax", 3)
    data = [(0.5, -1.0), (None, 2.0), (float("nan"), 0.0)]
    got = spark.createDataFrame(data, "a double, b double").select(neural.apply_layers(net, F.col("a"), F.col("b")).alias("y")).collect()
    want = net(np.array([[0.5, -1.0], [0.0, 2.0], [0.0, 0.0]]))
    assert np.allclose([r["y"] for r in got], want) and np.allclose(want.sum(axis=1), 1)
    p = spark.createDataFrame(data, "a double, b double").select(neural.group_penalty(fixed_layers((2, 4, 1)), F.col("a"), F.col("b")).alias("p")).collect()
    assert all(0.1 <= r["p"] <= 1 for r in p)


def test_paths(spark):
    table = spark.createDataFrame([("all", ["a", "b"], 0.8), ("some", ["a"], 0.7), ("weak", [], 0.5)], "path_id string, required array<string>, precision double")
    now = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "k int, healthy array<string>")
    options = paths.available(table, now, "k")
    assert {r["k"]: r["path_id"] for r in paths.best_path(options, 0.6, "k").collect()} == {1: "all", 2: "some", 3: "halt"}
    better = paths.recalibrated(table, spark.createDataFrame([("some", 0.9), ("all", 0.82)], "path_id string, precision double")).collect()
    assert [(r["path_id"], r["changed"], r["place"]) for r in sorted(better, key=lambda r: r["place"])] == [("some", True, 1), ("all", False, 2), ("weak", False, 3)]
    row = paths.evidence(table).first()
    assert (row["n_paths"], row["min_precision"], row["all_reach"]) == (3, 0.5, False)


def test_typed_network(spark):
    acc = spark.createDataFrame([(1, "h", 0), (2, "h", 1), (3, None, 1)], "account_id bigint, name string, pep int")
    holders = network.holder_table(acc, "name", "pep")
    assert [tuple(r) for r in holders.collect()] == [("h", 1)]
    tx = spark.createDataFrame([(1, 2), (1, 9), (None, 1)], "s bigint, r bigint")
    parts = network.heterogeneous(tx, acc, holders, "name")
    assert {k: v.count() for k, v in parts.items()} == {"account": 3, "holder": 1, "transacts": 1, "owns": 2}


@pytest.mark.parametrize("n", [0, 2])
def test_node_features_of_few(spark, n):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)][:n], "src bigint, dst bigint, amount double")
    got = {r["id"]: (r["in_degree"], r["out_degree"], r["n_edges"]) for r in network.node_features(df).collect()}
    assert got == ({1: (1, 2, 3), 2: (1, 0, 1)} if n else {})
