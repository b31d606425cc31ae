"""Networks are fitted: judged on rows they have not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import neural


def rows(spark, n, seed):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 2)) * [3, 0.1] + [5, -1]
    y = ((x[:, 0] > 5) & (x[:, 1] > -1)).astype(int)
    good, bad = y + g.normal(0, 0.05, n), g.uniform(0, 1, n)
    flip = x[:, 0] > 5  # the first score is right on one side, the second on the other
    a, b = np.where(flip, good, bad), np.where(flip, bad, good)
    data = [(i, float(x[i, 0]), float(x[i, 1]), float(a[i]), float(b[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame([*data, (n, None, float("nan"), None, None, None)], "id bigint, u double, v double, a double, b double, y int")


def test_penalty_tells_labelled_rows_apart(spark):
    net = neural.fit_penalty(rows(spark, 1500, 1), ["u", "v"], "y")
    got = rows(spark, 500, 2).where("y IS NOT NULL").select("y", neural.group_penalty(net, F.col("u"), F.col("v")).alias("p")).collect()
    assert all(0.1 <= r["p"] <= 1 for r in got)
    assert np.mean([(r["p"] < 0.55) == (r["y"] == 1) for r in got]) > 0.95


def test_weights_follow_the_score_that_is_right(spark):
    net = neural.fit_weights(rows(spark, 1500, 3), ["u", "v"], ["a", "b"], "y")
    w = neural.apply_layers(net, F.col("u"), F.col("v"))
    got = rows(spark, 500, 4).where("abs(u - 5) > 1").select("u", w.alias("w")).collect()
    assert all(sum(r["w"]) == pytest.approx(1) for r in got)
    assert np.mean([(r["w"][0] > 0.5) == (r["u"] > 5) for r in got]) > 0.95


def test_slopes_of_layers_are_those_of_the_loss():
    """One step of the fit goes down, and the folded first layer gives the same outputs."""
    g = np.random.default_rng(5)
    x, y = g.normal(size=(50, 3)) * 7 + 2, g.uniform(size=(50, 1))
    loss = lambda net: ((net(x) - y) ** 2).mean()
    slope = lambda out: 2 * (out - y) / len(y)
    losses = [loss(neural.fit_layers(x, slope, (3, 8, 1), "sigmoid", steps=n)) for n in (1, 20, 200)]
    assert losses[0] > losses[1] > losses[2]
