"""Models are fitted on all rows, and thresholds of trees come from all of them."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import flow, learned
from ledgerlens.plans import study_queries


class Stop(Exception):
    pass


def test_three_rows_of_many_make_a_threshold(spark):
    df = spark.range(120_000).select(
        F.col("id").alias("row_index"), (F.col("id") % 40_000 == 7).cast("int").alias("x"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("y"), (F.col("id") % 40_000 == 7).cast("int").alias("label")
    )
    model = learned.fit_trees(df, ["x", "y"], trees=2, depth=1)
    assert dict(learned.importances(model, ["x", "y"])) == {"x": 1.0, "y": 0.0}
    linear = learned.fit_linear(df, ["x", "y"])
    assert linear.stages[-1].summary.totalIterations > 0 and linear.stages[-1].summary.predictions.count() == 120_000


def test_bins_are_those_of_all_values(spark):
    rnd = random.Random(5)
    columns = {
        "wide": [rnd.lognormvariate(3, 4) * rnd.choice((-1, 1)) for _ in range(5000)], "near": [1e9 + rnd.random() for _ in range(5000)], "steep": [float(int(rnd.paretovariate(0.7))) for _ in range(5000)],
        "few": [float(rnd.choice((0, 0, 0, 1, 1e9, 1e9 + 1))) for _ in range(4999)] + [-0.0], "one": [2.0] * 5000, "rare": [0.0] * 4999 + [1.0], "huge": [float("inf")] + [1e300 * rnd.random() for _ in range(4999)],
    }

    def plain(values, bins=32):
        different, n = sorted(set(values)), len(values)
        if len(different) <= bins:
            return different[1:]
        out, below, last = [], 0, None
        for v in different:
            at = below * bins // n
            if last is not None and at > last:
                out.append(v)
            last, below = at, below + values.count(v)
        return out

    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    got = learned.bin_starts(df, list(columns))
    assert got == [plain(v) for v in columns.values()]
    assert got == learned.bin_starts(df.repartition(7, "wide"), list(columns))


def test_pipeline_fits_on_every_training_row(spark, monkeypatch, tmp_path):
    folder = "/root/testdata/sf0.001"
    seen = []

    def fit(rows, names, **k):
        seen.append(rows.select("row_index").distinct().count())
        raise Stop

    monkeypatch.setattr(learned, "sample", lambda rows, *a, **k: rows.limit(1))
    monkeypatch.setattr(learned, "fit_trees", fit)
    monkeypatch.setattr(flow, "graph_features", lambda e, *a: e.select(F.col("src").alias("account_id")).distinct().withColumn("gf_a", F.col("account_id") % 3))
    with pytest.raises(Stop):
        study_queries.risk_pipeline(spark, folder)
    split = study_queries.features.temporal_split(study_queries.transactions(spark, folder))
    assert seen == [split.where("split = 'train'").count()]
