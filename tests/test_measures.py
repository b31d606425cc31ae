"""Bootstrap of any metric, column fallback, shadow evaluation, combined report, files."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import drift, metrics, paths
from ledgerlens.plans.study_queries import report
from ledgerlens.session import table_folder
from ledgerlens.sources import files


def scored(spark, n=60, seed=1):
    rnd = random.Random(seed)
    data = [(i, rnd.choice([0.1, 0.5, 0.9, round(rnd.random(), 3)]), rnd.randint(0, 1)) for i in range(n)]
    return data, spark.createDataFrame(data + [(n, None, 1)], "row_index bigint, score double, label int")


@pytest.mark.parametrize("k", [1, 5, 50])
def test_bootstrap_against_resamples_of_all_rows(spark, k):
    data, df = scored(spark)
    grain = float(1 << 40)
    u = df.where("score IS NOT NULL").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(40)))).select("row_index", "b", ((F.pmod(F.xxhash64("row_index", "b", F.lit(42)), F.lit(1 << 40)) + 0.5) / grain).alias("u"))
    weights = defaultdict(dict)
    for r in u.collect():
        w, total, p = 0, math.exp(-1), math.exp(-1)
        while r["u"] >= total:
            w += 1
            p /= w
            total += p
        weights[r["b"]][r["row_index"]] = w
    ranked = sorted(data, key=lambda x: (-x[1], x[0]))
    for metric, gain in ((metrics.precision_of_sample, lambda place: 1 / k), (metrics.dcg_of_sample, lambda place: 1 / math.log2(place + 1))):
        values = []
        for b in weights:
            drawn = [label for i, _, label in ranked for _ in range(weights[b][i])][:k]
            values.append(sum(gain(place + 1) for place, label in enumerate(drawn) if label))
        got = metrics.bootstrap(df, k, metric, replicates=40).first()
        assert got["mean"] == pytest.approx(sum(values) / len(values)) and got["low"] <= got["mean"] <= got["high"]


def test_bootstrap_of_nothing(spark):
    got = metrics.bootstrap(scored(spark)[1].limit(0), 5, replicates=3).first()
    assert got["mean"] is None


def test_columns_fall_back(spark):
    df = spark.createDataFrame([(1, 0.5, 0.7, 1)], "row_index int, ml_score double, risk_score double, is_suspicious_tx int")
    assert metrics.truth_and_score(df).select("label", "score").first() == (1, 0.7)
    with pytest.raises(ValueError):
        metrics.truth_and_score(df.select("row_index", "ml_score"))


def test_shadow_evaluation_of_few_rows_and_shifted_scores(spark):
    rows = [(i, "many", i / 300, int(i > 280)) for i in range(300)] + [(1000 + i, "few", 0.5, 1) for i in range(199)] + [(2000 + i, "high", 0.99, 0) for i in range(250)] + [(9000, None, 0.5, 1)]
    df = spark.createDataFrame(rows, "row_index int, g string, score double, label int")
    even = spark.createDataFrame([(b, 1 / 20) for b in range(20)], "bin int, p double")
    got = {r["g"]: r for r in drift.shadow_evaluation(df, even, "g", "row_index").collect()}
    assert set(got) == {"many", "few", "high"} and got["few"]["precision"] is None and got["few"]["escalate"] is None
    assert got["many"]["precision"] == pytest.approx(19 / 50) and got["many"]["escalate"] and not got["many"]["moves_reference"] and got["many"]["kl"] < 0.01
    assert got["high"]["kl"] > 2 and got["high"]["budget"] == 0.63


def test_report_names_what_is_missing(spark):
    with pytest.raises(RuntimeError, match="ranks"):
        report({"fusion": spark.range(1)}, ("fusion", "ranks"))


def test_evidence_of_no_path(spark):
    got = paths.evidence(spark.createDataFrame([], "path_id string, precision double")).first()
    assert (got["n_paths"], got["min_precision"], got["budget"]) == (0, 0.0, 0.60)


def test_texts_survive_csv_and_xml(spark):
    texts = ['a "quoted", comma', " outer blanks ", "<tag> & more", "naïve – ü", None]
    df = spark.createDataFrame([(f"R{i}", f"NP{i}", i, t) for i, t in enumerate(texts)], files.REPORT_SCHEMA)
    path = table_folder(spark, "t") + ".csv"
    files.write(df, path)
    assert sorted(r["reason"] or "" for r in files.read(spark, "", path, df.schema).collect()) == sorted(t or "" for t in texts)
    folder = table_folder(spark, "x")
    files.write_reports(df, folder)
    assert sorted(map(str, files.read_reports(spark, folder).collect())) == sorted(str(r) for r in df.withColumn("reason", F.trim("reason")).collect())
    assert files.edges_or_demo(spark, table_folder(spark, "none") + ".csv", "2025-01-31").where("is_mock").count() == 14
