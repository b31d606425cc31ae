"""Stateful operators, text functions, ordering helpers and files."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import drift, fusion, learned
from ledgerlens.operators.ordering import in_order, quantiles
from ledgerlens.sources.files import read, read_reports, reports_or_demo
from ledgerlens.streaming import feedback as fb
from ledgerlens.streaming.hysteresis import Health, health_states, move, step, stream_states, trigger, unhealthy


def feedback_rows(n=900, seed=3):
    rnd = random.Random(seed)
    at = datetime.datetime(2025, 1, 1)
    out = []
    for i in range(n):
        at += datetime.timedelta(seconds=rnd.choice([0, 1, 60, -30]))
        out.append((rnd.choice(["full", "full", "lgbm_only"]), at, rnd.choice([0.1, 0.5, 0.9, 0.9]), rnd.randint(0, 1), "f%d" % (i // 400), i % 400))
    return out


SCHEMA = "path_id string, ts timestamp, score double, label int, file string, row bigint"


def by_hand(data):
    newest, kept = {}, {}
    for r in sorted(data, key=lambda r: (r[4], r[5])):
        if r[0] not in newest or r[1] >= newest[r[0]]:
            newest[r[0]] = r[1]
            kept.setdefault(r[0], []).append(r)
    return kept


def test_feedback_batch(spark, monkeypatch):
    monkeypatch.setattr(fb, "SHARD", 50)
    data = feedback_rows()
    kept = by_hand(data)
    got = fb.kept_in_order(spark.createDataFrame(data, SCHEMA))
    assert sorted(map(tuple, got.select("file", "row").collect())) == sorted((r[4], r[5]) for v in kept.values() for r in v)
    want = {p: fb.precision_of([(r[2], r[3]) for r in v[-fb.WINDOW :]]) for p, v in kept.items()}
    assert {r["path_id"]: r["precision"] for r in fb.online_precision(got).collect()} == pytest.approx(want)


def test_feedback_stream(spark, tmp_path):
    data = feedback_rows(600)
    for i, name in enumerate(("f0", "f1")):
        spark.createDataFrame([r for r in data if r[4] == name], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = fb.stream_precision(stream).writeStream.outputMode("update").format("memory").queryName("precision").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("SELECT * FROM precision").collect():
        last[r["path_id"]] = (r["n"], r["precision"])
    kept = by_hand(data)
    assert {p: n for p, (n, _) in last.items()} == {p: min(len(v), fb.WINDOW) for p, v in kept.items()}
    want = {p: fb.precision_of([(r[2], r[3]) for r in v[-fb.WINDOW :]]) for p, v in kept.items()}
    assert {p: v for p, (_, v) in last.items()} == pytest.approx(want)


def test_hysteresis():
    h = Health()
    seen = []
    for i, bad in enumerate([1, 1, 0, 0, 0, 1, 1, 0, 0, 0]):
        step(h, i * 5.0, bool(bad))
        seen.append(h.state)
    assert seen == ["HEALTHY", "DEGRADED", "DEGRADED", "DEGRADED", "HEALTHY", "HEALTHY", "DEGRADED", "DEGRADED", "DEGRADED", "COOLDOWN"]
    step(h, 45 + 299.0, False)
    assert h.state == "COOLDOWN"
    step(h, 45 + 300.0, False)
    assert h.state == "DEGRADED"


def plain_states(times, bad):
    """The rule, one observation after another."""
    state, b, g, switches, until, out = "HEALTHY", 0, 0, [], 0.0, []
    for at, x in zip(times, bad):
        if state == "COOLDOWN" and at < until:
            out.append((state, False))
            continue
        if state == "COOLDOWN":
            state, b, g = "DEGRADED", 0, 0
        b, g = (b + 1, 0) if x else (0, g + 1)
        new = "DEGRADED" if state == "HEALTHY" and b >= 2 else "HEALTHY" if state == "DEGRADED" and g >= 3 else state
        changed = new != state
        state = new
        if changed:
            switches = [t for t in switches if at - t <= 300] + [at]
            if len(switches) > 3:
                state, until = "COOLDOWN", at + 300
        out.append((state, changed))
    return out


def test_jumps_against_the_rule():
    rnd = random.Random(12)
    for _ in range(200):
        n = rnd.randint(0, 300)
        times = np.cumsum([rnd.choice([0.0, 1.0, 5.0, 40.0]) for _ in range(n)])
        share = rnd.choice([0.1, 0.5, 0.6, 0.9])
        bad = np.array([rnd.random() < share for _ in range(n)], dtype=bool)
        h, got = Health(), []
        cut = sorted(rnd.randint(0, n) for _ in range(3))
        for a, b in zip([0, *cut], [*cut, n]):
            state, switched = move(h, times[a:b], bad[a:b])
            got += zip(state.tolist(), switched.tolist())
        assert got == plain_states(times.tolist(), bad.tolist())


def test_unhealthy_and_trigger(spark):
    df = spark.createDataFrame([(9000.0, 0.9, 0.05), (50.0, 0.01, 1.0), (None, 0.6, None), (5000.0, 0.5, 0.2), (None, None, None)], "l double, k double, t double")
    got = [tuple(r) for r in df.select(unhealthy("l", "k", "t"), trigger("l", "k", "t")).collect()]
    assert got == [(True, "heartbeat_latency_ms=9000.0; kl_divergence=0.9000; throughput_ratio=0.0500"), (False, "within_bounds"), (True, "kl_divergence=0.6000"), (False, "within_bounds"), (False, "within_bounds")]


def test_hysteresis_batch_and_stream(spark, tmp_path):
    rnd = random.Random(1)
    data = [(c, datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=7 * i), rnd.random() < 0.5) for c in "ab" for i in range(60)]
    schema = "component string, ts timestamp, unhealthy boolean"
    batch = sorted(map(tuple, health_states(spark.createDataFrame(data, schema)).collect()))
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM states").collect())) == batch


def test_ranks_and_quantiles(spark):
    rnd = random.Random(2)
    data = [(i, rnd.choice([None, 1.0, 2.0, 2.0, rnd.random(), -5.0])) for i in range(500)]
    df = spark.createDataFrame(data, "k int, v double").repartition(4)
    got = {r["k"]: (r["_rank"], r["up"]) for r in in_order(df.withColumn("one", F.lit(1)), "v", "k", {"up": "one"}).collect()}
    order = sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert got == {k: (i + 1, i + 1) for i, (k, _) in enumerate(order)}
    heavy = [(i, 0.5 if i % 3 else float(i % 7)) for i in range(900)]
    hot = spark.createDataFrame(heavy, "k int, v double").repartition(4)
    got = {r["k"]: r["_rank"] for r in in_order(hot, "v", "k").collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(heavy, key=lambda x: (x[1], x[0])))}
    values = [v for _, v in data if v is not None]
    assert quantiles(df, "v", [0, 0.1, 0.5, 0.99, 1]) == pytest.approx(list(np.quantile(values, [0, 0.1, 0.5, 0.99, 1])))
    assert quantiles(df.where("k < 0"), "v", [0.5]) == [None]


def test_weights_stay_in_bounds(spark):
    rnd = random.Random(5)
    data = [(rnd.random(), rnd.random(), rnd.random(), rnd.random(), rnd.randint(1, 5)) for _ in range(50)]
    df = spark.createDataFrame(data, "a double, b double, c double, iso double, n int")
    w = df.withColumn("w", fusion.bounded(fusion.pack(F.col("a"), F.col("b"), F.col("c")), 5)).withColumn("i", fusion.isolated(F.col("w"), F.col("iso"))).withColumn("f", fusion.floored(F.col("i"), F.col("n")))
    for r in w.collect():
        for x in (r["i"], r["f"]):
            assert sum(x) == pytest.approx(1) and min(x) >= 0.0499
        assert r["n"] >= 3 or r["f"]["w_ml"] >= 0.7


def test_budget_fold(spark):
    df = spark.createDataFrame([([0.8] * 7,), ([0.6] * 3,), ([],), ([0.8] * 5 + [0.1] * 9,)], "p array<double>")
    assert [r[0] for r in df.select(drift.adjusted_budget(F.col("p"))).collect()] == [0.75, 0.58, 0.6, 0.65]


def test_clean_scores(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (0.9,), (float("nan"),), (None,)], "score double")
    assert sorted(r[0] for r in drift.clean_scores(df).collect()) == [0.2, 0.4, 0.4, 0.4, 0.9]


def test_entities_and_faithfulness(spark):
    t = "Account NP0001 sent NPR 2.3M on 2025-06-14. Nothing else. Account #77 got USD 500K on 14/06/2025."
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    full = text.faithfulness(text.summary(text.entities(df, "t"), "t")).collect()
    assert full[0]["accounts"] == ["NP0001", "77"] and full[0]["amounts"] == ["NPR 2.3M", "USD 500K", "2.3M", "500K"] and full[0]["dates"] == ["2025-06-14", "14/06/2025"]
    assert [r["faithfulness"] for r in full][1:] == [100.0, 100.0] and full[0]["grade"] == "C"  # the points of NPR 2.3M end a sentence
    v = spark.createDataFrame([("NPR 2.3M",), ("1,200",), ("$5K",), (",,",), ("2 million",), (None,)], "a string").select(text.amount_value(F.col("a"))).collect()
    assert [r[0] for r in v] == [pytest.approx(2.3e6), 1200.0, 5000.0, None, None, None]
    s = spark.createDataFrame([("Ram Bahadur", "paid to RAM BAHADAR"), ("xyz", "abc"), (None, "a")], "e string, t string")
    assert [r[0] for r in s.select(text.similar(F.col("e"), F.col("t"))).collect()] == [True, False, False]


def test_report_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><report_id>R1</report_id><x><account>NP1</account></x><account_id>5</account_id><reason>why</reason></r>")
    (tmp_path / "b.xml").write_text("<r><account_number>NP2</account_number><account_id>x5</account_id></r>")
    (tmp_path / "c.xml").write_text("<r><broken")
    got = sorted(map(tuple, read_reports(spark, str(tmp_path)).collect()))
    assert got == [("R1", "NP1", 5, "why"), ("b", "NP2", None, None)]
    assert reports_or_demo(spark, str(tmp_path / "none")).count() == 3
    with pytest.raises(FileNotFoundError):
        read(spark, "accounts", str(tmp_path / "none.csv"))


def test_learned(spark):
    rnd = random.Random(1)
    data = [(i, x, y, int(x + 0.1 * rnd.random() > 0.6)) for i in range(300) for x, y in [(rnd.random(), rnd.random())]]
    df = spark.createDataFrame(data, "row_index bigint, x double, y double, label int")
    model = learned.fit_trees(df, ["x", "y"], trees=3, depth=2)
    assert learned.importances(model, ["x", "y"])[0][0] == "x"
    out = learned.scored(model, df, ["x", "y"]).collect()
    assert sum((r["model_score"] > 0.5) == (r["label"] == 1) for r in out) > 270
    linear = learned.fit_linear(df, ["x", "y"])
    assert {r["feature"] for r in learned.contributions(linear, df, ["x", "y"]).collect() if r["place"] == 0} == {"x"}
    done = learned.calibrated(df, df, "x").orderBy("x").collect()
    assert all(a["calibrated"] <= b["calibrated"] + 1e-12 for a, b in zip(done, done[1:]))
    models, meta = learned.stacked(df, ["x", "y"], folds=2, configs=((2, 2), (2, 3)))
    assert len(models) == 2 and len(meta.stages[-1].coefficients) == 2


def test_moving_reference(spark):
    df = spark.createDataFrame([([[0.5, 0.5], [1.0, 0.0], [0.0, 1.0]],), ([[0.2, 0.8]],)], "h array<array<double>>")
    got = [list(r[0]) for r in df.select(drift.moving_reference(F.col("h"), 0.5)).collect()]
    assert got == [pytest.approx([0.375, 0.625]), pytest.approx([0.2, 0.8])]


def test_watermarked_variant(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1)
    rows = [("full", at, 0.5, 1, "f", 0), ("full", at + datetime.timedelta(days=1), 0.5, 0, "f", 1), ("full", at + datetime.timedelta(days=3), 0.5, 0, "f", 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = fb.with_late_bound(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["share"]) for r in spark.sql("SELECT * FROM late").collect()) == [(1, 0.0), (1, 1.0)]


def test_kept_model(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(40)], "row_index bigint, x double, label int")
    made = []
    fit = lambda: made.append(1) or learned.fit_linear(df, ["x"])
    a = learned.load_or_fit(str(tmp_path / "m"), fit)
    b = learned.load_or_fit(str(tmp_path / "m"), fit)
    assert made == [1] and a.stages[-1].coefficients == b.stages[-1].coefficients


def test_similar_against_every_stretch(spark):
    from difflib import SequenceMatcher

    rnd = random.Random(13)
    word = lambda n: "".join(rnd.choice("ab1") for _ in range(n))
    data = [(word(rnd.randint(0, 6)), word(rnd.randint(0, 25))) for _ in range(300)] + [(None, "a"), ("a", None), ("A1", "xa1x"), ("", "x")]

    def plain(e, t):
        if e is None or t is None:
            return False
        e, t = e.lower(), t.lower()
        return e in t or any(SequenceMatcher(None, e, t[i : i + len(e)]).ratio() >= 0.75 for i in range(len(t) - len(e) + 1))

    got = spark.createDataFrame(data, "e string, t string").select("e", "t", text.similar(F.col("e"), F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == [plain(r["e"], r["t"]) for r in got]


def test_a_kept_model_that_cannot_be_read_is_an_error(tmp_path, spark):
    (tmp_path / "m" / "metadata").mkdir(parents=True)
    (tmp_path / "m" / "metadata" / "part-00000").write_text("no model")
    with pytest.raises(Exception):
        learned.load_or_fit(str(tmp_path / "m"), lambda: pytest.fail("fitted anew"))
