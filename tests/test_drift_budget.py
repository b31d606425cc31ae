"""Budgets see drifting scores and labels."""

import datetime as dt
import random

import pytest

from ledgerlens.plans import risk_queries
from ledgerlens.streaming.feedback import precision_after, precision_of

SCHEMA = "path_id string, ts timestamp, account_id bigint, score double, label int"


def test_divergence_raises_the_budget(spark, monkeypatch):
    rows = [("p", dt.datetime(2025, m, 1 + i), i, 0.95 if m == 3 else 0.15, 1) for m in (1, 2, 3) for i in range(10)]
    monkeypatch.setattr(risk_queries, "feedback", lambda *_: spark.createDataFrame(rows, SCHEMA))
    got = {r["seq"] - 2025 * 12: (r["kl"] > 0.1, r["budget"]) for r in risk_queries.drift_budget(spark, "").collect()}
    assert got == {1: (False, 0.65), 2: (False, 0.65), 3: (True, 0.68)}


def test_labels_adjust_the_budget(spark, monkeypatch):
    start = dt.datetime(2025, 1, 2)
    rows = [(p, start + dt.timedelta(days=7 * w, minutes=i), i, 0.6 if i < 50 else 0.1, int(i < 50 and p == "good")) for p in ("good", "bad") for w in range(5) for i in range(200)]
    monkeypatch.setattr(risk_queries, "feedback", lambda *_: spark.createDataFrame(rows, SCHEMA))
    got = {r["path_id"]: (r["budget"], r["blended"]) for r in risk_queries.adjusted_budget(spark, "").collect()}
    assert got == {"good": (0.65, pytest.approx(0.7 + 0.3 * 0.25)), "bad": (0.60, 0.0)}


def test_precision_after_each_week(spark):
    rng = random.Random(5)
    rows = [("p", dt.datetime(2025, 1, 2) + dt.timedelta(minutes=37 * i), i, round(rng.random(), 2), rng.randrange(2)) for i in range(1500)]
    data = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "floor(unix_date(to_date(ts)) / 7) AS week")
    want = {}
    for i, r in enumerate(rows):
        want[(r[1].date() - dt.date(1970, 1, 1)).days // 7] = precision_of([x[3:] for x in rows[max(0, i - 499) : i + 1]])
    got = {r["week"]: r["precision"] for r in precision_after(data, "week").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
