"""The whole pipeline: the wide relation with graph features up to the boundary goes into the model, reasons and narratives come out."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import flow, learned
from ledgerlens.plans import study_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
def test_whole_pipeline(spark, monkeypatch):
    used, known, fit, graph = [], [], learned.fit_trees, flow.graph_features
    monkeypatch.setattr(learned, "fit_trees", lambda rows, names, **k: used.extend(names) or fit(rows, names, **k))
    monkeypatch.setattr(flow, "graph_features", lambda e, half_life, sources: known.append(e) or graph(e, half_life, 5))
    out = study_queries.risk_pipeline(spark, FOLDER).collect()
    assert {"sender_gf_betweenness", "receiver_gf_hub_score", "sender_gf_td_pagerank_score", "sender_institution_risk", "receiver_branch_risk", "pair_total_txs", "amount_zscore_sender", "near_threshold_100k", "velocity_burst_ratio"} <= set(used)
    assert "tx_count_30" not in used
    split = study_queries.features.temporal_split(study_queries.transactions(spark, FOLDER))
    assert known[0].count() < study_queries.edges(spark, FOLDER).count()
    assert known[0].agg(F.max("day")).first()[0] < split.where("split = 'train'").agg(F.max("day")).first()[0]
    assert sorted(r["place"] for r in out) == list(range(1, len(out) + 1)) and len({r["account_id"] for r in out}) == len(out) > 0
    assert all(r["reasons"] and r["summary"] and r["typologies"] and r["faithfulness"] is not None and r["is_cycle"] is not None for r in out)
    top = sorted(out, key=lambda r: r["place"])
    assert all(a["risk_recent_weighted"] >= b["risk_recent_weighted"] for a, b in zip(top, top[1:]))
