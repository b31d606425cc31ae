"""Sources of betweenness lie all over the ids, and unsettled values are an error."""

import pytest

from ledgerlens.operators import flow


def test_sources_and_rounds(spark):
    paths = spark.createDataFrame([(3 * i + j, 3 * i + j + 1, 1.0) for i in range(20) for j in (0, 1)], "src bigint, dst bigint, amount double")
    got = flow.betweenness(paths, sources=20).where("betweenness > 0").select("id").collect()
    assert any(r["id"] >= 21 for r in got)
    with pytest.raises(RuntimeError):
        flow.betweenness(paths, most_rounds=1)
