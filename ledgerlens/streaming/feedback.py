"""Confirmed scores as they arrive: in order per path, a bounded window, and the precision among the best of it.

The batch form reads arrival order from the files; the streaming form keeps the same
window in state. Both follow one rule: a row older than the newest kept one of its path is
dropped, an equally old one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, LEAST, BEST = 500, 200, 50
SHARD = 1 << 16


def kept_in_order(feedback: DataFrame) -> DataFrame:
    """feedback (path_id, ts, file, row, ...) without the rows that come after a later one of their path in order of (file, row).

    Sharded by path and stretch of a file: a path with a third of all rows is many tasks,
    joined by one row per stretch.
    """
    rows = feedback.withColumn("_b", F.floor(F.col("row") / SHARD))
    tops = rows.groupBy("path_id", "file", "_b").agg(F.max("ts").alias("_t"))
    before = tops.withColumn("_before", F.max("_t").over(W.partitionBy("path_id").orderBy("file", "_b").rowsBetween(W.unboundedPreceding, -1))).drop("_t")
    inside = W.partitionBy("path_id", "file", "_b").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    newest = F.greatest(F.max("ts").over(inside), F.col("_before"))
    return rows.join(before, ["path_id", "file", "_b"]).withColumn("_newest", newest).where("_newest IS NULL OR ts >= _newest").drop("_b", "_before", "_newest")


def last_rows(kept: DataFrame, n: int = WINDOW) -> DataFrame:
    """Each path's last ``n`` rows by arrival, with _a counting back from the newest; ranks are limited before the exchange."""
    return kept.withColumn("_a", F.row_number().over(W.partitionBy("path_id").orderBy(F.desc("file"), F.desc("row")))).where(F.col("_a") <= n)


def online_precision(kept: DataFrame) -> DataFrame:
    """(path_id, n, precision): over each path's last ``WINDOW`` rows the share of labels among the ``BEST`` highest scores, ties by arrival; NULL below ``LEAST`` rows."""
    ranked = last_rows(kept).withColumn("_s", F.row_number().over(W.partitionBy("path_id").orderBy(F.desc("score"), F.desc("_a"))))
    return ranked.groupBy("path_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("_s") <= BEST, F.col("label"))).alias("_p")).select(
        "path_id", "n", F.when(F.col("n") >= LEAST, F.col("_p")).alias("precision")
    )


def precision_after(feedback: DataFrame, period: str) -> DataFrame:
    """(path_id, period, precision): online_precision as it stands after each period of a path, in order of ts, ties by content.

    Rows are numbered inside a day and moved on by the days before; a window of ``WINDOW``
    rows lies in two stretches of that many.
    """
    rows = feedback.withColumn("_d", F.to_date("ts"))
    days = rows.groupBy("path_id", "_d").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("path_id").orderBy("_d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("path_id", "_d").orderBy("ts", "account_id", "score", "label"))
    placed = rows.withColumn("_own", own).join(days.select("path_id", "_d", before.alias("_b")), ["path_id", "_d"])
    placed = placed.withColumn("_at", F.col("_b") + F.col("_own")).withColumn("_part", F.floor((F.col("_at") - 1) / WINDOW))
    ends = placed.groupBy("path_id", period).agg(F.max("_at").alias("_end")).withColumn("_last", F.floor((F.col("_end") - 1) / WINDOW))
    ends = ends.withColumn("_part", F.explode(F.array("_last", F.col("_last") - 1)))
    seen = ends.join(placed.select("path_id", "_part", "_at", "score", "label"), ["path_id", "_part"]).where((F.col("_at") <= F.col("_end")) & (F.col("_at") > F.col("_end") - WINDOW))
    ranked = seen.withColumn("_s", F.row_number().over(W.partitionBy("path_id", period).orderBy(F.desc("score"), "_at")))
    share = F.avg(F.when(F.col("_s") <= BEST, F.col("label")))
    return ranked.groupBy("path_id", period).agg(F.when(F.count("*") >= LEAST, share).alias("precision"))


def precision_of(window: list[tuple[float, int]]) -> float | None:
    if len(window) < LEAST:
        return None
    best = sorted(window, key=lambda x: -x[0])[:BEST]
    return sum(x[1] for x in best) / len(best)


def stream_precision(feedback: DataFrame) -> DataFrame:
    """The streaming form: (path_id, n, precision) of each path after every trigger. Rows of a trigger are taken in order of (file, row)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, scores, labels = state.get if state.exists else (None, [], [])
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["file", "row"], kind="stable")
        window = list(zip(scores, labels))
        for ts, score, label in zip(rows["ts"], rows["score"], rows["label"]):
            if newest is None or ts.value >= newest:
                newest = ts.value
                window.append((float(score), int(label)))
        window = window[-WINDOW:]
        state.update((newest, [x[0] for x in window], [x[1] for x in window]))
        yield pd.DataFrame({"path_id": [key[0]], "n": [len(window)], "precision": [precision_of(window)]})

    return feedback.groupBy("path_id").applyInPandasWithState(
        step, "path_id string, n bigint, precision double", "newest bigint, scores array<double>, labels array<int>", "update", GroupStateTimeout.NoTimeout
    )


def with_late_bound(feedback: DataFrame, late: str = "10 minutes", every: str = "1 day") -> DataFrame:
    """The watermarked variant: counts and label shares per path and window, rows later than ``late`` dropped by the engine."""
    return feedback.withWatermark("ts", late).groupBy(F.window("ts", every), "path_id").agg(F.count("*").alias("n"), F.avg("label").alias("share"))
