"""Totals and averages over trailing periods from segment trees that are kept.

The days of an entity are cut into time shards of ``SHARD`` days. A shard with activity is
one segment tree: node 1 is the root, node i has the children 2i and 2i+1, the leaves
(days) start at ``SHARD``; only nodes with activity are stored, each with a sum and a count.
The trees are the table every answer comes from, whether they were just built, read from a
kept folder or corrected.

A trailing period ends on a day of one shard and reaches at most into the shard before it,
so the days of a shard (a block) are answered from two trees, its own and its left
neighbour, each period from O(log) nodes. Blocks are independent of one another: memory
goes by the blocks of an Arrow batch, not by the days an entity spans. A late correction
adds its difference to one leaf and its ancestors; trees without a correction are not
rewritten, and only blocks that a correction can reach are answered again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of a shard, a power of two, and the longest trailing period.
SHARD = 64
LEVELS = SHARD.bit_length()
PERIODS = (7, 30)
#: Blocks that are laid out in memory at once.
BLOCKS_AT_ONCE = 2048
TREE_SCHEMA = "entity bigint, shard int, first int, last int, nodes array<int>, sums array<double>, counts array<bigint>"
_ARROW_TREE = pa.schema([
    ("entity", pa.int64()), ("shard", pa.int32()), ("first", pa.int32()), ("last", pa.int32()),
    ("nodes", pa.list_(pa.int32())), ("sums", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64())),
])


def daily(tx: DataFrame) -> DataFrame:
    """(entity, day, total, n) of distinct transactions: day as days since 1970. NULL senders and rows without a day do not count; a NULL or NaN amount adds 0 but makes its day active."""
    amount = F.coalesce(F.nanvl("amount_local_npr", F.lit(0.0)), F.lit(0.0))
    return (
        tx.select(F.col("Sender_account").alias("entity"), F.unix_date("day").alias("day"), amount.alias("amount"))
        .where("entity IS NOT NULL AND day IS NOT NULL")
        .groupBy("entity", "day")
        .agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    )


def shard_of(day: Column | str) -> Column:
    return F.floor((F.col(day) if isinstance(day, str) else day) / F.lit(SHARD)).cast("int")


def _leaves(days: DataFrame) -> DataFrame:
    """(entity, shard, leaves): the days of each shard, at most SHARD of them."""
    leaf = F.struct(F.pmod("day", F.lit(SHARD)).cast("int").alias("leaf"), F.col("total").cast("double").alias("total"), F.col("n").cast("bigint").alias("n"))
    return days.groupBy("entity", shard_of("day").alias("shard")).agg(F.collect_list(leaf).alias("leaves"))


def _dense(rows: pa.ListArray, nodes: pa.ListArray, kind) -> np.ndarray:
    """Stored nodes laid out as trees x 2*SHARD; a NULL tree is empty."""
    out = np.zeros((len(rows), 2 * SHARD), dtype=kind)
    length = np.asarray(pc.fill_null(pc.list_value_length(nodes), 0))
    out[np.repeat(np.arange(len(rows)), length), nodes.flatten().to_numpy(zero_copy_only=False)] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def climb(nodes: np.ndarray, tree: np.ndarray, leaf: np.ndarray, delta: np.ndarray) -> None:
    """Add each delta to its leaf and the leaf's ancestors."""
    at = leaf + SHARD
    for _ in range(LEVELS):
        np.add.at(nodes, (tree, at), delta)
        at = at >> 1


def _climb_leaves(leaves: pa.ListArray, sums: np.ndarray, counts: np.ndarray) -> None:
    inner = leaves.flatten()
    tree = np.repeat(np.arange(len(leaves)), np.asarray(pc.fill_null(pc.list_value_length(leaves), 0)))
    leaf, total, n = (inner.field(x).to_numpy(zero_copy_only=False) for x in ("leaf", "total", "n"))
    climb(sums, tree, leaf, total)
    climb(counts, tree, leaf, n)


def _stored(entity: pa.Array, shard: pa.Array, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of the table: nodes that still count something. A tree that lost all activity keeps its row without nodes."""
    live = counts > 0
    tree, node = np.nonzero(live)
    offsets = pa.array(np.concatenate([[0], np.cumsum(live.sum(axis=1))]).astype(np.int32))
    leaf = live[:, SHARD:]
    some = leaf.any(axis=1)
    begin = shard.to_numpy().astype(np.int64) * SHARD
    first = pa.array((begin + leaf.argmax(axis=1)).astype(np.int32), mask=~some)
    last = pa.array((begin + SHARD - 1 - leaf[:, ::-1].argmax(axis=1)).astype(np.int32), mask=~some)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (node.astype(np.int32), sums[tree, node], counts[tree, node])]
    return pa.RecordBatch.from_arrays([entity, shard, first, last, *lists], schema=_ARROW_TREE)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCKS_AT_ONCE):
            yield batch.slice(at, BLOCKS_AT_ONCE)


def segment_trees(days: DataFrame) -> DataFrame:
    """(entity, shard, first, last, nodes, sums, counts): one row per entity and shard with activity.

    first and last are the shard's first and last active day. Days are grouped by entity
    and shard, so a heavy entity is as many groups as it has shards, each of at most
    ``SHARD`` rows. No days: no rows.
    """

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sums, counts = np.zeros((b.num_rows, 2 * SHARD)), np.zeros((b.num_rows, 2 * SHARD), dtype=np.int64)
            _climb_leaves(b.column("leaves"), sums, counts)
            yield _stored(b.column("entity"), b.column("shard"), sums, counts)

    return _leaves(days).select(F.col("entity").cast("bigint"), "shard", "leaves").mapInArrow(build, TREE_SCHEMA)


def correct(trees: DataFrame, changes: DataFrame) -> DataFrame:
    """The trees after late corrections ``changes`` (entity, day, total, n: differences to add, negative ones take away).

    Only a changed leaf and its ancestors are added to. Trees without a change pass by: where
    the corrections are few, adaptive execution broadcasts them (by their measured size) and
    the trees are not shuffled. A tree whose activity is all taken away stays without nodes.
    """
    late = _leaves(changes).select(F.col("entity").cast("bigint").alias("entity"), "shard", "leaves")

    def change(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            nodes = b.column("nodes")
            sums, counts = _dense(b.column("sums"), nodes, float), _dense(b.column("counts"), nodes, np.int64)
            _climb_leaves(b.column("leaves"), sums, counts)
            yield _stored(b.column("entity"), b.column("shard"), sums, counts)

    touched = late.join(trees.select("entity", "shard", "nodes", "sums", "counts"), ["entity", "shard"], "left").mapInArrow(change, TREE_SCHEMA)
    return trees.join(late.select("entity", "shard"), ["entity", "shard"], "left_anti").select(*touched.columns).unionByName(touched)


def keep_trees(trees: DataFrame, folder: str) -> None:
    """Write the trees as a table partitioned by shard; large shards are split into several files."""
    trees.hint("rebalance", "shard").write.partitionBy("shard").mode("overwrite").parquet(folder)


def kept_trees(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TREE_SCHEMA).parquet(folder).select("entity", "shard", "first", "last", "nodes", "sums", "counts")


def correct_kept(spark: SparkSession, folder: str, changes: DataFrame) -> None:
    """Correct a kept table in place: only the partitions of shards with a change are read and written."""
    shards = [r[0] for r in changes.select(shard_of("day").alias("shard")).distinct().collect()]  # of the calendar
    if shards:
        after = correct(kept_trees(spark, folder).where(F.col("shard").isin(shards)), changes)
        after.hint("rebalance", "shard").write.option("partitionOverwriteMode", "dynamic").partitionBy("shard").mode("overwrite").parquet(folder)


def query_nodes(k: int) -> np.ndarray:
    """For each leaf of a shard the nodes that make up its trailing k days: numbers below 2*SHARD in the shard's own tree, others in its left neighbour's; 0, which is empty, fills up."""
    if not 1 <= k <= SHARD:
        raise ValueError(f"a trailing period of {k} days does not fit shards of {SHARD} days")

    def cover(low: int, high: int) -> list[int]:
        out, a, b = [], low + SHARD, high + SHARD + 1
        while a < b:
            if a & 1:
                out.append(a)
                a += 1
            if b & 1:
                b -= 1
                out.append(b)
            a, b = a >> 1, b >> 1
        return out

    rows = []
    for leaf in range(SHARD):
        low = leaf - k + 1
        rows.append(cover(max(low, 0), leaf) + ([2 * SHARD + x for x in cover(SHARD + low, SHARD - 1)] if low < 0 else []))
    width = max(map(len, rows))
    return np.array([r + [0] * (width - len(r)) for r in rows])


def range_sums(nodes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """blocks x SHARD sums over ``wanted`` nodes of blocks x 4*SHARD (own tree, left neighbour)."""
    out = np.zeros((len(nodes), SHARD), dtype=nodes.dtype)
    for column in wanted.T:
        out += nodes[:, column]
    return out


def blocks(trees: DataFrame, quiet: int | None = None) -> DataFrame:
    """(entity, block, first_day, last_day, own, before): the shards from an entity's first to its last active one, with the trees of the shard and of the one before it (NULL where there is none).

    quiet: of the shards without activity that follow one another only so many.
    The window goes over an entity's trees, of which there are as many as the calendar has
    shards, whatever number of rows the entity holds.
    """
    entity, order = W.partitionBy("entity"), W.partitionBy("entity").orderBy("shard")
    placed = trees.where("size(nodes) > 0").select(
        "entity", "shard", F.min("first").over(entity).alias("first_day"), F.max("last").over(entity).alias("last_day"), F.struct("nodes", "sums", "counts").alias("tree"),
        F.lag("shard").over(order).alias("left_shard"), F.lag(F.struct("nodes", "sums", "counts")).over(order).alias("left_tree"), F.lead("shard").over(order).alias("next_shard"),
    )
    until = F.coalesce(F.col("next_shard") - 1, F.col("shard"))
    if quiet is not None:
        until = F.least(until, F.col("shard") + quiet)
    return placed.withColumn("block", F.explode(F.sequence("shard", until))).select(
        "entity", "block", "first_day", "last_day",
        F.when(F.col("block") == F.col("shard"), F.col("tree")).alias("own"),
        F.when((F.col("block") == F.col("shard")) & (F.col("left_shard") == F.col("shard") - 1), F.col("left_tree"))
        .when(F.col("block") == F.col("shard") + 1, F.col("tree")).alias("before"),
    )


def _laid_out(b: pa.RecordBatch):
    """(day, whether it is in the entity's span: blocks x SHARD; sums, counts: blocks x 4*SHARD nodes of both trees) of a slice of blocks."""
    begin = b.column("block").to_numpy().astype(np.int64) * SHARD
    day = begin[:, None] + np.arange(SHARD)
    inside = (day >= b.column("first_day").to_numpy()[:, None]) & (day <= b.column("last_day").to_numpy()[:, None])
    own, before = ([pc.struct_field(b.column(side), [i]) for i in range(3)] for side in ("own", "before"))
    sums, counts = (np.concatenate([_dense(x[i], x[0], kind) for x in (own, before)], axis=1) for i, kind in ((1, float), (2, np.int64)))
    return day, inside, sums, counts


def rolling_totals(trees: DataFrame, periods: tuple[int, ...] = PERIODS, only: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """(entity, day, total_k, avg_k, n_k for each period k) for every day from an entity's first to its last active day.

    Averages are per calendar day of the period, quiet days included. Periods are at most
    ``SHARD`` days. only, without: (entity, shard) of the blocks to answer, or not to.
    """
    wanted = {k: query_nodes(k) for k in periods}
    kinds = [("entity", pa.int64()), ("day", pa.int32())] + [(f"{x}_{k}", pa.float64() if x != "n" else pa.int64()) for k in periods for x in ("total", "avg", "n")]
    schema = pa.schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            day, inside, sums, counts = _laid_out(b)
            entity = np.repeat(b.column("entity").to_numpy(), inside.sum(axis=1))
            columns = [pa.array(entity), pa.array(day[inside].astype(np.int32))]
            for k in periods:
                total = range_sums(sums, wanted[k])[inside]
                columns += [pa.array(total), pa.array(total / k), pa.array(range_sums(counts, wanted[k])[inside])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    asked = blocks(trees)
    for chosen, how in ((only, "left_semi"), (without, "left_anti")):
        if chosen is not None:
            asked = asked.join(chosen.select("entity", F.col("shard").alias("block")), ["entity", "block"], how)
    ddl = "entity bigint, day int, " + ", ".join(f"total_{k} double, avg_{k} double, n_{k} bigint" for k in periods)
    asked = asked.select("entity", "block", "first_day", "last_day", "own", "before")
    return asked.mapInArrow(run, ddl).withColumn("day", F.date_from_unix_date("day"))


def peaks_and_lapses(trees: DataFrame, peak: int = 30, lapse: int = 7) -> DataFrame:
    """(entity, day, day_kind): the earliest day with the highest trailing total over ``peak`` days (to 2 decimals), and the earliest without any event in the trailing ``lapse`` days, if there is one.

    Of quiet shards that follow one another the first is laid out: its last day has nothing
    in its periods, nor has any day of the later ones, and they come after it.
    """
    most, none = query_nodes(peak), query_nodes(lapse)
    far = np.iinfo(np.int32).max
    schema = pa.schema([("entity", pa.int64()), ("total", pa.float64()), ("peak_day", pa.int32()), ("lapse_day", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            day, inside, sums, counts = _laid_out(b)
            total = np.where(inside, np.round(range_sums(sums, most), 2), -np.inf)
            best = total.max(axis=1)
            at = (total == best[:, None]) & inside
            peak_day = np.where(at.any(axis=1), day[:, 0] + at.argmax(axis=1), far)
            idle = (range_sums(counts, none) == 0) & inside
            some = idle.any(axis=1)
            lapse_day = pa.array((day[:, 0] + idle.argmax(axis=1)).astype(np.int32), mask=~some)
            yield pa.RecordBatch.from_arrays([b.column("entity"), pa.array(best), pa.array(peak_day.astype(np.int32)), lapse_day], schema=schema)

    found = blocks(trees, quiet=1).mapInArrow(run, "entity bigint, total double, peak_day int, lapse_day int").groupBy("entity").agg(
        F.max(F.struct("total", -F.col("peak_day"))).alias("best"), F.min("lapse_day").alias("lapse_day")
    )
    kinds = F.array(
        F.struct((-F.col("best.col2")).alias("day"), F.lit(f"peak_{peak}").alias("day_kind")), F.struct(F.col("lapse_day").alias("day"), F.lit(f"lapse_{lapse}").alias("day_kind"))
    )
    return found.select("entity", F.inline(kinds)).where("day IS NOT NULL").withColumn("day", F.date_from_unix_date("day"))


def touched_blocks(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity, shard): the blocks whose rows corrections can have changed: shards with a change, those after them, and those by which an entity's span has grown or shrunk."""
    changed = changes.select("entity", shard_of("day").alias("shard")).distinct()
    near = changed.select("entity", F.explode(F.array("shard", F.col("shard") + 1)).alias("shard"))
    entities = changed.select("entity").distinct()

    def span(trees: DataFrame, name: str) -> DataFrame:
        own = trees.join(entities, "entity", "left_semi")
        return own.groupBy("entity").agg(F.min("first").alias(f"{name}_first"), F.max("last").alias(f"{name}_last"))

    both = span(before, "old").join(span(after, "new"), "entity", "full_outer")

    def between(a: Column, b: Column) -> Column:
        low, high = F.least(a, b), F.greatest(a, b)  # of a span that did not exist: the other end
        return F.sequence(shard_of(low), shard_of(high))

    old_first, old_last = F.coalesce("old_first", "new_last"), F.coalesce("old_last", "new_first")
    new_first, new_last = F.coalesce("new_first", "old_last"), F.coalesce("new_last", "old_first")
    moved = both.where("coalesce(old_first, new_first) IS NOT NULL AND NOT (old_first <=> new_first AND old_last <=> new_last)").select(
        "entity", F.explode(F.concat(between(old_first, new_first), between(old_last, new_last))).alias("shard")
    )
    return near.unionByName(moved).distinct()
