"""Counts and totals for keys of which a few hold most rows.

Dense accumulators instead of a shuffle of rows by key. Each equal input split
dictionary-encodes its keys and adds its rows up with ``numpy.bincount`` into arrays as long
as its dictionary, in order of the keys' hashes. How many distinct keys there are is then
told from the keys of a hash range, and the dictionaries are cut into array blocks of hash
buckets of about ``BLOCK_KEYS`` keys. Blocks of one bucket are summed ``FAN`` at a time,
level by level, until one is left. A key takes one slot of a split's block however many
rows it has; a group of the reduction holds about ``FAN * BLOCK_KEYS`` slots, whatever
number of splits and keys there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import materialise

#: Slots of an array block, and blocks that are summed at once.
BLOCK_KEYS = 1 << 15
FAN = 32
#: A split with more distinct keys than this gives several dictionaries.
MOST_HELD = 4_000_000
#: One of so many keys, by hash, is told to count the distinct ones.
TOLD = 1024


def _hashes(keys: pa.Array) -> np.ndarray:
    if pa.types.is_integer(keys.type):
        h = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    else:
        h = pd.util.hash_array(np.asarray(pc.fill_null(keys, "").to_pylist(), dtype=object), categorize=False)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _accumulate(keys: pa.Array, counts: np.ndarray | None, sums: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Dictionary-encode ``keys``, NULL being one of them, and scatter-add into arrays as long as the dictionary."""
    encoded = pc.dictionary_encode(keys, null_encoding="encode")
    codes, n = encoded.indices.to_numpy(zero_copy_only=False), len(encoded.dictionary)
    number = np.bincount(codes, minlength=n).astype(np.int64) if counts is None else np.zeros(n, np.int64)
    if counts is not None:
        np.add.at(number, codes, counts)
    return encoded.dictionary, number, np.bincount(codes, weights=sums, minlength=n)


def _lists(offsets: np.ndarray, *columns) -> list[pa.Array]:
    at = pa.array(offsets.astype(np.int32))
    return [pa.ListArray.from_arrays(at, c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]


def _split_dictionaries(sides: dict[str, str], value: str | None, schema: pa.Schema):
    names = list(sides)

    def rows(side: str, split: int, keys: pa.Array, counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        h = _hashes(keys)
        order = np.argsort(h, kind="stable")
        keys, told = keys.take(pa.array(order)), (h[order] % np.uint64(TOLD)) == 0
        offsets = np.append(np.arange(0, len(order), BLOCK_KEYS), len(order))
        n = len(offsets) - 1
        told_offsets = np.concatenate([[0], np.cumsum(told)])[offsets]
        return pa.RecordBatch.from_arrays(
            [pa.array([side] * n, pa.string()), pa.array([split] * n, pa.int32()), pa.array([len(order)] * n, pa.int64()),
             *_lists(told_offsets, keys.filter(pa.array(told))), *_lists(offsets, keys, counts[order], sums[order])],
            schema=schema,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        split = context.partitionId() if context else 0
        parts: dict[str, list] = {side: [] for side in names}

        def folded(side: str):
            keys, counts, sums = zip(*parts[side])
            return _accumulate(pa.concat_arrays(keys), np.concatenate(counts), np.concatenate(sums))

        for batch in batches:
            amounts = np.zeros(batch.num_rows)
            if value is not None:
                amounts = np.nan_to_num(pc.fill_null(batch.column(value), 0.0).to_numpy(zero_copy_only=False), nan=0.0)
            for side in names:
                if batch.num_rows:
                    parts[side].append(_accumulate(batch.column(sides[side]), None, amounts))
                if len(parts[side]) > 64 and sum(len(p[0]) for p in parts[side]) > 2 * len(parts[side][0][0]) + 1_000_000:
                    parts[side] = [folded(side)]
                    if len(parts[side][0][0]) > MOST_HELD:
                        yield rows(side, split, *parts[side].pop())
        for side in names:
            if parts[side]:
                yield rows(side, split, *folded(side))

    return run


def _cut_blocks(bits: dict[str, int], schema: pa.Schema):
    """Dictionaries, in order of hash, cut at the borders of their side's 2**bits buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                side = row.column("side")[0].as_py()
                keys, counts, sums = (row.column(c).flatten() for c in ("keys", "counts", "sums"))
                bucket = (_hashes(keys) >> np.uint64(64 - bits[side])).astype(np.int32)
                begins = np.flatnonzero(np.diff(bucket, prepend=-1))
                n = len(begins)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([side] * n, pa.string()), pa.array(bucket[begins]), pa.array(row.column("split").to_pylist() * n, pa.int32()),
                     *_lists(np.append(begins, len(keys)), keys, counts, sums)],
                    schema=schema,
                )

    return run


def _sum_blocks(schema: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        one = group.combine_chunks()
        keys, counts, sums = (one.column(c).combine_chunks().flatten() for c in ("keys", "counts", "sums"))
        keys, counts, sums = _accumulate(keys, counts.to_numpy(zero_copy_only=False), sums.to_numpy(zero_copy_only=False))
        first = [one.column(c).combine_chunks().slice(0, 1) for c in ("side", "bucket", "lane")]
        return pa.Table.from_arrays([*first, *_lists(np.array([0, len(keys)]), keys, counts, sums)], schema=schema)

    return run


def dense_key_totals(df: DataFrame, sides: dict[str, str], value: str | None = None, fan: int = FAN) -> DataFrame:
    """(side, key, n_rows, total) for every key of every side.

    sides: output label -> key column. Keys of whole numbers come out as bigint, others as
    string. value: column to add up; NULL and NaN add 0. Rows with a NULL key come out under
    a NULL key, so that shares of all rows can be told. An empty input gives no rows. Totals
    of one key may differ in the last bits between runs, as floating-point addition follows
    the order of the splits.
    """
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for c in sides.values())
    kind, arrow = ("bigint", pa.int64()) if whole else ("string", pa.string())
    arrays = f"keys array<{kind}>, counts array<bigint>, sums array<double>"
    fields = [("keys", pa.list_(arrow)), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.float64()))]
    columns = [F.col(c).cast(kind).alias(c) for c in dict.fromkeys(sides.values())]
    if value is not None:
        columns.append(F.col(value).cast("double").alias("_value"))
    split_schema = pa.schema([("side", pa.string()), ("split", pa.int32()), ("n", pa.int64()), ("told", pa.list_(arrow)), *fields])
    dictionaries = materialise(
        df.select(*columns).mapInArrow(
            _split_dictionaries(sides, value and "_value", split_schema), f"side string, split int, n bigint, told array<{kind}>, {arrays}"
        )
    )
    # a row per side
    sizes = dictionaries.groupBy("side").agg(F.max("n").alias("most"), F.max("split").alias("last")).collect()
    told = dictionaries.select("side", F.explode("told").alias("key")).distinct().groupBy("side").agg(F.count("*")).collect()
    distinct = {side: TOLD * n for side, n in told}
    bits = {r["side"]: max(3, int(max(r["most"], distinct.get(r["side"], 0)) // BLOCK_KEYS).bit_length()) for r in sizes}
    block_schema = pa.schema([("side", pa.string()), ("bucket", pa.int32()), ("lane", pa.int32()), *fields])
    ddl = f"side string, bucket int, lane int, {arrays}"
    blocks = dictionaries.select("side", "split", "keys", "counts", "sums").mapInArrow(_cut_blocks(bits, block_schema), ddl)
    lanes = max((r["last"] for r in sizes), default=0) + 1
    while True:
        lanes = -(-lanes // fan)
        blocks = blocks.withColumn("lane", F.floor(F.col("lane") / F.lit(fan)).cast("int"))
        blocks = blocks.groupBy("side", "bucket", "lane").applyInArrow(_sum_blocks(block_schema), ddl)
        if lanes == 1:
            break
    return blocks.select("side", F.inline(F.arrays_zip("keys", "counts", "sums")).alias("key", "n_rows", "total"))


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """(side, key, n_rows) of the keys that hold at least ``share`` of all rows of their side, NULL keys counted in the whole but never given."""
    whole = totals.groupBy("side").agg(F.sum("n_rows").alias("all_rows"))
    return (
        totals.where(F.col("key").isNotNull())
        .join(F.broadcast(whole), "side")  # as many rows as there are sides
        .where(F.col("n_rows") >= F.lit(share) * F.col("all_rows"))
        .select("side", "key", "n_rows")
    )
