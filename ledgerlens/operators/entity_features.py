"""One row per entity from its events: number, latest day and total for every event type.

Two-stage salted aggregation. Stage one groups by entity, role, type and a salt taken from
the event's id, so the rows of a heavy entity-type group are spread over many tasks after
the map-side combine; stage two is partitioned by the entity alone and merges at most
``salts`` partial rows per group. The last step lays the statistics out over the complete
list of types.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: More types than this would make the row per entity unbounded.
MOST_TYPES = 10_000


def normal_code(column: str):
    """Upper case without outer blanks; a blank code is NULL."""
    text = F.upper(F.trim(F.col(column)))
    return F.when(text != "", text)


def clean_score(column: str):
    """A score from 0 to 1; NULL, NaN and values outside give NULL."""
    return F.when(F.col(column).between(0.0, 1.0), F.col(column))


def role_events(tx: DataFrame) -> DataFrame:
    """(row_index, account_id, account_role, tx_code, day, score): each transaction once for its sender and once for its receiver.

    Transactions without a day or a tx_code do not count, nor does a NULL account.
    """
    clean = tx.select(
        "row_index", "Sender_account", "Receiver_account", normal_code("tx_code").alias("tx_code"),
        "day", clean_score("tx_score").alias("score"),
    ).where("day IS NOT NULL AND tx_code IS NOT NULL")
    roles = F.array(
        F.struct(F.lit("sender").alias("account_role"), F.col("Sender_account").alias("account_id")),
        F.struct(F.lit("receiver").alias("account_role"), F.col("Receiver_account").alias("account_id")),
    )
    return (
        clean.withColumn("side", F.explode(roles))
        .select("row_index", "side.account_id", "side.account_role", "tx_code", "day", "score")
        .where("account_id IS NOT NULL")
    )


def entity_type_stats(events: DataFrame, salts: int = SALTS) -> DataFrame:
    """(account_id, account_role, tx_code, n_tx, last_day, score_total), partitioned by account_id."""
    partial = (
        events.withColumn("salt", F.pmod(F.xxhash64("row_index"), F.lit(salts)).cast("int"))
        .groupBy("account_id", "account_role", "tx_code", "salt")
        .agg(F.count("*").alias("n"), F.max("day").alias("d"), F.sum("score").alias("s"))
    )
    return (
        partial.drop("salt").repartition("account_id")
        .groupBy("account_id", "account_role", "tx_code")
        .agg(F.sum("n").alias("n_tx"), F.max("d").alias("last_day"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("score_total"))
    )


ROLES = ("sender", "receiver")


def _laid_out(width: int, wanted: tuple[str, ...]):
    """Sorted rows of (account_id, cell, n, and day, total where wanted) to one row per account with dense arrays, a cell being role and type."""
    kinds = {k: t for k, t in (("n", pa.int64()), ("last", pa.date32()), ("score", pa.float64())) if k in wanted}
    fields = [pa.field("account_id", pa.int64())] + [pa.field(f"{r}_{k}", pa.list_(t)) for r in ROLES for k, t in kinds.items()]
    schema = pa.schema(fields)

    def block(account: np.ndarray, cell: np.ndarray, *statistics: np.ndarray) -> pa.RecordBatch:
        ids, row = np.unique(account, return_inverse=True)
        at = row * (2 * width) + cell
        size = len(ids) * 2 * width
        dense = {k: np.zeros(size, x.dtype) for k, x in zip(kinds, statistics)}
        for k, x in zip(kinds, statistics):
            dense[k][at] = x
        quiet = (dense["n"] == 0).reshape(len(ids), 2, width)
        offsets = pa.array(np.arange(0, len(ids) * width + 1, width, dtype=np.int32))
        out = [pa.array(ids)]
        for r in range(2):
            for k, t in kinds.items():
                values = dense[k].reshape(len(ids), 2, width)[:, r].ravel()
                mask = quiet[:, r].ravel() if k == "last" else None
                out.append(pa.ListArray.from_arrays(offsets, pa.array(values, mask=mask).cast(t)))
        return pa.RecordBatch.from_arrays(out, schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, *({"n": np.int64, "last": np.int32, "score": np.float64}[k] for k in kinds))]
        for batch in batches:
            new = [c.cast(pa.int32()).to_numpy(zero_copy_only=False) if pa.types.is_date(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) > 40_000:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield block(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield block(*held)

    sql = {"n": "bigint", "last": "date", "score": "double"}
    return run, "account_id bigint, " + ", ".join(f"{r}_{k} array<{sql[k]}>" for r in ROLES for k in kinds)


def event_types(tx: DataFrame) -> list[str]:
    """The complete list of types, sorted, of transactions that count; a repeated delivery adds none, so ``tx`` need not be distinct."""
    code = normal_code("tx_code").alias("tx_code")
    codes = tx.where("day IS NOT NULL AND (Sender_account IS NOT NULL OR Receiver_account IS NOT NULL)").select(code).where("tx_code IS NOT NULL")
    found = sorted(r[0] for r in codes.distinct().limit(MOST_TYPES + 1).collect())
    if len(found) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} event types: use entity_type_stats, its long form")
    return found


def feature_table(events: DataFrame, codes: list[str], salts: int = SALTS, statistics: tuple[str, ...] = ("n", "last", "score")) -> DataFrame:
    """One row per account with arrays over ``codes``, the complete, sorted list of types.

    Columns: account_id, tx_codes, and for each role ``<role>_n`` (0 where nothing
    happened), ``<role>_last`` (NULL where nothing happened) and ``<role>_score`` (0.0
    likewise). An input without valid events gives no rows. The rows of an account that are
    laid out together are at most two for each type. statistics: the arrays to give, n among them. Events
    of a type that is not in ``codes`` are an error.
    """
    every = F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>")
    spark = events.sparkSession
    places = F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "tx_code string, place int"))  # at most MOST_TYPES rows
    place = F.coalesce("place", F.raise_error(F.concat(F.lit("not in the list of types: "), "tx_code")).cast("int"))
    cell = place + F.when(F.col("account_role") == ROLES[1], len(codes)).otherwise(0)
    stats = entity_type_stats(events, salts).join(places, "tx_code", "left")
    columns = [c for k, c in (("n", "n_tx"), ("last", "last_day"), ("score", "score_total")) if k in statistics]
    cells = stats.select("account_id", cell.alias("cell"), *columns).sortWithinPartitions("account_id")
    run, schema = _laid_out(len(codes), statistics)
    return cells.mapInArrow(run, schema).select("account_id", every.alias("tx_codes"), *(f"{r}_{k}" for r in ROLES for k in ("n", "last", "score") if k in statistics))


def most_frequent_type(table: DataFrame) -> DataFrame:
    """(account_id, account_role, tx_code) from a feature table with n and last: the most frequent type of each role; ties go to the latest day, then to the first in the alphabet. A role without events gives no row."""

    def best(role: str) -> Column:
        cells = F.transform(F.arrays_zip(F.col(f"{role}_n").alias("n"), F.col(f"{role}_last").alias("d")), lambda x, i: F.struct(x["n"].alias("n"), x["d"].alias("d"), (-i).alias("i")))
        return F.struct(F.lit(role).alias("account_role"), F.array_max(cells).alias("x"))

    found = table.select("account_id", "tx_codes", F.inline(F.array(*map(best, ROLES)))).where("x.n > 0")
    return found.select("account_id", "account_role", F.element_at("tx_codes", 1 - F.col("x.i")).alias("tx_code"))
