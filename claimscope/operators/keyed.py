"""Batch and history stacked, and distinct on a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.operators.lookup import BROADCAST_ROWS
from claimscope.sources.staging import stage

SOURCE = "src_priority"
# Up to this many hashes of ids that batch and history share are broadcast: 8 bytes each, about 60 in a hash table.
BROADCAST_HASHES = 3_000_000


def batch_history_union(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Batch rows (``src_priority`` 0) over history rows (1), in the batch's columns."""
    return batch.withColumn(SOURCE, F.lit(0)).unionByName(
        history.select(*batch.columns).withColumn(SOURCE, F.lit(1))
    )


def keep_first(
    df: DataFrame, key: str, order_by: Sequence[str | Column] | None = None
) -> DataFrame:
    """One row per ``key``, the first in ``order_by`` (default: all columns, a total order).

    Spark cuts each map task to its first row per key before the shuffle (window
    group limit), so many copies of one key do not meet in one task.
    """
    order = list(order_by) if order_by is not None else [c for c in df.columns if c != key]
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def unique_rows(
    table: DataFrame,
    key: str,
    order_by: Sequence[str | Column] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``keep_first`` for a written table in which most keys are expected once.

    A count per key, reading the key column alone, finds the repeated keys. Without
    any, the table is returned as it is. A few are broadcast, and all other rows pass
    without a shuffle or a sort. Many are sorted out by ``keep_first`` and written.
    """
    per_key = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = stage(per_key.select(key, F.lit(True).alias("_again")), "repeated")
    n_repeated = repeated.count()
    if n_repeated == 0:
        return table
    if n_repeated > broadcast_rows:
        return stage(keep_first(table, key, order_by), "unique")
    marked = table.join(F.broadcast(repeated), key, "left").select(*table.columns, "_again")
    is_single = F.col("_again").isNull() & F.col(key).isNotNull()
    copies = keep_first(marked.filter(~is_single).drop("_again"), key, order_by)
    return marked.filter(is_single).drop("_again").unionByName(stage(copies, "copies"))


def merge_batch_history(
    batch: DataFrame,
    history: DataFrame,
    key: str = "ClaimID",
    order_by: Sequence[str | Column] | None = None,
    history_unique: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_hashes: int = BROADCAST_HASHES,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Batch and history as one table with unique ``key``; the batch copy wins.

    For written tables. A batch counted to be small costs the history no shuffle: its
    rows with a batch key are dropped map side. So does a larger one that shares few enough
    keys with the history (see ``_not_in``). ``history_unique`` skips the count of the
    history's keys. ``columns`` may name those to keep; which copy of a key stays does not
    depend on it.
    """
    older = history.select(*batch.columns)
    if not history_unique:
        older = unique_rows(older, key, order_by, broadcast_rows)
    newer = unique_rows(batch, key, order_by, broadcast_rows)
    if columns is not None:
        older, newer = (t.select(*dict.fromkeys([key, *columns])) for t in (older, newer))
    # A missing key equals a missing key here, as when keeping the first of both.
    ids = newer.select(F.col(key).alias("_id"))
    if batch.count() <= broadcast_rows:
        older, is_written = _without(older, F.broadcast(ids), key), True
    else:
        older, is_written = _not_in(older, ids, key, broadcast_hashes)
    merged = newer.withColumn(SOURCE, F.lit(0)).unionByName(older.withColumn(SOURCE, F.lit(1)))
    return merged if is_written else stage(merged, "merged")


def _without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids, F.col(key).eqNullSafe(F.col("_id")), "left_anti")


def _shared(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The written keys that both have, found by the keys alone, with their hashes."""
    both = ids.join(rows.select(key), F.col(key).eqNullSafe(F.col("_id")), "left_semi")
    return stage(both.select("_id", F.xxhash64("_id").alias("_hash")), "shared-keys")


def rows_with_ids(rows: DataFrame, ids: DataFrame, key: str, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``rows`` of a written table whose key is among ``ids``, a table of distinct ``_id``; a missing key equals a missing key.

    Counted to be few enough, the hashes of the keys that both have are broadcast, and only rows of such a hash are
    shuffled and compared by key.
    """
    shared = _shared(rows, ids, key)
    same = F.col(key).eqNullSafe(F.col("_id"))
    if shared.count() <= broadcast_hashes:
        rows = rows.join(F.broadcast(shared.select("_hash").distinct()), F.xxhash64(key) == F.col("_hash"), "left_semi")
    return rows.join(shared.select("_id"), same, "left_semi")


def _not_in(rows: DataFrame, ids: DataFrame, key: str, broadcast_hashes: int) -> tuple[DataFrame, bool]:
    """``rows`` whose key is not among ``ids``, and whether they come without a shuffle of all rows.

    The keys that both have are found by their keys alone. Counted to be few enough, their hashes are broadcast: a row
    with another hash passes as it is, the others are compared by key.
    """
    shared = _shared(rows, ids, key)
    if shared.count() > broadcast_hashes:
        return _without(rows, ids, key), False
    hashes = F.broadcast(shared.select("_hash").distinct())
    same = F.xxhash64(key) == F.col("_hash")
    alike = rows.join(hashes, same, "left_semi")
    return rows.join(hashes, same, "left_anti").unionByName(_without(alike, shared.select("_id"), key)), True
