"""Tables laid out by a key, so that joins, dedup and lookups by that key shuffle nothing.

Rows are written once in buckets of the key, sorted within them. Two tables with the same number of
buckets meet bucket by bucket. Keys with a large share of the rows, and rows without a key, would
overfill a bucket: they are written apart, spread evenly, and meet the few other rows of their keys
map side.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators.keyed import SOURCE, keep_first
from claimscope.operators.lookup import BROADCAST_ROWS, HOT_SHARE
from claimscope.sources.staging import stage, staging_root, tasks_for, writing

# No key with fewer rows than this is written apart.
HOT_ROWS = 10_000
# Rows are first counted per slot of their key's hash; only the keys in slots with many rows are counted themselves.
SLOTS = 16_384


def frequent_keys(df: DataFrame, key: str, share: float, least: int) -> tuple:
    """The keys of a written table with more than ``least`` rows and more than ``share`` of all; no count per key is shuffled."""
    most = max(least, share * df.count())
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    keyed = df.filter(F.col(key).isNotNull())
    full = keyed.groupBy(slot.alias("slot")).count().filter(F.col("count") > most)
    slots = [r["slot"] for r in full.collect()]
    if not slots:
        return ()
    among = keyed.filter(slot.isin(slots)) if len(slots) < SLOTS // 8 else keyed
    return tuple(r[0] for r in among.groupBy(key).count().filter(F.col("count") > most).select(key).collect())


def bucketed(df: DataFrame, key: str, name: str, buckets: int, sort: bool = False) -> DataFrame:
    """``df`` written in buckets of ``key``, one task and one file per bucket; entered in the session's catalog."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-by-key-{uuid.uuid4().hex}"
    table = f"claimscope_{uuid.uuid4().hex}"
    with writing(df.repartition(buckets, key)) as writer:
        writer = writer.bucketBy(buckets, key)
        (writer.sortBy(key) if sort else writer).saveAsTable(table, format="parquet", path=path)
    return spark.table(table)


@dataclass(frozen=True)
class KeyedTable:
    """``rest`` in buckets of ``key``; ``apart`` holds the rows of the ``hot`` keys and those without a key."""

    key: str
    buckets: int
    rest: DataFrame
    apart: DataFrame
    hot: tuple
    has_missing: bool

    @classmethod
    def write(
        cls,
        df: DataFrame,
        key: str,
        name: str,
        buckets: int | None = None,
        hot_share: float = HOT_SHARE,
        hot_rows: int = HOT_ROWS,
    ) -> KeyedTable:
        """Lay out a written table below the staging folder; its key column is read once more for counts.

        A key is hot with more than ``hot_rows`` rows and more than ``hot_share`` of all, so there are
        at most ``1 / hot_share`` such keys. They alone come to the driver. Choose ``buckets`` so that
        one fits a task, as ``buckets_for`` does, and alike for tables that are to meet; the default is
        the session's number of shuffle partitions.
        """
        spark = df.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        hot = frequent_keys(df, key, hot_share, hot_rows)
        missing = not df.filter(F.col(key).isNull()).isEmpty()

        is_apart = F.col(key).isNull() | _is_in(key, hot)
        # A filter that keeps all rows would still copy their many columns one by one.
        rest = bucketed(df.filter(~is_apart) if hot or missing else df, key, name, buckets, sort=True)
        apart = stage(df.filter(is_apart) if hot or missing else df.limit(0), f"{name}-apart")
        return cls(key, buckets, rest, apart, hot, missing)

    def rows(self) -> DataFrame:
        return self.rest.unionByName(self.apart)

    def rows_of(self, keys: Sequence) -> DataFrame:
        """The rows of a few keys; only the buckets they are in are read. ``None`` stands for rows without a key."""
        given = [k for k in keys if k is not None]
        wanted = self.apart.filter(_is_in(self.key, given) | (F.col(self.key).isNull() & F.lit(None in keys)))
        return self.rest.filter(_is_in(self.key, given)).unionByName(wanted)

    def keep_first(self, order_by: Sequence[str | Column] | None = None) -> KeyedTable:
        """One row per key, as ``operators.keyed.keep_first``; rows without a key count as one key.

        A count per key within the buckets finds the repeated keys: whole rows are sorted only for those, if they are few.
        """
        return replace(
            self,
            rest=self._firsts(order_by),
            apart=keep_first(self.apart, self.key, order_by) if self.hot or self.has_missing else self.apart,
        )

    def _firsts(self, order_by: Sequence[str | Column] | None) -> DataFrame:
        per_key = self.rest.groupBy(self.key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        repeated = per_key.count()
        if repeated == 0:
            return self.rest
        if repeated > min(BROADCAST_ROWS, self.rest.count() // 100):
            return keep_first(self.rest, self.key, order_by)
        keys = F.broadcast(stage(per_key.select(self.key), "repeated"))
        singles = self.rest.join(keys, self.key, "left_anti")
        return singles.unionByName(keep_first(self.rest.join(keys, self.key, "left_semi"), self.key, order_by))

    def lookup(self, table: KeyedTable, how: str = "inner") -> DataFrame:
        """Inner or left join onto a table with one row per key; rows without a key find nothing."""
        self._check(table)
        values = table.rows().filter(F.col(self.key).isNotNull()) if table.hot else table.rest
        beside = F.broadcast(table.rows_of(self.hot))
        # Hashed per bucket: the rows of this table, which may be wide, are not sorted.
        values = values.hint("shuffle_hash")
        return self.rest.join(values, self.key, how).unionByName(self.apart.join(beside, self.key, how))

    def without(self, other: KeyedTable) -> KeyedTable:
        """The rows whose key ``other`` has not; a missing key equals a missing key."""
        self._check(other)
        key = F.col(self.key)
        rest = self.rest.join(other.rest.select(self.key).hint("shuffle_hash"), self.key, "left_anti")
        rest = rest.filter(~_is_in(self.key, other.hot))
        there = [r[0] for r in other.rows_of(self.hot).select(self.key).distinct().collect()]
        apart = self.apart.filter(
            F.when(key.isNull(), F.lit(not other.has_missing)).otherwise(~_is_in(self.key, there))
        )
        return replace(self, rest=rest, apart=apart)

    def _check(self, other: KeyedTable) -> None:
        if (self.key, self.buckets) != (other.key, other.buckets):
            raise ValueError("tables meet only on the same key with the same number of buckets")


def _is_in(key: str, values: Sequence) -> Column:
    return F.col(key).isin(list(values)) if values else F.lit(False)


def buckets_for(*tables: DataFrame) -> int:
    """Buckets that fit a task in each of some tables that are to meet."""
    return max(map(tasks_for, tables))


def merge_by_key(batch: KeyedTable, history: KeyedTable) -> DataFrame:
    """``keyed.merge_batch_history`` for tables laid out by their id: neither side is shuffled."""
    newer = batch.keep_first()
    older = replace(
        history,
        rest=history.rest.select(*batch.rest.columns),
        apart=history.apart.select(*batch.rest.columns),
    )
    older = older.keep_first().without(batch)
    return (
        newer.rows().withColumn(SOURCE, F.lit(0)).unionByName(older.rows().withColumn(SOURCE, F.lit(1)))
    )
