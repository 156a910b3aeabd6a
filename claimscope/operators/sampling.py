"""Rows by position, by label, by range, and exact random samples.

Positions are a ``row_index`` column (0-based) given once by ``with_row_index``;
everything else filters on it.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.sources.staging import stage

ROW_INDEX = "row_index"
_POSITION_MASK = (1 << 33) - 1
# Random order is by hash; its first hex digits split the rows into about a million
# buckets, so only one bucket is ever ranked row by row.
_BUCKET_DIGITS = 5


def with_row_index(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add a 0-based ``row_index`` in the total order ``order_by``.

    Rows are range-partitioned and sorted within partitions; the written result keeps
    (partition, position), and each partition's start is the sum of the counts before.
    """
    placed = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
    )
    written = stage(placed, "row-index")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, so the single-task window and the broadcast are small.
    starts = (
        written.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    return written.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_pos")).alias(ROW_INDEX), *df.columns
    )


def preview(df: DataFrame, n: int = 100, order_by: Sequence[str] = (ROW_INDEX,)) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def first_rows(df: DataFrame, order_by: Sequence[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows in the total order ``order_by``, numbered; a top-k that leaves the rest unsorted."""
    position = F.row_number().over(Window.orderBy(*order_by)).cast("long") - 1
    return preview(df, n, order_by).select(position.alias(ROW_INDEX), *df.columns)


def row_count(df: DataFrame) -> int:
    return df.count()


def top(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows; a negative ``n`` means all but the last ``-n``."""
    end = n if n >= 0 else row_count(df) + n
    return df.filter(F.col(ROW_INDEX) < end)


def bottom(df: DataFrame, n: int) -> DataFrame:
    """Last ``n`` rows; a negative ``n`` means all but the first ``-n``."""
    start = row_count(df) - n if n >= 0 else -n
    return df.filter(F.col(ROW_INDEX) >= start)


def at_position(df: DataFrame, n: int) -> DataFrame:
    """The row at position ``n``, counted from the end when negative."""
    rows = row_count(df)
    if not -rows <= n < rows:
        raise IndexError(f"position {n} is out of range for {rows} rows")
    return df.filter(F.col(ROW_INDEX) == (n if n >= 0 else rows + n))


def at_label(df: DataFrame, n: int) -> DataFrame:
    """The row labelled ``n``; there are no negative labels."""
    found = df.filter(F.col(ROW_INDEX) == n)
    if found.isEmpty():
        raise KeyError(n)
    return found


def slice_positions(df: DataFrame, start: int, end: int) -> DataFrame:
    """Positions ``start`` to ``end``, end excluded; negatives count from the end."""
    if start < 0 or end < 0:
        rows = row_count(df)
        start = max(rows + start, 0) if start < 0 else start
        end = rows + end if end < 0 else end
    return df.filter((F.col(ROW_INDEX) >= start) & (F.col(ROW_INDEX) < end))


def between_labels(df: DataFrame, first: int, last: int) -> DataFrame:
    """Labels ``first`` to ``last``, both included; negatives are plain numbers."""
    return df.filter(F.col(ROW_INDEX).between(first, last))


def random_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Exactly ``n`` rows without replacement; the same seed gives the same rows.

    The sample is the first ``n`` rows in order of ``md5(seed-row_index)``, found
    without a global sort: whole hash buckets up to the one in which the n-th row
    lies, and the first rows of that one.
    """
    rows = row_count(df)
    if not 0 <= n <= rows:
        raise ValueError(f"cannot take {n} of {rows} rows without replacement")
    if n == 0:
        return df.limit(0)
    seed = random.getrandbits(63) if seed is None else seed
    label = F.concat(F.lit(f"{seed}-"), F.col(ROW_INDEX).cast("string"))
    hashed = df.withColumn("_hash", F.md5(label)).withColumn(
        "_bucket", F.substring("_hash", 1, _BUCKET_DIGITS)
    )
    so_far = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        hashed.groupBy("_bucket")
        .count()
        .withColumn("_upto", F.sum("count").over(so_far))
        .filter(F.col("_upto") >= n)
        .orderBy("_bucket")
        .first()
    )
    missing = n - (edge["_upto"] - edge["count"])
    last = hashed.filter(F.col("_bucket") == edge["_bucket"]).orderBy("_hash", ROW_INDEX).limit(missing)
    return hashed.filter(F.col("_bucket") < edge["_bucket"]).unionByName(last).drop("_hash", "_bucket")


def require_rows(sample: DataFrame) -> DataFrame:
    """The sample itself, or an error when it is empty."""
    if sample.isEmpty():
        raise ValueError("the chosen position or range holds no rows")
    return sample
