"""A table written in order, with a directory that leads from positions to files.

The table is range-partitioned and sorted by its order columns and written with a folder per range partition and each row's place in it. The
directory, one row per partition with its first position and row count, is kept with the table and read by the driver. A pick by position becomes a range of
partitions and of places in the outermost ones; the scan gets both, so it opens only the files that hold the rows asked for.
"""

from __future__ import annotations

import bisect
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from claimscope.operators.lookup import BROADCAST_ROWS
from claimscope.operators.sampling import ROW_INDEX
from claimscope.sources.staging import stage, tasks_for

PART, PLACE = "_part", "_place"
_PLACE_MASK = (1 << 33) - 1
_BUCKET_DIGITS = 5
# Hex digits of a hash that read as a number, and how far beyond the expected number of positions candidates reach.
_LEADING_DIGITS, _DEVIATIONS = 13, 8
# No partition is made for fewer rows.
_LEAST_ROWS = 1000


@dataclass(frozen=True)
class PositionIndex:
    """Rows at 0-based positions in a total order; ``starts[i]`` is the first position of range partition ``parts[i]``."""

    rows: DataFrame
    parts: list[int]
    starts: list[int]
    total: int

    @classmethod
    def write(cls, df: DataFrame, order_by: Sequence[str], path: str, partitions: int | None = None) -> PositionIndex:
        """Write ``df``, itself a written table, in the order of ``order_by``; rows that agree in it go by their place in ``df``.

        That place also splits an order key which many rows share over several partitions. Without ``partitions``, each has about as
        many rows as a task sorts in memory.
        """
        partitions = partitions or max(1, min(tasks_for(df), df.count() // _LEAST_ROWS))
        tied = df.withColumn("_tie", F.monotonically_increasing_id())
        order = [*order_by, "_tie"]
        spread = tied.repartitionByRange(partitions, *order)
        placed = spread.sortWithinPartitions(*order).drop("_tie").withColumns(
            {PART: F.spark_partition_id(), PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_MASK))}
        )
        placed.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
        spark = df.sparkSession
        counts = spark.read.schema(_placed_schema(df)).parquet(f"{path}/rows").groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")
        return cls.read(spark, path, df)

    @classmethod
    def read(cls, spark: SparkSession, path: str, like: DataFrame) -> PositionIndex:
        """The index at ``path`` of a table with the columns of ``like``."""
        directory = sorted(tuple(r) for r in spark.read.parquet(f"{path}/directory").select(PART, "n").collect())
        starts, total = [], 0
        for _, n in directory:
            starts.append(total)
            total += n
        return cls(spark.read.schema(_placed_schema(like)).parquet(f"{path}/rows"), [p for p, _ in directory], starts, total)

    # -------------------------------------------------------------- whole table
    def frame(self) -> DataFrame:
        """All rows with their ``row_index``."""
        spark = self.rows.sparkSession
        starts = spark.createDataFrame(list(zip(self.parts, self.starts)), f"{PART} int, _start long")
        # One row per range partition.
        return self._numbered(self.rows.join(F.broadcast(starts), PART), F.col("_start"))

    def _numbered(self, rows: DataFrame, start) -> DataFrame:
        return rows.select(
            (start + F.col(PLACE)).alias(ROW_INDEX), *[c for c in self.rows.columns if c not in (PART, PLACE)]
        )

    def _range(self, first: int, end: int) -> DataFrame:
        """Positions from ``first`` up to ``end``, end excluded; those that do not exist are left out."""
        first, end = max(first, 0), min(end, self.total)
        if first >= end:
            return self._numbered(self.rows.limit(0), F.lit(0).cast("long"))
        low, high = (bisect.bisect_right(self.starts, p) - 1 for p in (first, end - 1))
        rows = self.rows.filter(F.col(PART).between(self.parts[low], self.parts[high]))
        from_place, to_place = first - self.starts[low], end - self.starts[high]
        if low == high:
            rows = rows.filter((F.col(PLACE) >= from_place) & (F.col(PLACE) < to_place))
            return self._numbered(rows, F.lit(self.starts[low]).cast("long"))
        rows = rows.filter((F.col(PART) != self.parts[low]) | (F.col(PLACE) >= from_place))
        rows = rows.filter((F.col(PART) != self.parts[high]) | (F.col(PLACE) < to_place))
        spark = self.rows.sparkSession
        starts = list(zip(self.parts[low : high + 1], self.starts[low : high + 1]))
        return self._numbered(rows.join(F.broadcast(spark.createDataFrame(starts, f"{PART} int, _start long")), PART), F.col("_start"))

    # -------------------------------------------------------------------- picks
    def top(self, n: int) -> DataFrame:
        """First ``n`` rows; a negative ``n`` means all but the last ``-n``."""
        return self._range(0, n if n >= 0 else self.total + n)

    def bottom(self, n: int) -> DataFrame:
        """Last ``n`` rows; a negative ``n`` means all but the first ``-n``."""
        return self._range(self.total - n if n >= 0 else -n, self.total)

    def at_position(self, n: int) -> DataFrame:
        """The row at position ``n``, counted from the end when negative."""
        if not -self.total <= n < self.total:
            raise IndexError(f"position {n} is out of range for {self.total} rows")
        at = n if n >= 0 else self.total + n
        return self._range(at, at + 1)

    def at_label(self, n: int) -> DataFrame:
        """The row labelled ``n``; there are no negative labels."""
        if not 0 <= n < self.total:
            raise KeyError(n)
        return self._range(n, n + 1)

    def slice_positions(self, start: int, end: int) -> DataFrame:
        """Positions ``start`` to ``end``, end excluded; negatives count from the end."""
        start = max(self.total + start, 0) if start < 0 else start
        return self._range(start, self.total + end if end < 0 else end)

    def between_labels(self, first: int, last: int) -> DataFrame:
        """Labels ``first`` to ``last``, both included; negatives are plain numbers."""
        return self._range(first, last + 1)

    def random_rows(self, n: int, seed: int | None = None) -> DataFrame:
        """Exactly ``n`` rows without replacement, the first in order of ``md5(seed-row_index)``.

        The order needs the positions alone, no row. Those with the lowest hashes, some more than ``n``, are written as candidates. Of
        these, whole hash buckets are taken up to the one in which the n-th position lies, and that one is ranked; then the rows of the
        chosen positions are looked up in their partitions.
        """
        if not 0 <= n <= self.total:
            raise ValueError(f"cannot take {n} of {self.total} rows without replacement")
        if n == 0:
            return self._range(0, 0)
        seed = random.getrandbits(63) if seed is None else seed
        hashed = self._lowest(n, seed)
        hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, _BUCKET_DIGITS))
        so_far = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        upto = hashed.groupBy("_bucket").count().withColumn("_upto", F.sum("count").over(so_far))
        edge = upto.filter(F.col("_upto") >= n).orderBy("_bucket").first()
        missing = n - (edge["_upto"] - edge["count"])
        last = hashed.filter(F.col("_bucket") == edge["_bucket"]).orderBy("_hash", "id").limit(missing)
        chosen = hashed.filter(F.col("_bucket") < edge["_bucket"]).unionByName(last).select("id")
        return self._looked_up(chosen, n)

    def _lowest(self, n: int, seed: int) -> DataFrame:
        """At least ``n`` positions with their hashes, written: all whose hash is below a bound."""
        spark = self.rows.sparkSession
        label = F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))
        hashed = spark.range(self.total).withColumn("_hash", F.md5(label))
        wanted = n
        while True:
            wanted = wanted + _DEVIATIONS * (math.sqrt(wanted) + 1)
            if wanted >= self.total:
                return hashed
            bound = f"{int(wanted / self.total * 16**_LEADING_DIGITS):0{_LEADING_DIGITS}x}"
            found = stage(hashed.filter(F.col("_hash") < bound), "lowest")
            if found.count() >= n:
                return found

    def _looked_up(self, positions: DataFrame, n: int) -> DataFrame:
        """The rows at ``positions``, a column ``id`` of ``n`` distinct existing ones."""
        spark = self.rows.sparkSession
        ends = [*self.starts[1:], self.total]
        # Positions and partitions meet by stretches as long as a partition on average; the directory has about two rows per partition.
        stretch = -(-self.total // len(self.parts))
        ranges = spark.createDataFrame(list(zip(self.parts, self.starts, ends)), f"{PART} int, _start long, _end long")
        ranges = ranges.filter("_end > _start").selectExpr("*", f"explode(sequence(_start div {stretch}, (_end - 1) div {stretch})) AS _stretch")
        inside = (F.col("id") >= F.col("_start")) & (F.col("id") < F.col("_end"))
        met = positions.withColumn("_stretch", F.expr(f"id div {stretch}")).join(F.broadcast(ranges), "_stretch").filter(inside)
        wanted = met.select(PART, (F.col("id") - F.col("_start")).alias(PLACE), "_start")
        used = [r[0] for r in wanted.select(PART).distinct().collect()]
        # Counted to be few, the positions are broadcast, and no row is shuffled.
        wanted = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
        return self._numbered(self.rows.filter(F.col(PART).isin(used)).join(wanted, [PART, PLACE]), F.col("_start"))


def _placed_schema(like: DataFrame) -> StructType:
    return StructType([*like.schema.fields, StructField(PLACE, LongType()), StructField(PART, IntegerType())])
