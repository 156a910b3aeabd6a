"""Left join of many rows onto a table with one row per key, safe under hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.sources.staging import stage

# A key is hot when it holds more than this share of the rows looked up. At most
# 1 / HOT_SHARE keys can be, which bounds what is broadcast whatever the data.
HOT_SHARE = 1e-3
# A whole table is broadcast only when counted to have no more rows than this.
BROADCAST_ROWS = 100_000


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def has_key(keys: list[str]) -> Column:
    return all_of([F.col(k).isNotNull() for k in keys])


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    total: int,
    how: str = "left",
    share: float = HOT_SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``rows`` joined (left or inner) to ``table`` on ``keys``; NULL keys find nothing.

    ``table`` is a written table with one row per key. Its ``weight`` column, dropped
    from the result, counts the ``rows`` that carry the key, out of ``total`` rows per
    set of keys. A table counted to be small is broadcast. Otherwise rows with a hot
    key meet it map side in a broadcast of bounded size, rows with a NULL key need no
    partner, and only the rest is shuffled, where no key holds more than ``share`` of
    the rows.
    """
    values = table.drop(weight)
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(values), keys, how)

    is_hot = F.col(weight) > F.lit(share * total)
    hot = F.broadcast(table.filter(is_hot).drop(weight).withColumn("_hot", F.lit(True)))
    map_side = rows.join(hot, keys, how)
    if how == "left":
        map_side = map_side.filter(F.col("_hot").isNotNull() | ~has_key(keys))
    shuffled = (
        rows.filter(has_key(keys))
        .join(hot.select(*keys), keys, "left_anti")
        .join(table.filter(~is_hot).drop(weight), keys, how)
    )
    return map_side.drop("_hot").unionByName(shuffled)


def skew_safe_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    share: float = HOT_SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``lookup_join`` onto a written table whose keys' weights are not known yet.

    A table too large to broadcast is first joined to the number of ``rows`` per key
    (a count with map-side partial sums) and written with it.
    """
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(table), key, how)
    counts = rows.filter(has_key([key])).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    weighted = stage(table.join(counts, key), "weighted")
    total = weighted.agg(F.sum("_rows")).first()[0] or 0
    return lookup_join(rows, weighted, [key], "_rows", total, how, share, broadcast_rows=0)


def id_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    share: float = HOT_SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left ``skew_safe_join`` in which a missing key equals a missing key.

    ``table`` is a written table with one row per key, so at most one without; that row is broadcast.
    """
    found = skew_safe_join(
        rows.filter(has_key([key])), table, key, share=share, broadcast_rows=broadcast_rows
    )
    missing = table.filter(~has_key([key])).withColumnRenamed(key, "_id")
    same = F.col(key).eqNullSafe(F.col("_id"))
    rest = rows.filter(~has_key([key])).join(F.broadcast(missing), same, "left").drop("_id")
    return found.unionByName(rest)
