"""Group means and group counts kept per row.

A group feature is an aggregate over all claims with the same key, brought back to
each claim. A NULL in any key part means no group and a NULL feature.

One key set: ``group_means`` / ``group_count`` aggregate (with map-side partial sums)
and look the result up again. Many key sets: ``keyed_table`` turns every claim into
one thin row per key set in a single pass, so that all key sets share one scan, one
partial aggregation and one shuffle; ``attach`` turns batch claims into the same
thin rows, finds their group values and folds them into one row per claim.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from claimscope.functions.claims import named, quoted
from claimscope.operators.lookup import BROADCAST_ROWS, HOT_SHARE, has_key, lookup_join
from claimscope.sources.staging import stage

ROW_ID = "ClaimID"
IN_BATCH = "in_batch"
HAS_ID = "has_id"
# Claims that are grouped by all key sets in one task, and the fewest that a first key has to hold to be grouped apart.
CLAIMS_PER_TASK = 50_000
# The values of so many claims, at most one per claim and key set, are hashed in one task.
CLAIMS_PER_HASH = 20_000
HOT_CLAIMS = 10_000
# Up to this many key sets, each is counted by a window of its own over the claims, which sorts them once more; beyond, all by one over thin rows.
WINDOW_SETS = 8


def has_id() -> Column:
    """Whether a claim counts: one without an id gets its group's count but adds nothing to it."""
    return F.col(ROW_ID).isNotNull()


# ------------------------------------------------------------- one key set
def _kept_per_row(
    df: DataFrame, keys: Sequence[str], aggregates: list[Column], **limits
) -> DataFrame:
    keys = list(keys)
    table = stage(
        df.filter(has_key(keys))
        .groupBy(*keys)
        .agg(*aggregates, F.count(F.lit(1)).alias("_rows")),
        "group-" + "-".join(keys),
    )
    total = table.agg(F.sum("_rows")).first()[0] or 0
    return lookup_join(df, table, keys, "_rows", total, **limits)


def group_means(
    df: DataFrame, keys: Sequence[str], names: Mapping[str, str], **limits
) -> DataFrame:
    """Add group means: ``names`` maps each output column to its measure.

    Means skip NULLs; a group with no value at all has mean NULL.
    """
    means = [F.avg(measure).alias(name) for name, measure in names.items()]
    return _kept_per_row(df, keys, means, **limits)


def group_count(
    df: DataFrame, keys: Sequence[str], name: str, counted: str = ROW_ID, **limits
) -> DataFrame:
    """Add the number of non-null ``counted`` values in the row's group."""
    return _kept_per_row(df, keys, [F.count(counted).alias(name)], **limits)


# ----------------------------------------------------------- many key sets
@dataclass(frozen=True)
class KeySet:
    """One grouping by its key columns."""

    keys: tuple[str, ...]


class KeyPlan:
    """Key sets that share one pass over the claims."""

    def __init__(self, sets: Sequence[KeySet], chosen: set[int] | None = None):
        self.sets = list(sets)
        self.chosen = chosen
        self.parts = [f"key_{i}" for i in range(max(len(s.keys) for s in self.sets))]
        self.columns = ["set_id", *self.parts]
        firsts = {s.keys[0] for s in self.sets}
        # The first key column, where all sets have the same one and more beside it.
        self.lead = firsts.pop() if len(firsts) == 1 and len(self.parts) > 1 else None

    def only(self, chosen: set[int]) -> KeyPlan:
        """The same plan, making rows for some of its sets."""
        return KeyPlan(self.sets, chosen)

    def _entry(self, set_id: int, key_set: KeySet, made: Sequence[str]) -> str:
        parts = [f"CAST({quoted(k)} AS STRING)" for k in key_set.keys]
        # Within a set all tuples have the same padding, so '' cannot clash with a key.
        parts += ["''"] * (len(self.parts) - len(parts))
        fields = ", ".join(f"'{n}', {p}" for n, p in zip(self.parts, parts) if n in made)
        return f"named_struct('set_id', {set_id}, {fields})"

    def melt(self, df: DataFrame, *carry: str) -> DataFrame:
        """One row per claim and key set whose key has no NULL part."""
        return self._melt(df, self.parts, *carry)

    def _melt(self, df: DataFrame, made: Sequence[str], *carry: str) -> DataFrame:
        entries = ", ".join(
            self._entry(i, s, made)
            for i, s in enumerate(self.sets)
            if self.chosen is None or i in self.chosen
        )
        melted = df.selectExpr(*map(quoted, carry), f"inline(array({entries}))")
        return melted.filter(has_key(self.parts))

    def melt_beside(self, df: DataFrame, *carry: str) -> DataFrame:
        """``melt`` of claims that hold ``key_0`` as a column already, which stays one: their partitioning by it is kept."""
        return self._melt(df, self.parts[1:], *carry, self.parts[0])


def _leads(
    claims: DataFrame, lead: Column, share: float, hot_claims: int, claims_per_task: int
) -> tuple[list[str], int, int]:
    """First keys whose claims would overfill a task, the number of tasks for all others, and the claims of the former."""
    counts = stage(claims.filter(lead.isNotNull()).groupBy(lead.alias("lead")).agg(F.count(F.lit(1)).alias("n")), "leads")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter((F.col("n") > hot_claims) & (F.col("n") > share * total)).select("lead", "n").collect()
    tasks = max(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / claims_per_task))
    return [r["lead"] for r in hot], tasks, sum(r.n for r in hot)


def dealt(claims: DataFrame, plan: KeyPlan, columns: Sequence[str], hot: Sequence[str], tasks: int) -> DataFrame:
    """``columns`` and the key columns of the claims with a first key that is not ``hot``, shuffled by it, as ``key_0``, alone."""
    keys = [k for i, s in enumerate(plan.sets) if plan.chosen is None or i in plan.chosen for k in s.keys]
    used = [c for c in dict.fromkeys([*columns, *keys]) if c != plan.lead or c in columns]
    claims = claims.select(*used, F.col(plan.lead).cast("string").alias(plan.parts[0])).filter(has_key(plan.parts[:1]))
    return not_hot(claims, plan, hot).repartition(tasks, plan.parts[0])


def not_hot(rows: DataFrame, plan: KeyPlan, hot: Sequence[str]) -> DataFrame:
    """Rows with ``key_0`` that is not among the ``hot`` first keys."""
    return rows.filter(~F.col(plan.parts[0]).isin(list(hot))) if hot else rows


def per_key(
    claims: DataFrame,
    plan: KeyPlan,
    aggregates: Sequence[Column],
    carry: Sequence[str] = (),
    share: float = HOT_SHARE,
    hot_claims: int = HOT_CLAIMS,
    claims_per_task: int = CLAIMS_PER_TASK,
) -> DataFrame:
    """``aggregates`` over the columns of ``carry`` per (key set, key) of written claims.

    Where all sets share their first key, the claims themselves are shuffled by it, once, and every set is grouped
    where they lie: a claim moves as one row, not as one per set. First keys with many claims would overfill a task;
    at most ``1 / share`` can be, and theirs are grouped by all key parts, with map-side partial results.
    """
    if plan.lead is None:
        return plan.melt(claims, *carry).groupBy(*plan.columns).agg(*aggregates)
    hot, tasks = leads(claims, plan, share, hot_claims, claims_per_task)
    grouped = per_key_beside(claims, plan, aggregates, carry, hot, tasks)
    return grouped.unionByName(per_hot_key(claims, plan, aggregates, carry, hot)) if hot else grouped


def leads(
    claims: DataFrame,
    plan: KeyPlan,
    share: float = HOT_SHARE,
    hot_claims: int = HOT_CLAIMS,
    claims_per_task: int = CLAIMS_PER_TASK,
) -> tuple[list[str], int]:
    """First keys whose claims would overfill a task, and the number of tasks for all others."""
    return _leads(claims, F.col(plan.lead).cast("string"), share, hot_claims, claims_per_task)[:2]


def per_key_beside(
    claims: DataFrame, plan: KeyPlan, aggregates: Sequence[Column], carry: Sequence[str], hot: Sequence[str], tasks: int
) -> DataFrame:
    """``per_key`` for the first keys that are not ``hot``; the result lies in ``tasks`` partitions by ``key_0``."""
    return plan.melt_beside(dealt(claims, plan, carry, hot, tasks), *carry).groupBy(*plan.columns).agg(*aggregates)


def per_hot_key(
    claims: DataFrame, plan: KeyPlan, aggregates: Sequence[Column], carry: Sequence[str], hot: Sequence[str]
) -> DataFrame:
    """``per_key`` for the ``hot`` first keys, grouped by all key parts."""
    apart = claims.filter(F.col(plan.lead).cast("string").isin(list(hot)))
    return plan.melt(apart, *carry).groupBy(*plan.columns).agg(*aggregates)


def keyed_table(
    claims: DataFrame,
    plan: KeyPlan,
    aggregates: Mapping[str, Column],
    value: str,
    carry: Sequence[str] = (),
    only_keys_of: DataFrame | None = None,
) -> DataFrame:
    """One ``value`` per (key set, key) over all claims, for the keys the batch has.

    ``value`` is SQL text over the named ``aggregates``, which may use the columns of
    ``carry``; ``claims`` has a boolean ``in_batch``. ``only_keys_of`` may name the batch
    claims when their number is known to be small: rows of other keys are then dropped
    map side, before any shuffle.
    """
    columns = [*[c.alias(n) for n, c in aggregates.items()], F.count_if(IN_BATCH).alias("_rows")]
    if only_keys_of is not None:
        wanted = plan.melt(only_keys_of).distinct()
        melted = plan.melt(claims, IN_BATCH, *carry).join(F.broadcast(wanted), plan.columns, "left_semi")
        grouped = melted.groupBy(*plan.columns).agg(*columns)
    else:
        grouped = per_key(claims, plan, columns, [IN_BATCH, *carry])
    return stage(grouped.filter("_rows > 0").selectExpr(*plan.columns, f"{value} AS value", "_rows"), "keyed")


def _direct_sets(table: DataFrame, plan: KeyPlan, budget: int) -> list[int]:
    """Single-key sets to broadcast whole: the smallest, within ``budget`` rows in all."""
    sizes = table.groupBy("set_id").count().orderBy("count", "set_id").collect()
    chosen = []
    for set_id, size in sizes:
        if len(plan.sets[set_id].keys) == 1:
            budget -= size
            if budget < 0:
                break
            chosen.append(set_id)
    return chosen


def _fold(found: DataFrame, texts: Mapping[int, str], by: Sequence[str]) -> DataFrame:
    """Thin rows with ``set_id`` and ``value`` to one row per claim, with a column per key set."""
    return found.groupBy(*by).agg(*[F.expr(_only(i, found)).alias(name) for i, name in texts.items()])


def _looked_up(
    rows: DataFrame,
    table: DataFrame,
    plan: KeyPlan,
    texts: Mapping[int, str],
    n_rows: int,
    share: float,
    broadcast_rows: int,
    row_id: str,
) -> DataFrame:
    """The values of ``table`` per ``row_id``, looked up as thin rows."""
    found = lookup_join(
        plan.melt(rows, row_id), table, plan.columns, "_rows", n_rows, "inner", share, broadcast_rows
    )
    # Thin rows are brought together first: folded map side, each would be as wide as the result.
    return _fold(found.select(row_id, "set_id", "value").repartition(row_id), texts, [row_id])


def _looked_up_beside(
    rows: DataFrame,
    table: DataFrame,
    plan: KeyPlan,
    texts: Mapping[int, str],
    share: float,
    broadcast_rows: int,
    row_id: str,
    hot_claims: int = HOT_CLAIMS,
    claims_per_task: int = CLAIMS_PER_HASH,
) -> DataFrame:
    """``_looked_up`` for sets that share their first key: rows and table are shuffled by it, and thin rows are made, find their values and are folded where they lie."""
    hot, tasks, n_hot = _leads(rows, F.col(plan.lead).cast("string"), share, hot_claims, claims_per_task)
    place = plan.parts[0]
    thin = plan.melt_beside(dealt(rows, plan, [row_id], hot, tasks), row_id)
    values = not_hot(table, plan, hot).drop("_rows").repartition(tasks, place)
    # Written, as only then the tables surely meet where they lie, and their shuffles go from the disks at once.
    folded = stage(_fold(join_beside(thin, values, plan, "inner", hashed=True), texts, [place, row_id]).drop(place), "folded", beside=True)
    if not hot:
        return folded
    is_hot = F.col(plan.lead).cast("string").isin(hot)
    of_hot = table.filter(F.col(place).isin(hot))
    return folded.unionByName(_looked_up(rows.filter(is_hot), of_hot, plan, texts, n_hot, share, broadcast_rows, row_id))


def join_beside(rows: DataFrame, table: DataFrame, plan: KeyPlan, how: str, hashed: bool = False) -> DataFrame:
    """Inner or left join by (key set, key) of two tables that lie in the same number of partitions by ``key_0``.

    Written by ``stage(beside=True)``, it shuffles nothing. ``hashed`` is for a side known to fit the memory of a task: the
    ``table`` of an inner join, the ``rows`` of a left one. It is hashed and the other read once, unsorted.
    """
    if hashed and how == "left":
        return rows.hint("shuffle_hash").join(table, plan.columns, how)
    if hashed:
        return rows.join(table.hint("shuffle_hash"), plan.columns, how)
    # Sorted by a number first, which compares faster than the keys.
    number = F.xxhash64(*plan.columns)
    return rows.withColumn("_hash", number).join(table.withColumn("_hash", number), ["_hash", *plan.columns], how).drop("_hash")


def _with_folded(rows: DataFrame, folded: DataFrame, row_id: str, prefix: str) -> DataFrame:
    """``rows`` with the columns of ``folded``; the one claim without an id finds its own values, as in the direct joins."""
    folded = folded.withColumnRenamed(row_id, f"{prefix}_id")
    return rows.join(folded, F.col(row_id).eqNullSafe(F.col(f"{prefix}_id")), "left").drop(f"{prefix}_id")


def attach(
    rows: DataFrame,
    table: DataFrame,
    plan: KeyPlan,
    n_rows: int,
    prefix: str,
    share: float = HOT_SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
    row_id: str = ROW_ID,
) -> tuple[DataFrame, dict[int, str]]:
    """``rows`` with the group values of ``table``, and SQL text for each set's value.

    ``rows`` has a unique ``row_id``, of which one may be NULL. Single-key sets counted to be small are broadcast and
    joined map side. The others are looked up as thin rows, which are shuffled once by ``row_id`` and folded into one
    column per key set. New columns start with ``prefix``. A value is NULL for a claim without the complete key.
    """
    direct = _direct_sets(table, plan, broadcast_rows)
    wide, texts = rows, {}
    others = [i for i in range(len(plan.sets)) if i not in direct]
    if others:
        for set_id in others:
            texts[set_id] = f"{prefix}_{set_id}"
        chosen = plan.only(set(others))
        rest = table.filter(~F.col("set_id").isin(direct)) if direct else table
        if plan.lead is None or rest.count() <= broadcast_rows:
            folded = _looked_up(rows, rest, chosen, texts, n_rows, share, broadcast_rows, row_id)
        else:
            folded = _looked_up_beside(rows, rest, chosen, texts, share, broadcast_rows, row_id)
        wide = _with_folded(rows, folded, row_id, prefix)

    # Map-side values come last: the shuffle by id would move them with every row.
    for set_id in direct:
        column, part = f"{prefix}_{set_id}", f"{prefix}_key"
        values = table.filter(F.col("set_id") == set_id).selectExpr(
            f"key_0 AS {part}", f"value AS {column}"
        )
        same = F.expr(f"CAST({quoted(plan.sets[set_id].keys[0])} AS STRING) = {part}")
        wide = wide.join(F.broadcast(values), same, "left").drop(part)
        texts[set_id] = column
    return wide, texts


def attach_counts(
    claims: DataFrame,
    plan: KeyPlan,
    prefix: str,
    share: float = HOT_SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
    row_id: str = ROW_ID,
    hot_claims: int = HOT_CLAIMS,
    claims_per_task: int = CLAIMS_PER_TASK,
) -> tuple[DataFrame, dict[int, str]]:
    """``claims`` with the number of claims in each of their groups, and SQL text for each set's count.

    For claims that are all looked up, with the columns ``has_id`` and ``in_batch``, and sets that share their first key: they are
    shuffled by it, once, and every set is counted where they lie, so nothing is looked up. With many sets only ids and
    keys are shuffled so, and the counts are joined by ``row_id``. Claims of first keys with many claims go by ``attach``,
    those without one have no counts.
    """
    lead = F.col(plan.lead).cast("string")
    hot, tasks, n_hot = _leads(claims, lead, share, hot_claims, claims_per_task)
    texts = {i: f"{prefix}_{i}" for i in range(len(plan.sets))}
    is_hot = lead.isin(hot) if hot else F.lit(False)

    def of_hot() -> DataFrame:
        apart = claims.filter(is_hot)
        table = keyed_table(apart, plan, {"n": F.count_if(HAS_ID)}, "n", [HAS_ID])
        return attach(apart, table, plan, n_hot, prefix, share, broadcast_rows, row_id)[0]

    if len(plan.sets) > WINDOW_SETS:
        # Thin rows are made, sorted once for all sets, counted and folded where the claims lie.
        thin = plan.melt_beside(dealt(claims, plan, [row_id, HAS_ID], hot, tasks), row_id, HAS_ID)
        group = Window.partitionBy("_hash", *plan.columns)
        thin = thin.withColumn("_hash", F.xxhash64(*plan.columns)).withColumn("value", F.count_if(HAS_ID).over(group))
        folded = _fold(thin, texts, [plan.parts[0], row_id]).drop(plan.parts[0])
        if hot:
            folded = folded.unionByName(of_hot().select(row_id, *texts.values()))
        return _with_folded(claims, folded, row_id, prefix), texts
    counted = claims.filter(lead.isNotNull() & ~is_hot).repartition(tasks, plan.lead)
    for i, key_set in enumerate(plan.sets):
        keys = list(key_set.keys)
        # Sorted by a number first, which compares faster than the keys.
        group = Window.partitionBy("_hash", *keys)
        counted = counted.withColumn("_hash", F.xxhash64(*keys))
        counted = counted.withColumn(texts[i], F.when(has_key(keys), F.count_if(HAS_ID).over(group))).drop("_hash")
    none = {name: F.lit(None).cast("long") for name in texts.values()}
    found = counted.unionByName(claims.filter(lead.isNull()).withColumns(none))
    return (found.unionByName(of_hot()) if hot else found), texts


def _only(set_id: int, table: DataFrame) -> str:
    """The one value of a key set among the rows of a claim."""
    value = f"CASE WHEN set_id = {set_id} THEN value END"
    is_number = isinstance(table.schema["value"].dataType, NumericType)
    return f"max({value})" if is_number else f"first({value}, true)"


def group_counts(
    claims: DataFrame, key_sets: Mapping[str, Sequence[str]], **limits
) -> DataFrame:
    """Add claim counts for many key sets at once.

    ``key_sets`` maps each output column to its key columns. Every row counts, also those that repeat a claim id. Rows
    are told apart by their id; a table that repeats ids (found by a count per id) is written with a number per row.
    """
    rows, row_id = claims, ROW_ID
    per_id = claims.groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("n"))
    if not per_id.filter("n > 1").isEmpty():
        row_id = "_row"
        rows = stage(claims.withColumn(row_id, F.monotonically_increasing_id()), "numbered")
    plan = KeyPlan([KeySet(tuple(k)) for k in key_sets.values()])
    marked = rows.withColumns({IN_BATCH: F.lit(True), HAS_ID: has_id()})
    if plan.lead is not None:
        found, texts = attach_counts(marked, plan, "_count", row_id=row_id, **limits)
        return found.selectExpr(*map(quoted, claims.columns), *[named(texts[i], name) for i, name in enumerate(key_sets)])
    table = keyed_table(marked, plan, {"n": F.count_if(HAS_ID)}, "n", [HAS_ID])
    found, texts = attach(rows, table, plan, rows.count(), "_count", row_id=row_id, **limits)
    counts = [named(texts[i], name) for i, name in enumerate(key_sets)]
    return found.selectExpr(*map(quoted, claims.columns), *counts)
