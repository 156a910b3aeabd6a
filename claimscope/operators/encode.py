"""One-hot levels and zero fill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from claimscope.functions.claims import named, quoted
from claimscope.schemas import onehot_name


def fit_levels(df: DataFrame, columns: Sequence[str], max_levels: int | None = None) -> dict:
    """Sorted distinct values per column, in one job; more than ``max_levels``, if given, is an error."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    seen = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value IS NOT NULL").distinct()
    typed = [F.when(F.col("column") == c, F.col("value")).cast(df.schema[c].dataType).alias(c) for c in columns]
    levels = {c: [] for c in columns}
    for row in seen.select("column", *typed).collect():
        levels[row["column"]].append(row[row["column"]])
    for column, found in levels.items():
        if max_levels is not None and len(found) > max_levels:
            raise ValueError(f"{column} has more than {max_levels} levels")
        found.sort()
    return levels


def one_hot(df: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """Add one 0/1 column per level but the first; NULL gives 0 everywhere."""
    flags = {
        onehot_name(column, level): F.coalesce((F.col(column) == level).cast("int"), F.lit(0))
        for column, values in levels.items()
        for level in values[1:]
    }
    return df.withColumns(flags)


def fill_zero(df: DataFrame) -> DataFrame:
    """NULL to 0 in numeric columns; text and dates keep their NULLs."""

    def filled(field) -> str:
        column = quoted(field.name)
        if isinstance(field.dataType, NumericType):
            zero = f"CAST(0 AS {field.dataType.simpleString()})"
            return named(f"coalesce({column}, {zero})", field.name)
        return column

    return df.selectExpr(*[filled(f) for f in df.schema])
