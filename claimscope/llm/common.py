"""Small helpers that the operators of this package share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.sources.staging import stage, staging_root

__all__ = ["bounded_batches", "byte_rows", "kept_in_worker", "let", "load", "stage", "staging_root", "unused_name", "whole_text"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let Python workers get long texts in batches that fit beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def whole_text(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def kept_in_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make()`` gave first in this Python worker; later tasks of the worker get the same object."""
    store = sys.modules.setdefault("_kept_in_worker", ModuleType("_kept_in_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def byte_rows(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a text column, null as no bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""
