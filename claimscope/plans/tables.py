"""Prepared claims and kept history statistics, for reuse within one application."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators.lookup import BROADCAST_ROWS, HOT_SHARE
from claimscope.operators.prepare import prepare_claims
from claimscope.plans.history_store import HistoryStore
from claimscope.sources import star
from claimscope.sources.keyed_layout import HOT_ROWS, bucketed, frequent_keys
from claimscope.sources.staging import fingerprint, stage, staging_root, tasks_for

_RAW = {"all": star.all_tables, "batch": star.batch_tables, "history": star.history_tables}
_TABLES = ("customer", "lineitem", "orders", "supplier")
_kept: dict[tuple[str, str, str], tuple[str, Any]] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Any]) -> Any:
    """What ``make()`` gave for the tables as they are; they are looked at by name, size and time of their files."""
    now = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in _TABLES])
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept or _kept[key][0] != now:
        _kept[key] = (now, make())
    return _kept[key][1]


def _claim_lines(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The order lines of all claims, first copies joined to their orders once for all data sets.

    They are laid out and sorted by ``BeneID``, which lets the claims compress well, before the many columns of a claim are derived, so that only plain columns are
    shuffled and the join to the beneficiaries finds the claims in place. Lines of very frequent patients, and those
    without one, come as a second table whose join is left to Spark.
    """

    def make() -> list[DataFrame]:
        orders = star.table(spark, sf_dir, "orders").selectExpr(f"{star.CLAIM_EXPR['BeneID']} AS BeneID")
        hot = frequent_keys(orders, "BeneID", HOT_SHARE, HOT_ROWS)
        lines = star.claim_lines(spark, sf_dir)
        tasks = tasks_for(star.table(spark, sf_dir, "lineitem"), star.LINES_PER_TASK)
        if not hot and orders.filter("BeneID IS NULL").isEmpty():
            return [bucketed(lines, "BeneID", "lines", tasks, sort=True)]
        lines = stage(lines, "lines")
        is_apart = F.col("BeneID").isNull() | (F.col("BeneID").isin(list(hot)) if hot else F.lit(False))
        return [bucketed(lines.filter(~is_apart), "BeneID", "lines", tasks, sort=True), lines.filter(is_apart)]

    return once(spark, sf_dir, "lines", make)


def prepared(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """The merged claims of one data set, prepared and written on first use.

    With more patients than a broadcast takes, from order lines laid out by patient.
    """

    def make() -> DataFrame:
        raw = _RAW[which]
        if star.table(spark, sf_dir, "customer").count() <= BROADCAST_ROWS:
            return stage(prepare_claims(*raw(spark, sf_dir)), f"prepared-{which}")
        parts = [raw(spark, sf_dir, lines) for lines in _claim_lines(spark, sf_dir)]
        claims = [prepare_claims(*part, hashed=i == 0) for i, part in enumerate(parts)]
        return stage(reduce(DataFrame.unionByName, claims), f"prepared-{which}")

    return once(spark, sf_dir, which, make)


def kept_history(spark: SparkSession, sf_dir: str) -> HistoryStore:
    """The statistics of the prepared history, made and written on first use."""

    def make() -> HistoryStore:
        path = f"{staging_root(spark)}/kept-history-{uuid.uuid4().hex}"
        return HistoryStore.create(prepared(spark, sf_dir, "history"), path)

    return once(spark, sf_dir, "kept", make)
