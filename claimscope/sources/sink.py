"""Rows written by batch, each batch once.

    path/rows/attempt=<id>     what an attempt wrote
    path/commits/batch=<name>  which attempt counts for a batch, written last and in one piece

A batch that failed half way has no commit, so its rows do not count; writing it again starts a new attempt. A batch that is committed
is not written again. Readers follow the commits.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.sources.staging import writing


class BatchSink:
    """A table below ``path`` that grows by named batches, one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _committed(self) -> dict[str, str]:
        try:
            rows = self.spark.read.schema("name string, attempt string").parquet(f"{self.path}/commits/*").collect()
        except AnalysisException:
            return {}
        return {r.name: r.attempt for r in rows}

    def write(self, rows: DataFrame, batch: str) -> bool:
        """Write the rows of a batch; False when the batch is there already."""
        if batch in self._committed():
            return False
        attempt = uuid.uuid4().hex
        with writing(rows) as writer:
            writer.parquet(f"{self.path}/rows/attempt={attempt}")
        commit = self.spark.createDataFrame([(batch, attempt)], "name string, attempt string").coalesce(1)
        commit.write.mode("overwrite").parquet(f"{self.path}/commits/batch={quote(batch, safe='')}")
        return True

    def read(self, *batches: str) -> DataFrame:
        """The rows of the committed batches, or of some of them, with ``batch``."""
        committed = {b: a for b, a in self._committed().items() if not batches or b in batches}
        if not committed:
            raise ValueError(f"{self.path} has no such batch")
        paths = [f"{self.path}/rows/attempt={a}" for a in committed.values()]
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*paths)
        names = self.spark.createDataFrame([(a, b) for b, a in committed.items()], "attempt string, batch string")
        return rows.join(F.broadcast(names), "attempt").drop("attempt")
