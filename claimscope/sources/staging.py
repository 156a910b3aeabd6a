"""Written intermediate tables.

A result that several later jobs read is written once as Parquet below
``spark.checkpoint.dir`` and read back: later scans prune columns and rows, see real
sizes, and a lost executor costs no recomputation of what came before.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_local_roots: dict[str, str] = {}
# So many wide rows can be sorted in the memory of a task.
ROWS_PER_TASK = 100_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def staging_root(spark: SparkSession) -> str:
    """The shared folder for written tables.

    Only a local session without ``spark.checkpoint.dir`` gets a temporary folder of
    its own. Written tables stay, as checkpoints do; the owner of the folder expires them.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if master not in _local_roots:
        _local_roots[master] = tempfile.mkdtemp(prefix="claimscope-")
    return _local_roots[master]


@contextmanager
def writing(df: DataFrame, beside: bool = False) -> Iterator[DataFrameWriter]:
    """A writer of closely packed Parquet; what the write shuffled goes from the disks when it is done.

    Otherwise the shuffle files of every write stay until the driver happens to collect its garbage. With ``beside``, tables
    that lie in the same number of partitions by some of the keys of a join are joined where they lie.
    """
    conf = df.sparkSession.conf
    settings = {_CLEANUP: "true"} | ({_ALL_KEYS: "false"} if beside else {})
    kept = {name: conf.get(name, None) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        yield df.write.option("compression", "zstd")
    finally:
        for name, value in kept.items():
            conf.unset(name) if value is None else conf.set(name, value)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, beside: bool = False) -> DataFrame:
    """Write ``df`` under the staging folder and return the written table; ``beside`` as in ``writing``."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    with writing(df, beside) as writer:
        writer.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Tasks that sort ``df``, a table whose rows Parquet counts, in memory; no fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(df.count() / rows_per_task))


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of the names, sizes and times of all files below ``paths``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    listed = sorted(map(str, files.select("path", "length", "modificationTime").collect()))
    return hashlib.sha256("\n".join(listed).encode()).hexdigest()


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Give jobs that checkpoint on their own (tree fitting) a folder to do so."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{staging_root(spark)}/checkpoints")
