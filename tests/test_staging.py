import subprocess
import sys
from pathlib import Path

from claimscope.sources.staging import stage, staging_root

ROOT = Path(__file__).resolve().parents[1]

SHARED = """
import sys
from pyspark.sql import SparkSession
from claimscope.sources.staging import stage, staging_root, use_checkpoint_dir

shared = sys.argv[1]
spark = (
    SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", shared).getOrCreate()
)
assert staging_root(spark) == shared
assert stage(spark.range(3), "numbers").count() == 3
before = spark.sparkContext.getCheckpointDir()
use_checkpoint_dir(spark)
assert before is None or spark.sparkContext.getCheckpointDir() == before
"""


def test_written_table_is_read_back(spark):
    written = stage(spark.range(10).selectExpr("id", "id % 2 = 0 AS even"), "t", ["even"])
    assert written.columns == ["id", "even"]
    assert written.filter("even").count() == 5
    assert staging_root(spark) in written.inputFiles()[0]


def test_the_shared_folder_of_the_session_is_used(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SHARED, str(tmp_path)],
        cwd=ROOT,
        capture_output=True,
        text=True,
        timeout=120,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert list(tmp_path.glob("numbers-*"))
