import pytest
from conftest import rows

from claimscope.sources.sink import BatchSink


def test_a_batch_counts_once_and_only_when_committed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sink")
    with pytest.raises(ValueError):
        BatchSink(spark, path).read()
    one = spark.createDataFrame([(1, "a"), (2, "a")], "x int, y string")
    two = spark.createDataFrame([(3, None)], one.schema)
    assert BatchSink(spark, path).write(one, "first/1")
    assert not BatchSink(spark, path).write(two, "first/1")

    class Lost(BatchSink):
        """Fails between the rows and the commit, as when the driver is lost."""

        def _committed(self):
            found = super()._committed()
            self.spark = Broken(self.spark)
            return found

    class Broken:
        def __init__(self, spark):
            self.read = spark.read

        def createDataFrame(self, *_):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        Lost(spark, path).write(two, "second")
    assert rows(BatchSink(spark, path).read(), "x") == [(1, "a", "first/1"), (2, "a", "first/1")]
    assert BatchSink(spark, path).write(two, "second")
    assert rows(BatchSink(spark, path).read(), "x") == [(1, "a", "first/1"), (2, "a", "first/1"), (3, None, "second")]
    assert rows(BatchSink(spark, path).read("second")) == [(3, None, "second")]
    assert BatchSink(spark, path).write(one.limit(0), "empty")
    assert BatchSink(spark, path).read().count() == 3
