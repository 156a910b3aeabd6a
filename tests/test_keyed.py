import pytest
from conftest import plan_of, rows

from claimscope.operators import keyed


@pytest.fixture(scope="module")
def pair(spark):
    batch = spark.createDataFrame(
        [("a", 1), ("a", 2), ("b", 3), (None, 9)], "ClaimID string, v int"
    )
    history = spark.createDataFrame(
        [(0, "a", 0), (0, "c", 5), (0, "c", 4), (0, "d", 6), (0, None, 7)],
        "extra int, ClaimID string, v int",
    )
    return batch, history


EXPECTED = [(None, 9, 0), ("a", 1, 0), ("b", 3, 0), ("c", 4, 1), ("d", 6, 1)]


def test_union_takes_the_columns_of_the_batch(pair):
    stacked = keyed.batch_history_union(*pair)
    assert stacked.columns == ["ClaimID", "v", "src_priority"]
    assert stacked.count() == 9


@pytest.mark.parametrize("broadcast_rows", [100_000, 1, 0])
def test_merge_keeps_first_copy_and_prefers_the_batch(pair, broadcast_rows):
    merged = keyed.merge_batch_history(*pair, broadcast_rows=broadcast_rows)
    assert rows(merged.select("ClaimID", "v", "src_priority"), "ClaimID") == EXPECTED


def test_keep_first_equals_merge(pair):
    stacked = keyed.batch_history_union(*pair)
    first = keyed.keep_first(stacked, "ClaimID", ["src_priority", "v"])
    assert rows(first, "ClaimID") == EXPECTED


def test_keep_first_cuts_to_one_row_per_key_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS ClaimID", "id AS v")
    plan = plan_of(keyed.keep_first(df, "ClaimID", ["v"]))
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan


def test_unique_table_is_returned_as_it_is(spark):
    df = spark.range(5).withColumnRenamed("id", "ClaimID")
    assert keyed.unique_rows(df, "ClaimID") is df
