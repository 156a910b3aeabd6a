"""Claims prepared from order lines laid out by patient, and keys counted without a shuffle of all of them."""

import pytest
from conftest import plan_of, rows

from claimscope.operators.prepare import prepare_claims
from claimscope.plans import tables
from claimscope.sources import star
from claimscope.sources.keyed_layout import KeyedTable, frequent_keys, merge_by_key
from claimscope.sources.staging import stage


@pytest.fixture
def no_broadcast(spark):
    """No table is small enough to be broadcast by Spark on its own."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """40 orders of six patients, some lines twice; patient 1 has most orders, two orders have none."""
    at = str(tmp_path_factory.mktemp("star"))
    spark.range(300).selectExpr(
        "id % 40 AS l_orderkey", "id % 31 AS l_partkey", "id % 3 AS l_suppkey", "cast(id % 4 AS int) AS l_linenumber",
        "cast(id % 5 AS double) AS l_quantity", "cast(id AS double) AS l_extendedprice", "0.1D AS l_discount", "0D AS l_tax",
        "if(id % 3 = 0, 'R', 'N') AS l_returnflag", "'O' AS l_linestatus", "timestamp '2000-01-01' AS l_shipdate",
    ).write.parquet(f"{at}/lineitem.parquet")
    spark.range(40).selectExpr(
        "id AS o_orderkey", "CASE WHEN id IN (3, 9) THEN NULL WHEN id < 24 THEN 1 ELSE id % 6 END AS o_custkey",
        "timestamp '2000-06-01' + make_interval(0, 0, 0, cast(id * 20 AS int)) AS o_orderdate",
    ).write.parquet(f"{at}/orders.parquet")
    spark.range(6).selectExpr("id AS c_custkey", "cast(id AS int) AS c_nationkey", "cast(id * 3 AS double) AS c_acctbal").write.parquet(
        f"{at}/customer.parquet"
    )
    spark.range(3).selectExpr("id AS s_suppkey").write.parquet(f"{at}/supplier.parquet")
    return at


RAW = {"all": star.all_tables, "batch": star.batch_tables, "history": star.history_tables}


@pytest.mark.parametrize("limits", [(1e-3, 10_000, 100_000), (0.5, 5, 0), (1e-3, 10_000, 0)])
def test_prepared_claims_are_those_of_the_plain_tables(spark, folder, monkeypatch, limits):
    # Nothing is laid out by the first limits; patient 1 and lines without a patient are apart by the second, the latter by the third.
    for name, value in zip(("HOT_SHARE", "HOT_ROWS", "BROADCAST_ROWS"), limits):
        monkeypatch.setattr(tables, name, value)
    monkeypatch.setattr(tables, "_kept", {})
    for which, raw in RAW.items():
        want = prepare_claims(*raw(spark, folder))
        found = tables.prepared(spark, folder, which)
        assert found.columns == want.columns and found.schema.simpleString() == want.schema.simpleString()
        order = ["ClaimID", "BeneID"]
        assert rows(found, *order) == rows(want, *order) and not found.isEmpty()


def test_claims_laid_out_by_patient_are_joined_where_they_lie(spark, sf_dir, monkeypatch, no_broadcast):
    monkeypatch.setattr(tables, "_kept", {})
    (lines,) = tables._claim_lines(spark, sf_dir)
    plan = plan_of(prepare_claims(*star.all_tables(spark, sf_dir, lines), hashed=True))
    # The beneficiaries alone are shuffled, and no claim is sorted.
    assert plan.count("Exchange") == 1 and "Sort" not in plan
    assert "ShuffledHashJoin" in plan


def test_frequent_keys_are_those_of_a_plain_count(spark):
    made = stage(spark.range(4000).selectExpr("CASE WHEN id % 4 = 0 THEN 'a' WHEN id % 9 = 1 THEN NULL ELSE concat('k', id % 500) END AS k"), "keys")
    counts = {r.k: r["count"] for r in made.groupBy("k").count().collect() if r.k is not None}
    for share, least in ((0.1, 10), (0.0, 6), (0.0, 0), (0.9, 0)):
        wanted = {k for k, n in counts.items() if n > max(least, share * 4000)}
        assert set(frequent_keys(made, "k", share, least)) == wanted


def _merged(spark, copies):
    history = spark.range(2000).selectExpr("concat('C', id) AS ClaimID", "id AS v")
    if copies:
        history = history.unionByName(spark.range(3).selectExpr("concat('C', id + 100) AS ClaimID", "id - 9 AS v"))
    batch = spark.range(50).selectExpr("concat('C', id * 60) AS ClaimID", "id + 5000 AS v")
    laid = [KeyedTable.write(stage(t, "side"), "ClaimID", "side", 3) for t in (batch, history)]
    return merge_by_key(*laid)


def test_a_merge_by_key_sorts_no_rows_of_single_ids(spark, no_broadcast):
    merged = _merged(spark, copies=False)
    plan = plan_of(merged)
    assert "Sort" not in plan and "Window" not in plan and "Exchange hashpartitioning" not in plan
    assert merged.count() == 2000 + 16


def test_a_merge_by_key_keeps_the_first_of_few_copies(spark, no_broadcast):
    merged = _merged(spark, copies=True)
    found = {r.ClaimID: (r.v, r.src_priority) for r in merged.collect()}
    assert merged.count() == len(found) == 2000 + 16
    assert [found[k] for k in ("C100", "C101", "C102", "C103", "C60", "C120")] == [(-9, 1), (-8, 1), (-7, 1), (103, 1), (5001, 0), (5002, 0)]
