import pytest
from conftest import plan_of, rows

from claimscope.operators import keyed
from claimscope.sources.keyed_layout import KeyedTable, merge_by_key
from claimscope.sources.staging import stage

BUCKETS = 5


@pytest.fixture(scope="module")
def tables(spark):
    """Claims of which patient ``p7`` has a third, a few have no patient, and patients with one row each."""
    claims = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'p7' WHEN id % 100 = 1 THEN NULL ELSE concat('p', id % 211) END AS BeneID",
        "id AS v",
    )
    patients = spark.range(200).selectExpr("concat('p', id) AS BeneID", "id * 2 AS age")
    patients = patients.unionByName(spark.createDataFrame([(None, 9)], "BeneID string, age long"))
    return stage(claims, "claims"), stage(patients, "patients")


@pytest.fixture
def sorted_joins(spark):
    """No table is small enough to be broadcast by Spark on its own."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def laid_out(table, name, **limits):
    return KeyedTable.write(table, "BeneID", name, BUCKETS, **limits)


LIMITS = [{"hot_rows": 100, "hot_share": 0.1}, {}, {"hot_rows": 0, "hot_share": 0.0}]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_equals_the_join(tables, limits, how):
    claims, patients = tables
    found = laid_out(claims, "c", **limits).lookup(laid_out(patients, "p", **limits), how)
    assert rows(found, "v") == rows(claims.join(patients, "BeneID", how), "v")


def test_a_frequent_patient_is_written_apart(tables):
    keyed_claims = laid_out(tables[0], "c", **LIMITS[0])
    assert keyed_claims.hot == ("p7",) and keyed_claims.has_missing
    assert keyed_claims.rest.filter("BeneID = 'p7' OR BeneID IS NULL").isEmpty()
    assert keyed_claims.rows().count() == 3000


def test_join_and_dedup_shuffle_no_claims(tables, sorted_joins):
    claims, patients = (laid_out(t, n, **LIMITS[0]) for t, n in zip(tables, "cp", strict=True))
    joined = claims.rest.join(patients.rest, "BeneID")
    assert "Exchange" not in plan_of(joined) and joined.count() > 0
    assert "Exchange" not in plan_of(claims.keep_first(["v"]).rest)
    assert "Exchange" not in plan_of(claims.without(patients).rest)
    # The rows apart meet broadcast rows; nothing is hashed anew.
    assert "Exchange hashpartitioning" not in plan_of(claims.lookup(patients))


def parts_read(df):
    """Read tasks of a plan, one a file at this cost of opening a file."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        return df._jdf.queryExecution().executedPlan().execute().getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lookups_by_id_read_their_buckets(tables):
    claims = laid_out(tables[0], "c", **LIMITS[0])
    assert parts_read(claims.rest.filter("v >= 0")) == BUCKETS
    assert parts_read(claims.rest.filter("BeneID = 'p8'")) == 1
    wanted = tables[0].filter("BeneID IN ('p7', 'p8') OR BeneID IS NULL")
    assert rows(claims.rows_of(["p7", "p8", None]), "v") == rows(wanted, "v")
    assert rows(claims.rows_of([])) == []


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("batch_ids", ["id % 7 = 0", "id % 3 = 0 AND id < 9", "id < 0"])
def test_merge_equals_the_merge_of_plain_tables(tables, limits, batch_ids):
    history = tables[0]
    batch = stage(history.filter(batch_ids.replace("id", "v")).selectExpr("v + 10000 AS v", "BeneID"), "b")
    merged = merge_by_key(laid_out(batch, "b", **limits), laid_out(history, "h", **limits))
    plain = keyed.merge_batch_history(batch, history, "BeneID")
    order = ["BeneID", "v", "src_priority"]
    assert rows(merged.select(*order), *order) == rows(plain.select(*order), *order)


def test_empty_tables_and_unlike_layouts(tables):
    claims, patients = tables
    empty = laid_out(claims.limit(0), "e")
    assert empty.rows().count() == 0 and empty.lookup(laid_out(patients, "p")).count() == 0
    assert laid_out(claims, "c").without(empty).rows().count() == 3000
    with pytest.raises(ValueError, match="buckets"):
        empty.lookup(KeyedTable.write(patients, "BeneID", "p", BUCKETS + 1))
