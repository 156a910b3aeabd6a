import check_oracle
import pytest

import __spark_entry__ as entry_points
from claimscope.plans.oracle import ORACLE
from claimscope.plans.queries import QUERIES



@pytest.fixture(scope="module")
def connection(sf_dir):
    return check_oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    found = QUERIES[name](spark, sf_dir)
    assert check_oracle.differences(found, connection, ORACLE[name]) == []


def test_only_the_fitted_model_has_no_sql():
    assert set(QUERIES) - set(ORACLE) == {"fit_claims", "score_claims"}


def test_the_comparison_sees_differences(spark, connection):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    agree = "SELECT * FROM (VALUES (2, NULL), (1, 'a')) t(x, y)"
    assert check_oracle.differences(df, connection, agree) == []
    for sql in (
        "SELECT * FROM (VALUES (2, 'b'), (1, 'a')) t(x, y)",
        "SELECT * FROM (VALUES (1, 'a')) t(x, y)",
        "SELECT CAST(x AS BIGINT) AS x, y FROM (VALUES (2, NULL), (1, 'a')) t(x, y)",
        "SELECT x AS z, y FROM (VALUES (2, NULL), (1, 'a')) t(x, y)",
    ):
        assert check_oracle.differences(df, connection, sql)


def test_entry_has_rows(spark):
    assert not entry_points.entry(spark).isEmpty()
