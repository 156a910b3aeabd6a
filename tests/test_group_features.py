import math

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from claimscope.operators.group_features import group_count, group_counts, group_means
from claimscope.operators.lookup import skew_safe_join

# Strategy limits: broadcast whole, split hot keys, shuffle everything.
LIMITS = [
    {},
    {"broadcast_rows": 0, "share": 0.2},
    {"broadcast_rows": 0, "share": 1.0},
    {"broadcast_rows": 4, "share": 0.05},
]


@pytest.fixture(scope="module")
def claims(spark):
    """300 claims; one provider holds over a third of them; keys and values have NULLs."""
    data = []
    for i in range(300):
        provider = None if i % 41 == 0 else ("hot" if i % 5 < 2 else f"p{i % 17}")
        code = None if i % 3 == 0 else f"{i % 7:02d}"
        data.append((f"C{i:03d}", provider, code, None if i % 4 == 0 else i, None))
    return spark.createDataFrame(
        data, "ClaimID string, Provider string, code string, amount long, empty long"
    ).cache()


@pytest.fixture(scope="module")
def frame(claims):
    return claims.toPandas()


def same(found, expected):
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        if b is None or (isinstance(b, float) and math.isnan(b)):
            assert a is None
        else:
            assert a == b


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("keys", [["Provider"], ["code"], ["Provider", "code"]])
def test_means_equal_brute_force(claims, frame, keys, limits):
    got = group_means(claims, keys, {"m": "amount", "e": "empty"}, **limits)
    expected = frame.groupby(keys)["amount"].transform("mean")
    by_id = rows(got.select("ClaimID", "m", "e"), "ClaimID")
    same([r[1] for r in by_id], expected.tolist())
    assert {r[2] for r in by_id} == {None}


@pytest.mark.parametrize("limits", LIMITS)
def test_count_of_one_key_set(claims, frame, limits):
    got = group_count(claims, ["Provider"], "n", **limits).select("ClaimID", "n")
    same([r[1] for r in rows(got, "ClaimID")], frame.groupby("Provider")["ClaimID"].transform("count").tolist())


@pytest.mark.parametrize("limits", LIMITS)
def test_counts_of_many_key_sets_at_once(claims, frame, limits):
    sets = {"a": ("Provider",), "b": ("Provider", "code"), "c": ("code",), "d": ("Provider", "code", "amount")}
    got = group_counts(claims, sets, **limits)
    assert got.columns == [*claims.columns, *sets]
    for name, keys in sets.items():
        expected = frame.groupby(list(keys))["ClaimID"].transform("count")
        same([r[1] for r in rows(got.select("ClaimID", name), "ClaimID")], expected.tolist())


def test_window_form_gives_the_same(claims):
    got = group_means(claims, ["Provider"], {"m": "amount"}, broadcast_rows=0, share=0.1)
    window = claims.selectExpr(
        "ClaimID",
        "CASE WHEN Provider IS NOT NULL THEN avg(amount) OVER (PARTITION BY Provider) END AS m",
    )
    assert rows(got.select("ClaimID", "m"), "ClaimID") == rows(window, "ClaimID")


def test_key_text_with_empty_string_is_a_key(spark):
    df = spark.createDataFrame([("1", "", "x"), ("2", "", "x"), ("3", None, "x")], "ClaimID string, a string, b string")
    got = group_counts(df, {"ab": ("a", "b"), "a1": ("a",)}).select("ClaimID", "ab", "a1")
    assert rows(got, "ClaimID") == [("1", 2, 2), ("2", 2, 2), ("3", None, None)]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("share", [0.1, 1.0])
def test_skew_safe_join_equals_plain_join(spark, claims, how, share):
    table = spark.createDataFrame(
        [("hot", 1), ("p1", 2), ("p3", 3), ("unused", 4)], "Provider string, v int"
    )
    got = skew_safe_join(claims, table, "Provider", how, share, broadcast_rows=0)
    plain = claims.join(table, "Provider", how)
    pick = lambda df: rows(df.select("ClaimID", "v"), "ClaimID")
    assert pick(got) == pick(plain)


def test_lookup_of_hot_keys_needs_no_python(claims):
    from conftest import plan_of

    plan = plan_of(group_means(claims, ["Provider"], {"m": "amount"}, broadcast_rows=0, share=0.1))
    assert "Python" not in plan and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan
