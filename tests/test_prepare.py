import datetime as dt

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from claimscope import schemas as S
from claimscope.functions import claims as C
from claimscope.operators import prepare as P


def test_flags_recode_only_their_own_columns(spark):
    df = spark.createDataFrame([(2, 2), (1, 1), (None, 3)], "flag int, Gender int")
    wide = df.selectExpr("Gender", *[f"flag AS {c}" for c in S.CHRONIC_FLAGS])
    got = P.recode_flags(wide).select("Gender", S.CHRONIC_FLAGS[0], S.CHRONIC_FLAGS[-1])
    assert rows(got, "Gender") == [(1, 1, 1), (2, 0, 0), (3, None, None)]
    assert P.recode_flags(wide).columns == wide.columns


def test_renal_indicator_reads_y_and_integers_only(spark):
    df = spark.createDataFrame([("Y",), ("0",), (None,)], "RenalDiseaseIndicator string")
    assert sorted(rows(P.recode_renal(df)), key=str) == [(0,), (1,), (None,)]
    bad = spark.createDataFrame([("N",)], "RenalDiseaseIndicator string")
    with pytest.raises(PySparkException):
        P.recode_renal(bad).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_dates_fail_and_lenient_dates_become_null(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([("1950-02-01", "x"), ("1951-02-01", None)], "DOB string, DOD string")
        assert rows(P.parse_birth_and_death(df), "DOB") == [
            (dt.date(1950, 2, 1), None),
            (dt.date(1951, 2, 1), None),
        ]
        bad = spark.createDataFrame([("01/02/1950", None)], "DOB string, DOD string")
        with pytest.raises(PySparkException):
            P.parse_birth_and_death(bad).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_age_uses_death_or_reference_date_in_365_day_years(spark):
    df = spark.createDataFrame(
        [("1909-12-01", None), ("1909-12-01", "1999-12-01"), ("2009-06-01", None)],
        "DOB string, DOD string",
    ).transform(P.parse_birth_and_death)
    aged = P.add_dead_flag(P.add_age(df)).select("Age", "WhetherDead")
    days = [(dt.date(2009, 12, 1) - dt.date(1909, 12, 1)).days, (dt.date(1999, 12, 1) - dt.date(1909, 12, 1)).days]
    assert sorted(rows(aged)) == sorted(
        [(float(round(days[0] / 365)), 0), (float(round(days[1] / 365)), 1), (1.0, 0)]
    )
    later = P.add_age(df, "2019-12-01").agg(F.max("Age")).first()[0]
    assert later == float(round((days[0] + 3652) / 365))


def test_stay_counts_both_ends(spark):
    df = spark.createDataFrame(
        [("2009-01-01", "2009-01-01"), ("2009-01-30", "2009-02-02"), (None, "2009-01-01")],
        "AdmissionDt string, DischargeDt string",
    )
    got = P.prepare_inpatient(df).select("AdmitForDays")
    assert sorted(rows(got), key=str) == [(1,), (4,), (None,)]


def test_union_fills_missing_columns_and_join_drops_unmatched(spark):
    inp = spark.createDataFrame([("C1", "B1", 3)], "ClaimID string, BeneID string, AdmitForDays int")
    out = spark.createDataFrame(
        [("C2", "B1"), ("C3", "B9"), ("C4", None)], "ClaimID string, BeneID string"
    )
    ben = spark.createDataFrame([("B1", 1), (None, 2)], "BeneID string, Gender int")
    joined = P.join_beneficiaries(P.union_claims(inp, out), ben)
    assert rows(joined.select("ClaimID", "AdmitForDays", "Gender"), "ClaimID") == [
        ("C1", 3, 1),
        ("C2", None, 1),
    ]


def test_prefix_of_missing_code_is_a_text(spark):
    df = spark.createDataFrame([("0066",), ("7",), (None,)], "c string")
    got = df.select(C.code_prefix(F.col("c")).alias("p"))
    assert sorted(rows(got)) == [("00",), ("7",), ("na",)]
