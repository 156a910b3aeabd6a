"""Claims tables derived from star-schema order data.

Builds beneficiary, inpatient and outpatient tables from ``customer``,
``orders`` and ``lineitem`` so that every operator can run on the supplied
Parquet tables. Each column is one SQL expression in text that Spark and other
SQL engines read alike; ``oracle`` reuses the same text for its source views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope import schemas as S
from claimscope.functions.claims import named
from claimscope.sources.staging import tasks_for

BATCH_FROM = "2001-01-01"
HISTORY_BEFORE = "2001-02-01"

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = [
    "l_shipdate",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]
INPATIENT_TEST = "l_returnflag = 'R'"

# Lines of eleven plain columns that one task sorts.
LINES_PER_TASK = 250_000

_CHRONIC_PERIODS = [1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29]

BENEFICIARY_EXPR: dict[str, str] = {
    "BeneID": "concat('BENE', cast(c_custkey as string))",
    "DOB": "cast(date '1909-01-01' + cast(c_custkey * 7919 % 27000 as int) as string)",
    "DOD": "case when c_custkey % 71 = 0 then "
    "cast(date '2009-01-01' + cast(c_custkey % 335 as int) as string) end",
    "Gender": "cast(1 + c_custkey % 2 as int)",
    "Race": "case when c_custkey % 10 < 7 then 1 when c_custkey % 10 = 7 then 2 "
    "when c_custkey % 10 = 8 then 3 else 5 end",
    "RenalDiseaseIndicator": "case when c_custkey % 7 = 0 then 'Y' else '0' end",
    "State": "cast(c_nationkey as int)",
    "County": "cast(c_custkey % 999 as int)",
    "NoOfMonths_PartACov": "case when c_custkey % 100 = 0 then 0 else 12 end",
    "NoOfMonths_PartBCov": "cast(12 - c_custkey % 3 as int)",
    **{
        name: f"cast(1 + cast(floor(c_custkey / {p}) as bigint) % 2 as int)"
        for name, p in zip(S.CHRONIC_FLAGS, _CHRONIC_PERIODS)
    },
    "IPAnnualReimbursementAmt": "cast(floor(c_acctbal * 10) as bigint)",
    "IPAnnualDeductibleAmt": "cast(c_custkey % 3 * 1068 as bigint)",
    "OPAnnualReimbursementAmt": "cast(c_custkey * 37 % 5000 as bigint)",
    "OPAnnualDeductibleAmt": "cast(c_custkey * 13 % 900 as bigint)",
}

_SHIPPED = "cast(l_shipdate as date)"
_END = f"{_SHIPPED} + cast(l_quantity as int) % 15"
_CODE_TAIL = "cast(l_suppkey % 7 as string)"


def _two_digit(expr: str) -> str:
    return f"lpad(cast({expr} as string), 2, '0')"


CLAIM_EXPR: dict[str, str] = {
    # Some claims name a patient outside the beneficiary table: the inner join drops them.
    "BeneID": "concat(case when o_custkey % 53 = 0 then 'GONE' else 'BENE' end, "
    "cast(o_custkey as string))",
    "ClaimID": "concat('CLM', cast(l_orderkey * 10 + l_linenumber as string))",
    "ClaimStartDt": f"cast({_SHIPPED} as string)",
    "ClaimEndDt": f"cast({_END} as string)",
    "Provider": "concat('PRV', cast(l_suppkey as string))",
    "InscClaimAmtReimbursed": "cast(floor(l_extendedprice) as bigint)",
    "AttendingPhysician": "case when l_partkey % 97 <> 0 then "
    "concat('PHY', cast(l_partkey % 400 as string)) end",
    "OperatingPhysician": "case when l_partkey % 3 = 0 then "
    "concat('PHY', cast(l_partkey % 250 as string)) end",
    "OtherPhysician": "case when l_partkey % 4 = 0 then "
    "concat('PHY', cast(l_partkey % 150 as string)) end",
    "AdmissionDt": f"case when {INPATIENT_TEST} then cast({_SHIPPED} as string) end",
    "ClmAdmitDiagnosisCode": f"case when {INPATIENT_TEST} or l_partkey % 5 = 0 then "
    f"concat({_two_digit('l_partkey * 3 % 90 + 1')}, {_CODE_TAIL}) end",
    "DeductibleAmtPaid": f"case when not ({INPATIENT_TEST}) then "
    "cast(round(l_discount * 1000) as bigint) "
    "when l_partkey % 29 <> 0 then cast(1068 as bigint) end",
    "DischargeDt": f"case when {INPATIENT_TEST} then cast({_END} as string) end",
    "DiagnosisGroupCode": f"case when {INPATIENT_TEST} then "
    "lpad(cast(l_partkey % 120 as string), 3, '0') end",
    **{
        name: f"case when (l_partkey + l_linenumber) % 13 >= {i} then "
        f"concat({_two_digit(f'l_partkey * {i + 2} % 90 + 1')}, {_CODE_TAIL}) end"
        for i, name in enumerate(S.DIAGNOSIS_CODES, start=1)
    },
    **{
        name: f"case when {INPATIENT_TEST} and l_partkey % 6 >= {j} then "
        f"concat(cast(l_partkey * {j + 1} % 60 + 10 as string), '1') end"
        for j, name in enumerate(S.PROCEDURE_CODES, start=1)
    },
}


def _aliased(exprs: dict[str, str]) -> list[str]:
    return [named(e, n) for n, e in exprs.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beneficiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_aliased(BENEFICIARY_EXPR))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with one row per (order, line number), first in a total order.

    Lines are shuffled by their order alone, which serves the choice of the first copy and the join to ``orders``.
    """
    lines = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(lines, LINES_PER_TASK)
    is_many = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(tasks, "l_orderkey") if is_many else lines.repartition("l_orderkey")
    first = Window.partitionBy(*LINE_KEY).orderBy(*LINE_ORDER)
    return lines.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def _claims(spark: SparkSession, sf_dir: str, span: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(span)
    lines = order_lines(spark, sf_dir)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


BATCH_SPAN = f"o_orderdate >= timestamp '{BATCH_FROM} 00:00:00'"
HISTORY_SPAN = f"o_orderdate < timestamp '{HISTORY_BEFORE} 00:00:00'"


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines of all claims: the plain columns that a claim is derived from, and the patient's ``BeneID``."""
    lines = _claims(spark, sf_dir, "true").withColumn("BeneID", F.expr(CLAIM_EXPR["BeneID"]))
    return lines.select("BeneID", "o_orderdate", *LINE_KEY, *[c for c in LINE_ORDER if c not in ("l_tax", "l_linestatus")])


def _raw_pair(claims: DataFrame, raise_by: int) -> tuple[DataFrame, DataFrame]:
    """Split claim rows into raw inpatient and outpatient tables."""
    exprs = dict(CLAIM_EXPR)
    if "BeneID" in claims.columns:
        exprs["BeneID"] = "BeneID"
    if raise_by:
        exprs["InscClaimAmtReimbursed"] += f" + {raise_by}"
    inpatient = claims.filter(INPATIENT_TEST).selectExpr(*_aliased(exprs))
    outpatient = claims.filter(f"not ({INPATIENT_TEST})").selectExpr(
        *_aliased({n: e for n, e in exprs.items() if n not in S.ADMISSION_ONLY})
    )
    return inpatient, outpatient


def _tables(
    spark: SparkSession, sf_dir: str, span: str, raise_by: int, lines: DataFrame | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    claims = _claims(spark, sf_dir, span) if lines is None else lines.filter(span)
    return (beneficiary(spark, sf_dir), *_raw_pair(claims, raise_by))


def batch_tables(
    spark: SparkSession, sf_dir: str, lines: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw (beneficiary, inpatient, outpatient) of the batch pool; ``lines`` may be the written ``claim_lines``."""
    return _tables(spark, sf_dir, BATCH_SPAN, 0, lines)


def history_tables(
    spark: SparkSession, sf_dir: str, lines: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw history; amounts are raised by 1 to tell the overlapping month's copies apart."""
    return _tables(spark, sf_dir, HISTORY_SPAN, 1, lines)


def all_tables(
    spark: SparkSession, sf_dir: str, lines: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw tables over every order, for operators that need no batch/history split."""
    return _tables(spark, sf_dir, "true", 0, lines)
