"""Raw beneficiary, inpatient and outpatient tables to one claims table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope import schemas as S
from claimscope.functions import claims as C


def recode_flags(beneficiary: DataFrame) -> DataFrame:
    """Chronic-condition flags from 1/2 to 1/0; other columns keep their 2s."""
    recoded = {c: C.named(C.two_to_zero(C.quoted(c)), c) for c in S.CHRONIC_FLAGS}
    return beneficiary.selectExpr(*[recoded.get(c, C.quoted(c)) for c in beneficiary.columns])


def recode_renal(beneficiary: DataFrame) -> DataFrame:
    return beneficiary.withColumn(
        "RenalDiseaseIndicator", C.renal_flag(F.col("RenalDiseaseIndicator"))
    )


def parse_birth_and_death(beneficiary: DataFrame) -> DataFrame:
    """``DOB`` must be a date; an unreadable ``DOD`` counts as none."""
    return beneficiary.withColumns(
        {"DOB": C.strict_date(F.col("DOB")), "DOD": C.lenient_date(F.col("DOD"))}
    )


def parse_stay(inpatient: DataFrame) -> DataFrame:
    return inpatient.withColumns(
        {c: C.strict_date(F.col(c)) for c in ("AdmissionDt", "DischargeDt")}
    )


def add_age(
    beneficiary: DataFrame, reference_date: str = C.AGE_REFERENCE_DATE
) -> DataFrame:
    return beneficiary.withColumn(
        "Age", C.age_years(F.col("DOB"), F.col("DOD"), reference_date)
    )


def add_dead_flag(beneficiary: DataFrame) -> DataFrame:
    return beneficiary.withColumn("WhetherDead", F.col("DOD").isNotNull().cast("int"))


def add_stay_days(inpatient: DataFrame) -> DataFrame:
    return inpatient.withColumn(
        "AdmitForDays", C.stay_days(F.col("AdmissionDt"), F.col("DischargeDt"))
    )


def prepare_beneficiary(
    beneficiary: DataFrame, reference_date: str = C.AGE_REFERENCE_DATE
) -> DataFrame:
    return (
        beneficiary.transform(recode_flags)
        .transform(recode_renal)
        .transform(parse_birth_and_death)
        .transform(add_age, reference_date)
        .transform(add_dead_flag)
    )


def prepare_inpatient(inpatient: DataFrame) -> DataFrame:
    return inpatient.transform(parse_stay).transform(add_stay_days)


def union_claims(inpatient: DataFrame, outpatient: DataFrame) -> DataFrame:
    """Stack by column name; outpatient rows get NULL for admission-only columns."""
    return inpatient.unionByName(outpatient, allowMissingColumns=True)


def join_beneficiaries(claims: DataFrame, beneficiary: DataFrame, hashed: bool = False) -> DataFrame:
    """Inner join: claims without a beneficiary (or without a ``BeneID``) are dropped.

    Without ``hashed`` no hint is given. Spark broadcasts a beneficiary table whose measured size is
    below its threshold and otherwise shuffles, splitting a patient that holds a
    large share of the claims (adaptive skew join). ``hashed`` is for a beneficiary table known
    to be too large to broadcast: its rows are hashed per task, so that the wide claims are not sorted.
    """
    if hashed:
        beneficiary = beneficiary.hint("shuffle_hash")
    return claims.join(beneficiary, "BeneID", "inner")


def prepare_claims(
    beneficiary: DataFrame,
    inpatient: DataFrame,
    outpatient: DataFrame,
    reference_date: str = C.AGE_REFERENCE_DATE,
    hashed: bool = False,
) -> DataFrame:
    """One row per claim, beneficiary columns included; ``hashed`` as in ``join_beneficiaries``."""
    claims = union_claims(prepare_inpatient(inpatient), outpatient)
    return join_beneficiaries(claims, prepare_beneficiary(beneficiary, reference_date), hashed)
