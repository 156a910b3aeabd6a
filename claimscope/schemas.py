"""Column names, types and feature lists of the claims data model.

The lists below are fixed values: input headers, key sets and measures whose
names and order define the feature vector.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------- raw columns
CHRONIC_FLAGS = [
    "ChronicCond_Alzheimer",
    "ChronicCond_Heartfailure",
    "ChronicCond_KidneyDisease",
    "ChronicCond_Cancer",
    "ChronicCond_ObstrPulmonary",
    "ChronicCond_Depression",
    "ChronicCond_Diabetes",
    "ChronicCond_IschemicHeart",
    "ChronicCond_Osteoporasis",
    "ChronicCond_rheumatoidarthritis",
    "ChronicCond_stroke",
]
PHYSICIANS = ["AttendingPhysician", "OperatingPhysician", "OtherPhysician"]
DIAGNOSIS_CODES = [f"ClmDiagnosisCode_{i}" for i in range(1, 11)]
PROCEDURE_CODES = [f"ClmProcedureCode_{i}" for i in range(1, 7)]
ADMISSION_ONLY = ["AdmissionDt", "DischargeDt", "DiagnosisGroupCode"]


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

BENEFICIARY = _struct(
    BeneID=_S,
    DOB=_S,
    DOD=_S,
    Gender=_I,
    Race=_I,
    RenalDiseaseIndicator=_S,
    State=_I,
    County=_I,
    NoOfMonths_PartACov=_I,
    NoOfMonths_PartBCov=_I,
    **{c: _I for c in CHRONIC_FLAGS},
    IPAnnualReimbursementAmt=_L,
    IPAnnualDeductibleAmt=_L,
    OPAnnualReimbursementAmt=_L,
    OPAnnualDeductibleAmt=_L,
)

INPATIENT = _struct(
    BeneID=_S,
    ClaimID=_S,
    ClaimStartDt=_S,
    ClaimEndDt=_S,
    Provider=_S,
    InscClaimAmtReimbursed=_L,
    AttendingPhysician=_S,
    OperatingPhysician=_S,
    OtherPhysician=_S,
    AdmissionDt=_S,
    ClmAdmitDiagnosisCode=_S,
    DeductibleAmtPaid=_L,
    DischargeDt=_S,
    DiagnosisGroupCode=_S,
    **{c: _S for c in DIAGNOSIS_CODES},
    **{c: _S for c in PROCEDURE_CODES},
)

OUTPATIENT = T.StructType([f for f in INPATIENT if f.name not in ADMISSION_ONLY])

PROVIDER_LIST = _struct(Provider=_S)

# ---------------------------------------------------------- prepared columns
BASE_NUMERICS = [
    "InscClaimAmtReimbursed",
    "DeductibleAmtPaid",
    "AdmitForDays",
    "RenalDiseaseIndicator",
    "NoOfMonths_PartACov",
    "NoOfMonths_PartBCov",
    *CHRONIC_FLAGS,
    "IPAnnualReimbursementAmt",
    "IPAnnualDeductibleAmt",
    "OPAnnualReimbursementAmt",
    "OPAnnualDeductibleAmt",
    "Age",
    "WhetherDead",
]
CATEGORIES = ["Gender", "Race"]

# ------------------------------------------------------------- mean families
_ALL_MONEY = [
    "InscClaimAmtReimbursed",
    "DeductibleAmtPaid",
    "IPAnnualReimbursementAmt",
    "IPAnnualDeductibleAmt",
    "OPAnnualReimbursementAmt",
    "OPAnnualDeductibleAmt",
]
MONEY_AND_STAY = [*_ALL_MONEY, "AdmitForDays"]
PROVIDER_MEASURES = [
    *_ALL_MONEY,
    "Age",
    "NoOfMonths_PartACov",
    "NoOfMonths_PartBCov",
    "AdmitForDays",
]
BENE_MEASURES = [
    "InscClaimAmtReimbursed",
    "DeductibleAmtPaid",
    "IPAnnualReimbursementAmt",
    "AdmitForDays",
]

MEAN_FAMILIES: dict[str, list[str]] = {
    "Provider": PROVIDER_MEASURES,
    "BeneID": BENE_MEASURES,
    "AttendingPhysician": MONEY_AND_STAY,
    "OperatingPhysician": MONEY_AND_STAY,
    "DiagnosisGroupCode": MONEY_AND_STAY,
    "ClmAdmitDiagnosisCode": MONEY_AND_STAY,
    "ClmProcedureCode_1": MONEY_AND_STAY,
    "ClmProcedureCode_2": MONEY_AND_STAY,
    "ClmDiagnosisCode_1": MONEY_AND_STAY,
    "ClmDiagnosisCode_2": MONEY_AND_STAY,
    "ClmDiagnosisCode_3": MONEY_AND_STAY,
}

PREFIX_CODES = ["ClmDiagnosisCode_1", "ClmDiagnosisCode_2", "ClmDiagnosisCode_3"]
# This measure's "prefix" mean is grouped by the full code in all three families.
PREFIX_FULL_CODE_MEASURE = "OPAnnualReimbursementAmt"


def mean_name(key: str, measure: str) -> str:
    return f"Per{key}Avg_{measure}"


def prefix_name(code: str) -> str:
    return f"{code}_Grp"


# ------------------------------------------------------------ count families
COUNT_KEYS: list[tuple[str, ...]] = [
    ("Provider",),
    ("Provider", "BeneID"),
    ("Provider", "AttendingPhysician"),
    ("Provider", "OtherPhysician"),
    ("Provider", "OperatingPhysician"),
    ("Provider", "ClmAdmitDiagnosisCode"),
    *[("Provider", f"ClmProcedureCode_{j}") for j in range(1, 6)],
    *[("Provider", f"ClmDiagnosisCode_{i}") for i in range(1, 10)],
    ("Provider", "DiagnosisGroupCode"),
    ("Provider", "BeneID", "AttendingPhysician"),
    ("Provider", "BeneID", "OtherPhysician"),
    ("Provider", "BeneID", "AttendingPhysician", "ClmProcedureCode_1"),
    ("Provider", "BeneID", "AttendingPhysician", "ClmDiagnosisCode_1"),
    ("Provider", "BeneID", "OperatingPhysician"),
    ("Provider", "BeneID", "ClmProcedureCode_1"),
    ("Provider", "BeneID", "ClmDiagnosisCode_1"),
    ("Provider", "BeneID", "ClmDiagnosisCode_1", "ClmProcedureCode_1"),
]


def count_name(keys: tuple[str, ...]) -> str:
    return "ClmCount_" + "_".join(keys)


# ------------------------------------------------------------------ TF / IDF
TFIDF_DIAGNOSIS = DIAGNOSIS_CODES[:4]
TFIDF_PROCEDURE = PROCEDURE_CODES[:3]
TFIDF_CODES = [*TFIDF_DIAGNOSIS, *TFIDF_PROCEDURE]


def tfidf_names(code: str) -> tuple[str, str, str]:
    return f"{code}TF", f"{code}_IDF", f"{code}TF-IDF"


# -------------------------------------------------------- the feature vector
MEAN_FEATURES = [mean_name(k, m) for k, ms in MEAN_FAMILIES.items() for m in ms]
COUNT_FEATURES = [count_name(k) for k in COUNT_KEYS]
PREFIX_FEATURES = [
    mean_name(prefix_name(c), m) for c in PREFIX_CODES for m in MONEY_AND_STAY
]
TFIDF_FEATURES = [n for c in TFIDF_CODES for n in tfidf_names(c)]
GROUP_FEATURES = [*MEAN_FEATURES, *COUNT_FEATURES, *PREFIX_FEATURES, *TFIDF_FEATURES]


def onehot_name(column: str, level: object) -> str:
    return f"{column}_{level}"


def feature_names(levels: dict[str, list]) -> list[str]:
    """The ordered feature vector for fitted category levels (first level dropped)."""
    dummies = [onehot_name(c, v) for c in CATEGORIES for v in levels[c][1:]]
    return [*BASE_NUMERICS, *GROUP_FEATURES, *dummies]


PREDICTION = "PridictedFraud"
