"""Equivalent SQL for the registered queries, for any engine with these tables as views.

Source views come from the adapter's expressions; everything after them (recoding,
dates, joins, group values as window functions, TF / IDF, scaling, sampling) is stated
here on its own, in another form than the Spark code uses.
"""

from __future__ import annotations

from claimscope import schemas as S
from claimscope.plans import queries as Q
from claimscope.sources import star


def _q(name: str) -> str:
    return f'"{name}"'


def _cols(names) -> str:
    return ", ".join(_q(n) for n in names)


def _select(exprs: dict[str, str]) -> str:
    return ",\n    ".join(f"{e} AS {_q(n)}" for n, e in exprs.items())


# ------------------------------------------------------------------ raw views
_RAW = f"""beneficiary AS (
  SELECT {_select(star.BENEFICIARY_EXPR)} FROM customer),
lines AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY {", ".join(star.LINE_KEY)} ORDER BY {", ".join(star.LINE_ORDER)}) AS rn
    FROM lineitem) WHERE rn = 1),
raw_claims AS (
  SELECT {_select(star.CLAIM_EXPR)},
    {star.INPATIENT_TEST} AS is_inpatient, o_orderdate
  FROM lines JOIN orders ON l_orderkey = o_orderkey)"""

_ALL_CLAIMS = "raw AS (SELECT * EXCLUDE (o_orderdate) FROM raw_claims)"
_BATCH_CLAIMS = (
    f"raw AS (SELECT * EXCLUDE (o_orderdate) FROM raw_claims WHERE {star.BATCH_SPAN})"
)
_HISTORY_RAISED = "* EXCLUDE (o_orderdate) REPLACE (InscClaimAmtReimbursed + 1 AS InscClaimAmtReimbursed)"
_HISTORY_CLAIMS = f"raw AS (SELECT {_HISTORY_RAISED} FROM raw_claims WHERE {star.HISTORY_SPAN})"

# ----------------------------------------------------------------- preparation
_AGE = (
    "round(date_diff('day', CAST(DOB AS DATE), "
    "coalesce(CAST(DOD AS DATE), DATE '2009-12-01')) / 365.0)"
)
_BEN_PREPARED = {
    **{n: n for n in ("BeneID",)},
    "DOB": "CAST(DOB AS DATE)",
    "DOD": "CAST(DOD AS DATE)",
    **{n: n for n in ("Gender", "Race")},
    "RenalDiseaseIndicator": "CASE RenalDiseaseIndicator WHEN 'Y' THEN 1 "
    "ELSE CAST(RenalDiseaseIndicator AS INTEGER) END",
    **{n: n for n in ("State", "County", "NoOfMonths_PartACov", "NoOfMonths_PartBCov")},
    **{n: f"CASE {n} WHEN 2 THEN 0 ELSE {n} END" for n in S.CHRONIC_FLAGS},
    **{
        n: n
        for n in (
            "IPAnnualReimbursementAmt",
            "IPAnnualDeductibleAmt",
            "OPAnnualReimbursementAmt",
            "OPAnnualDeductibleAmt",
        )
    },
    "Age": f"CAST({_AGE} AS DOUBLE)",
    "WhetherDead": "CAST(DOD IS NOT NULL AS INTEGER)",
}
_CLAIM_PREPARED = {
    **{
        f.name: f"CAST({f.name} AS DATE)" if f.name in ("AdmissionDt", "DischargeDt") else f.name
        for f in S.INPATIENT
    },
    "AdmitForDays": "CAST(CAST(DischargeDt AS DATE) - CAST(AdmissionDt AS DATE) + 1 AS INTEGER)",
}
_CLAIM_COLUMNS = list(_CLAIM_PREPARED)
_NUMERIC = [*S.BASE_NUMERICS, *S.CATEGORIES, "State", "County"]
_MERGED_COLUMNS = _CLAIM_COLUMNS + [n for n in _BEN_PREPARED if n != "BeneID"]


def _prepared(name: str, source: str) -> str:
    """A CTE of prepared claims over the raw claims CTE ``source``."""
    return f"""{name} AS (
  SELECT c.*, b.* EXCLUDE (BeneID)
  FROM (SELECT {_select(_CLAIM_PREPARED)} FROM {source}) c
  JOIN (SELECT {_select(_BEN_PREPARED)} FROM beneficiary) b ON c.BeneID = b.BeneID)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_ALL = _with(_RAW, _ALL_CLAIMS, _prepared("claims", "raw"))
_PAIR_CTES = [
    _RAW,
    f"raw_batch AS (SELECT * EXCLUDE (o_orderdate) FROM raw_claims WHERE {star.BATCH_SPAN})",
    f"raw_history AS (SELECT {_HISTORY_RAISED} FROM raw_claims WHERE {star.HISTORY_SPAN})",
    _prepared("batch", "raw_batch"),
    _prepared("history", "raw_history"),
    """merged AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY ClaimID ORDER BY src_priority) AS copy_no
    FROM (SELECT *, 0 AS src_priority FROM batch
          UNION ALL SELECT *, 1 AS src_priority FROM history))
  WHERE copy_no = 1)""",
]
_PAIR = _with(*_PAIR_CTES)


# --------------------------------------------------------------- group features
def _guarded(value: str, keys) -> str:
    """A window aggregate over the keys' group, NULL where a key part is NULL."""
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"CASE WHEN {present} THEN {value} OVER (PARTITION BY {', '.join(keys)}) END"


def _mean_exprs(key: str) -> dict[str, str]:
    return {
        S.mean_name(key, m): _guarded(f"avg({m})", [key]) for m in S.MEAN_FAMILIES[key]
    }


def _prefix_expr(code: str) -> str:
    return f"coalesce(substr({code}, 1, 2), 'na')"


def _prefix_exprs(code: str) -> dict[str, str]:
    key = S.prefix_name(code)
    return {
        S.mean_name(key, m): _guarded(f"avg({m})", [code])
        if m == S.PREFIX_FULL_CODE_MEASURE
        else f"avg({m}) OVER (PARTITION BY {_prefix_expr(code)})"
        for m in S.MONEY_AND_STAY
    }


def _count_exprs(key_sets) -> dict[str, str]:
    return {S.count_name(k): _guarded("count(ClaimID)", k) for k in key_sets}


_PROVIDERS = "(SELECT count(DISTINCT Provider) FROM merged)"


def _tfidf_exprs(code: str) -> dict[str, str]:
    tf_name, idf_name, product_name = S.tfidf_names(code)
    term = _guarded("count(ClaimID)", ["Provider", code])
    length = _guarded(f"count({code})", ["Provider"])
    rows = _guarded("count(Provider)", [code])
    tf = f"({term}) / CAST(nullif({length}, 0) AS DOUBLE)"
    idf = f"log2({_PROVIDERS} / CAST({rows} AS DOUBLE))"
    return {
        tf_name: tf,
        idf_name: f"round({idf}, 6)",
        product_name: f"round(({tf}) * ({idf}), 6)",
    }


_GROUP_EXPRS: dict[str, str] = {}
for _key in S.MEAN_FAMILIES:
    _GROUP_EXPRS |= _mean_exprs(_key)
_GROUP_EXPRS |= _count_exprs(S.COUNT_KEYS)
for _code in S.PREFIX_CODES:
    _GROUP_EXPRS |= _prefix_exprs(_code)
for _code in S.TFIDF_CODES:
    _GROUP_EXPRS |= _tfidf_exprs(_code)

_FLAGS = {
    "Gender_2": "Gender = 2",
    "Race_2": "Race = 2",
    "Race_3": "Race = 3",
    "Race_5": "Race = 5",
}
_FLAG_EXPRS = {n: f"CAST(coalesce({t}, false) AS INTEGER)" for n, t in _FLAGS.items()}

_FEATURED = f"""featured AS (
  SELECT ClaimID, src_priority, {_cols(S.BASE_NUMERICS)},
    {_select(_GROUP_EXPRS)},
    {_select(_FLAG_EXPRS)}
  FROM merged)"""
_PAIR_FEATURED = _with(*_PAIR_CTES, _FEATURED)
_FEATURES = [*S.BASE_NUMERICS, *S.GROUP_FEATURES, *_FLAGS]
_FILLED = {n: f"coalesce({_q(n)}, 0)" for n in _FEATURES}


# The matrix in unrounded form, for scaling.
def _unrounded(name: str) -> str:
    return _GROUP_EXPRS[name].removeprefix("round(").removesuffix(", 6)")


_SCALE_EXPRS = {
    n: _unrounded(n) if n in Q._LOG_FEATURES else e for n, e in _GROUP_EXPRS.items()
}
_SCALED_CTES = [
    *_PAIR_CTES,
    f"""featured AS (
  SELECT ClaimID, src_priority, {_cols(S.BASE_NUMERICS)},
    {_select(_SCALE_EXPRS)},
    {_select(_FLAG_EXPRS)}
  FROM merged)""",
    f"matrix AS (SELECT ClaimID, {_select(_FILLED)} FROM featured WHERE src_priority = 0)",
    # The history alone, as when the scaler is fitted.
    f"""past_featured AS (
  SELECT ClaimID, {_cols(S.BASE_NUMERICS)},
    {_select(_SCALE_EXPRS)},
    {_select(_FLAG_EXPRS)}
  FROM merged)""".replace("FROM merged", "FROM history"),
    f"past AS (SELECT {_select(_FILLED)} FROM past_featured)",
    "fitted AS (SELECT "
    + ", ".join(
        f"avg({_q(n)}) AS {_q('m_' + n)}, stddev_pop({_q(n)}) AS {_q('s_' + n)}" for n in _FEATURES
    )
    + " FROM past)",
]
_SCALED = {
    n: f"round(({_q(n)} - {_q('m_' + n)}) / "
    f"CASE WHEN {_q('s_' + n)} = 0 THEN 1 ELSE {_q('s_' + n)} END, 6)"
    for n in _FEATURES
}

# ------------------------------------------------------------------------ trees
# Each claim walks down each tree node by node.
_USED = Q.CHECK_TREES.features()
_UNROUNDED = {n: _SCALED[n].removeprefix("round(").removesuffix(", 6)") for n in _USED}


def _sql_value(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else repr(value)


_NODE_ROWS = ", ".join(f"({', '.join(map(_sql_value, n))})" for n in Q.CHECK_TREES.nodes)
_WALKED = _with(
    *_SCALED_CTES,
    f"nodes(tree, node, feature, threshold, left_node, right_node, value) AS (VALUES {_NODE_ROWS})",
    "facts AS ("
    + " UNION ALL ".join(f"SELECT ClaimID, '{n}' AS feature, {e} AS x FROM matrix, fitted" for n, e in _UNROUNDED.items())
    + ")",
    """walk AS (
  SELECT ClaimID, n.* FROM matrix, nodes n WHERE n.node = 0
  UNION ALL
  SELECT w.ClaimID, n.* FROM walk w JOIN facts f ON f.ClaimID = w.ClaimID AND f.feature = w.feature
  JOIN nodes n ON n.tree = w.tree AND n.node = CASE WHEN f.x <= w.threshold THEN w.left_node ELSE w.right_node END)""",
    "margins AS (SELECT ClaimID, CAST(sum(value) AS DOUBLE) AS margin FROM walk WHERE value IS NOT NULL GROUP BY ClaimID)",
).replace("WITH ", "WITH RECURSIVE ", 1)

# --------------------------------------------------------------------- sampling
_SAMPLED = _cols(_MERGED_COLUMNS)
_INDEXED = _with(
    _RAW,
    _ALL_CLAIMS,
    _prepared("claims", "raw"),
    f"indexed AS (SELECT row_number() OVER (ORDER BY ClaimID) - 1 AS row_index, {_SAMPLED} FROM claims)",
)
_TOTAL = "(SELECT count(*) FROM indexed)"


def _both(positive: str, negative: str) -> str:
    return (
        f"{_INDEXED} SELECT *, 'positive' AS argument FROM indexed WHERE {positive}\n"
        f"UNION ALL SELECT *, 'negative' AS argument FROM indexed WHERE {negative}"
    )


ORACLE: dict[str, str] = {
    "scan_history": _with(_RAW, _HISTORY_CLAIMS)
    + f"SELECT {_cols(f.name for f in S.INPATIENT)}, "
    + f"{_cols(f.name for f in S.BENEFICIARY if f.name != 'BeneID')} "
    + "FROM raw JOIN beneficiary USING (BeneID)",
    "scan_pool": _with(_RAW, _BATCH_CLAIMS, _prepared("claims", "raw"))
    + f"SELECT {_cols(_MERGED_COLUMNS)} FROM claims",
    "scan_providers": "SELECT concat('PRV', s_suppkey) AS \"Provider\" FROM supplier",
    "preview_merged": _ALL
    + f"SELECT row_number() OVER (ORDER BY ClaimID) - 1 AS row_index, {_cols(_MERGED_COLUMNS)} "
    "FROM claims ORDER BY ClaimID LIMIT 100",
    "preview_beneficiary": _with(_RAW)
    + f"SELECT row_number() OVER (ORDER BY BeneID) - 1 AS row_index, {_cols(f.name for f in S.BENEFICIARY)} "
    "FROM beneficiary ORDER BY BeneID LIMIT 100",
    **{
        f"preview_{kind}": _with(_RAW, _ALL_CLAIMS)
        + f"SELECT row_number() OVER (ORDER BY ClaimID) - 1 AS row_index, {_cols(f.name for f in fields)} "
        + f"FROM raw WHERE {test} ORDER BY ClaimID LIMIT 100"
        for kind, fields, test in (
            ("inpatient", S.INPATIENT, "is_inpatient"),
            ("outpatient", S.OUTPATIENT, "NOT is_inpatient"),
        )
    },
    "count_rows": _ALL
    + "SELECT 'beneficiary' AS table_name, count(*) AS n_rows FROM beneficiary "
    "UNION ALL SELECT 'inpatient', count(*) FROM raw WHERE is_inpatient "
    "UNION ALL SELECT 'outpatient', count(*) FROM raw WHERE NOT is_inpatient "
    "UNION ALL SELECT 'merged', count(*) FROM claims",
    "recode_flags": _with(_RAW)
    + "SELECT BeneID, Gender, Race, "
    + ", ".join(f"CASE WHEN {c} = 2 THEN 0 ELSE {c} END AS {c}" for c in S.CHRONIC_FLAGS)
    + " FROM beneficiary",
    "recode_renal": _with(_RAW)
    + "SELECT BeneID, CASE WHEN RenalDiseaseIndicator = 'Y' THEN 1 "
    "ELSE CAST(RenalDiseaseIndicator AS INTEGER) END AS RenalDiseaseIndicator FROM beneficiary",
    "parse_dates": _with(_RAW, _ALL_CLAIMS)
    + "SELECT BeneID AS id, CAST(DOB AS DATE) AS start_date, CAST(DOD AS DATE) AS end_date "
    "FROM beneficiary UNION ALL "
    "SELECT ClaimID, CAST(AdmissionDt AS DATE), CAST(DischargeDt AS DATE) "
    "FROM raw WHERE is_inpatient",
    "bene_age": _with(_RAW) + f"SELECT BeneID, CAST({_AGE} AS DOUBLE) AS Age FROM beneficiary",
    "bene_dead_flag": _with(_RAW)
    + "SELECT BeneID, CASE WHEN DOD IS NULL THEN 0 ELSE 1 END AS WhetherDead FROM beneficiary",
    "stay_days": _with(_RAW, _ALL_CLAIMS)
    + "SELECT ClaimID, CAST(date_diff('day', CAST(AdmissionDt AS DATE), CAST(DischargeDt AS DATE)) "
    "+ 1 AS INTEGER) AS AdmitForDays FROM raw WHERE is_inpatient",
    "union_claims": _with(_RAW, _ALL_CLAIMS) + f"SELECT {_select(_CLAIM_PREPARED)} FROM raw",
    "claims_join": _with(_RAW, _ALL_CLAIMS)
    + f"SELECT {_cols(f.name for f in S.INPATIENT)}, "
    + f"{_cols(f.name for f in S.BENEFICIARY if f.name != 'BeneID')} "
    + "FROM raw JOIN beneficiary USING (BeneID)",
    "prepare_claims": _ALL + f"SELECT {_cols(_MERGED_COLUMNS)} FROM claims",
    "batch_history_union": _PAIR
    + f"SELECT {_cols(_MERGED_COLUMNS)}, 0 AS src_priority FROM batch "
    + f"UNION ALL SELECT {_cols(_MERGED_COLUMNS)}, 1 FROM history",
    "dedup_keep_first": "SELECT ClaimID AS \"ClaimID\", "
    + ", ".join([*star.LINE_KEY, *star.LINE_ORDER])
    + f" FROM (SELECT *, {star.CLAIM_EXPR['ClaimID']} AS ClaimID, row_number() OVER ("
    + f"PARTITION BY {', '.join(star.LINE_KEY)} ORDER BY {', '.join(star.LINE_ORDER)}) AS rn "
    + "FROM lineitem) WHERE rn = 1",
    "dedup_batch_history": _PAIR
    + f"SELECT {_cols(_MERGED_COLUMNS)}, 0 AS src_priority FROM batch "
    + f"UNION ALL SELECT {_cols(_MERGED_COLUMNS)}, 1 FROM history "
    "WHERE ClaimID NOT IN (SELECT ClaimID FROM batch)",
    "joined_by_key": _ALL + f"SELECT {_cols(_MERGED_COLUMNS)} FROM claims",
    "merged_by_key": _PAIR
    + f"SELECT {_cols(_MERGED_COLUMNS)}, 0 AS src_priority FROM batch "
    + f"UNION ALL SELECT {_cols(_MERGED_COLUMNS)}, 1 FROM history "
    "WHERE ClaimID NOT IN (SELECT ClaimID FROM batch)",
    **{
        name: _ALL + f"SELECT ClaimID, {_select(_mean_exprs(key))} FROM claims"
        for name, key in Q.AVG_QUERIES.items()
    },
    **{
        name: _ALL
        + f"SELECT ClaimID, {_prefix_expr(code)} AS {_q(S.prefix_name(code))}, "
        + f"{_select(_prefix_exprs(code))} FROM claims"
        for name, code in Q.PREFIX_QUERIES.items()
    },
    "count_provider": _ALL + f"SELECT ClaimID, {_select(_count_exprs(S.COUNT_KEYS[:1]))} FROM claims",
    "count_provider_bene": _ALL
    + f"SELECT ClaimID, {_select(_count_exprs(S.COUNT_KEYS[1:2]))} FROM claims",
    **{
        name: _ALL + f"SELECT ClaimID, {_select(_count_exprs(sets))} FROM claims"
        for name, sets in Q.COUNT_QUERIES.items()
    },
    **{
        name: _PAIR
        + "SELECT ClaimID, Provider, "
        + ", ".join(_select(_tfidf_exprs(code)) for code in codes)
        + " FROM merged"
        for name, codes in (("tfidf_dx", S.TFIDF_DIAGNOSIS), ("tfidf_proc", S.TFIDF_PROCEDURE))
    },
    "batch_features": _PAIR_FEATURED
    + f"SELECT ClaimID, {_cols(S.GROUP_FEATURES)} FROM featured WHERE src_priority = 0",
    "history_statistics": _PAIR
    + "\nUNION ALL ".join(
        f"SELECT '{S.count_name(keys)}' AS key_set, "
        + ", ".join(f"{keys[i]} AS key_{i}" if i < len(keys) else f"'' AS key_{i}" for i in range(4))
        + ", count(ClaimID) AS n, count(*) AS n_rows FROM history WHERE "
        + " AND ".join(f"{k} IS NOT NULL" for k in keys)
        + " GROUP BY ALL"
        for keys in S.COUNT_KEYS
        if len(keys) > 1
    ),
    "stored_features": _PAIR_FEATURED
    + f"SELECT ClaimID, {_cols(S.GROUP_FEATURES)} FROM featured WHERE src_priority = 0",
    # The half that is added first is part of the history; without it in front, the same merged claims.
    "second_batch_features": _PAIR_FEATURED
    + f"SELECT ClaimID, {_cols(S.GROUP_FEATURES)} FROM featured "
    "WHERE src_priority = 0 AND CAST(substr(ClaimID, 4) AS BIGINT) % 2 <> 0",
    "onehot_gender_race": _PAIR + f"SELECT ClaimID, {_select(_FLAG_EXPRS)} FROM batch",
    "fill_zero": _ALL
    + "SELECT "
    + ", ".join(f"coalesce({n}, 0) AS {_q(n)}" if n in _NUMERIC else _q(n) for n in _MERGED_COLUMNS)
    + " FROM claims",
    "feature_matrix": _PAIR_FEATURED
    + f"SELECT ClaimID, {_select(_FILLED)} FROM featured WHERE src_priority = 0",
    "standard_scale": _with(*_SCALED_CTES)
    + f"SELECT ClaimID, {_select(_SCALED)} FROM matrix, fitted",
    "assemble_features": _with(*_SCALED_CTES)
    + f"SELECT ClaimID, CAST({len(_FEATURES)} AS BIGINT) AS n_features, "
    + f"CAST({' + '.join(f'CAST({_q(n)} <> 0 AS BIGINT)' for n in _FEATURES)} AS BIGINT) AS n_filled, "
    + f"round({' + '.join(f'CAST({_q(n)} AS DOUBLE)' for n in _FEATURES)}, 4) AS total FROM matrix",
    "predict_claims": _WALKED
    + f"SELECT ClaimID, margin, CAST(margin > 0 AS INTEGER) AS {_q(S.PREDICTION)} FROM margins",
    "scored_sink": _WALKED
    + f"SELECT {', '.join(f'b.{_q(n)}' for n in _MERGED_COLUMNS)}, "
    + f"CAST(margin > 0 AS INTEGER) AS {_q(S.PREDICTION)}, "
    "CASE CAST(substr(ClaimID, 4) AS BIGINT) % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS batch "
    "FROM batch b JOIN margins USING (ClaimID)",
    "row_index": _INDEXED + "SELECT * FROM indexed",
    "sample_top": _both("row_index < 250", f"row_index < {_TOTAL} - 250"),
    "sample_bottom": _both(f"row_index >= {_TOTAL} - 250", "row_index >= 250"),
    "sample_random": _INDEXED
    + f"SELECT * FROM indexed ORDER BY md5(concat('{Q.SAMPLE_SEED}-', row_index)), row_index LIMIT 1000",
    "sample_at_position": _both("row_index = 17", f"row_index = {_TOTAL} - 17"),
    "sample_at_label": _INDEXED + "SELECT * FROM indexed WHERE row_index = 17",
    "sample_slice": _both(
        "row_index >= 100 AND row_index < 400",
        f"row_index >= {_TOTAL} - 400 AND row_index < {_TOTAL} - 100",
    ),
    "sample_between": _both(
        "row_index BETWEEN 100 AND 400", "row_index BETWEEN -400 AND 100"
    ),
    "sample_guard": _INDEXED
    + "SELECT pick, n_rows, n_rows = 0 AS refused FROM ("
    "SELECT 'slice' AS pick, count(*) AS n_rows FROM indexed WHERE row_index >= 100 AND row_index < 400 "
    f"UNION ALL SELECT 'slice_past_the_end', count(*) FROM indexed WHERE row_index >= {_TOTAL} "
    "UNION ALL SELECT 'top_of_none', count(*) FROM indexed WHERE row_index < 0 "
    "UNION ALL SELECT 'all', count(*) FROM indexed)",
}
