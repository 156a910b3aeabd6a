"""The registered queries: every operator over the whole supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import schemas as S
from claimscope.operators import encode, keyed, prepare, sampling
from claimscope.functions.claims import code_prefix, named, quoted
from claimscope.operators.forest import Forest
from claimscope.operators.group_features import group_count, group_counts, group_means
from claimscope.operators.positions import PositionIndex
from claimscope.plans.features import (
    COMPOSITE_KEYS,
    ROW_ID,
    ClaimPool,
    batch_features,
    feature_matrix,
)
from claimscope.plans.history_store import HistoryStore, history_moments
from claimscope.plans.scoring import ClaimScorer, assemble
from claimscope.plans.tables import kept_history, once, prepared
from claimscope.sources import star
from claimscope.sources.csv_tables import load_claims, read_providers, read_raw
from claimscope.sources.keyed_layout import KeyedTable, buckets_for, merge_by_key
from claimscope.sources.sink import BatchSink
from claimscope.sources.staging import stage, staging_root

SAMPLE_SEED = 42


# ------------------------------------------------------------ sources and sinks
def _as_csv(df: DataFrame, name: str) -> str:
    """The table as CSV files, for the CSV reader to read."""
    path = f"{staging_root(df.sparkSession)}/csv-{name}-{uuid.uuid4().hex}"
    df.write.csv(path, header=True)
    return path


def _csv_paths(tables) -> list[str]:
    return [_as_csv(t, n) for t, n in zip(tables, ("beneficiary", "inpatient", "outpatient"))]


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history tables from CSV: raw claims with their raw beneficiary."""
    paths = _csv_paths(star.history_tables(spark, sf_dir))
    ben, inp, out = read_raw(spark, *paths)
    return prepare.join_beneficiaries(prepare.union_claims(inp, out), ben)


def scan_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch pool from CSV: its merged table."""
    paths = _csv_paths(star.batch_tables(spark, sf_dir))
    return load_claims(spark, *paths).claims


def scan_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = star.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("PRV"), F.col("s_suppkey").cast("string")).alias("Provider")
    )
    return read_providers(spark, _as_csv(listed, "providers"))


def preview_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred merged claims, all columns."""
    return sampling.first_rows(prepared(spark, sf_dir, "all"), ["ClaimID"])


def preview_beneficiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_rows(star.beneficiary(spark, sf_dir), ["BeneID"])


def preview_inpatient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_rows(star.all_tables(spark, sf_dir)[1], ["ClaimID"])


def preview_outpatient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_rows(star.all_tables(spark, sf_dir)[2], ["ClaimID"])


def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ben, inp, out = star.all_tables(spark, sf_dir)
    named = {
        "beneficiary": ben,
        "inpatient": inp,
        "outpatient": out,
        "merged": prepared(spark, sf_dir, "all"),
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n, df in named.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# ----------------------------------------------------------------- preparation
def recode_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    recoded = prepare.recode_flags(star.beneficiary(spark, sf_dir))
    return recoded.select("BeneID", "Gender", "Race", *S.CHRONIC_FLAGS)


def recode_renal(spark: SparkSession, sf_dir: str) -> DataFrame:
    recoded = prepare.recode_renal(star.beneficiary(spark, sf_dir))
    return recoded.select("BeneID", "RenalDiseaseIndicator")


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ben, inp, _ = star.all_tables(spark, sf_dir)
    births = prepare.parse_birth_and_death(ben).select(
        F.col("BeneID").alias("id"), F.col("DOB").alias("start_date"), F.col("DOD").alias("end_date")
    )
    stays = prepare.parse_stay(inp).select(
        F.col("ClaimID").alias("id"),
        F.col("AdmissionDt").alias("start_date"),
        F.col("DischargeDt").alias("end_date"),
    )
    return births.unionByName(stays)


def bene_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = prepare.parse_birth_and_death(star.beneficiary(spark, sf_dir))
    return prepare.add_age(dated).select("BeneID", "Age")


def bene_dead_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = prepare.parse_birth_and_death(star.beneficiary(spark, sf_dir))
    return prepare.add_dead_flag(dated).select("BeneID", "WhetherDead")


def stay_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, inp, _ = star.all_tables(spark, sf_dir)
    return prepare.prepare_inpatient(inp).select("ClaimID", "AdmitForDays")


def union_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, inp, out = star.all_tables(spark, sf_dir)
    return prepare.union_claims(prepare.prepare_inpatient(inp), out)


def claims_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ben, inp, out = star.all_tables(spark, sf_dir)
    return prepare.join_beneficiaries(prepare.union_claims(inp, out), ben)


def prepare_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prepare_claims(*star.all_tables(spark, sf_dir))


def joined_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared claims from claims and beneficiaries laid out by ``BeneID``, joined without a shuffle."""
    ben, inp, out = star.all_tables(spark, sf_dir)
    claims = stage(prepare.union_claims(prepare.prepare_inpatient(inp), out), "claims")
    patients = stage(prepare.prepare_beneficiary(ben), "patients")
    n = buckets_for(claims, patients)
    return KeyedTable.write(claims, "BeneID", "claims", n).lookup(KeyedTable.write(patients, "BeneID", "patients", n))


# ------------------------------------------------------------ batch and history
def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return prepared(spark, sf_dir, "batch"), prepared(spark, sf_dir, "history")


def batch_history_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.batch_history_union(*_pair(spark, sf_dir))


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines with their surplus copies, one kept per claim id."""
    lines = star.table(spark, sf_dir, "lineitem").withColumn(
        "ClaimID", F.expr(star.CLAIM_EXPR["ClaimID"])
    )
    return keyed.keep_first(lines, "ClaimID", star.LINE_ORDER).select("ClaimID", *star.LINE_KEY, *star.LINE_ORDER)


def dedup_batch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked claims, one kept per claim id: the batch copy wins."""
    return keyed.merge_batch_history(*_pair(spark, sf_dir))


def merged_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dedup_batch_history`` on claims laid out by ``ClaimID``: neither side is shuffled."""
    batch, history = _pair(spark, sf_dir)
    n = buckets_for(batch, history)
    return merge_by_key(KeyedTable.write(batch, "ClaimID", "batch", n), KeyedTable.write(history, "ClaimID", "history", n))


# --------------------------------------------------------------- group features
def avg_by(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {S.mean_name(key, m): m for m in S.MEAN_FAMILIES[key]}
    means = group_means(prepared(spark, sf_dir, "all"), [key], names)
    return means.select("ClaimID", *names)


def avg_by_prefix(code: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = S.prefix_name(code)
    claims = prepared(spark, sf_dir, "all").withColumn(prefix, code_prefix(F.col(code)))
    names = {S.mean_name(prefix, m): m for m in S.MONEY_AND_STAY}
    full = S.mean_name(prefix, S.PREFIX_FULL_CODE_MEASURE)
    by_code = {full: names.pop(full)}
    means = group_means(group_means(claims, [prefix], names), [code], by_code)
    return means.select("ClaimID", prefix, *names, full)


def count_by(keys: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    name = S.count_name(keys)
    return group_count(prepared(spark, sf_dir, "all"), keys, name).select("ClaimID", name)


def count_sets(picked: list[tuple[str, ...]], spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {S.count_name(keys): keys for keys in picked}
    return group_counts(prepared(spark, sf_dir, "all"), names).select("ClaimID", *names)


def _tfidf(codes: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF / IDF of every claim of batch and history; logarithms to six places."""
    pool = ClaimPool(*_pair(spark, sf_dir), everything=True)
    values = pool.tfidf(codes)
    tf = [f"{c}TF" for c in codes]
    logs = [n for c in codes for n in S.tfidf_names(c)[1:]]
    rounded = [named(f"round({quoted(n)}, 6)", n) for n in logs]
    return values.selectExpr("ClaimID", "Provider", *tf, *rounded)


# ------------------------------------------------------------ the feature frame
_LOG_FEATURES = {n for c in S.TFIDF_CODES for n in S.tfidf_names(c)[1:]}


def _rounded_logs(df: DataFrame, names: list[str]) -> DataFrame:
    def value(name: str) -> str:
        column = quoted(name)
        return named(f"round({column}, 6)", name) if name in _LOG_FEATURES else column

    return df.selectExpr(ROW_ID, *map(value, names))


def batch_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = batch_features(*_pair(spark, sf_dir))
    return _rounded_logs(frame, S.GROUP_FEATURES)


def onehot_gender_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, history = _pair(spark, sf_dir)
    levels = encode.fit_levels(keyed.merge_batch_history(batch, history, columns=S.CATEGORIES), S.CATEGORIES)
    flags = [S.onehot_name(c, v) for c in S.CATEGORIES for v in levels[c][1:]]
    return encode.one_hot(batch, levels).select("ClaimID", *flags)


def fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.fill_zero(prepared(spark, sf_dir, "all"))


def feature_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = feature_matrix(*_pair(spark, sf_dir))
    return _rounded_logs(matrix.frame, matrix.names)


def history_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of the history per key of several columns: claims with an id, and rows."""
    names = ", ".join(f"{i}, '{S.count_name(keys)}'" for i, keys in enumerate(COMPOSITE_KEYS))
    return kept_history(spark, sf_dir).sums("composites").selectExpr(
        f"element_at(map({names}), set_id) AS key_set", "key_0", "key_1", "key_2", "key_3", "n", "n_rows"
    )


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the batch over the kept statistics of the history."""
    frame = batch_features(prepared(spark, sf_dir, "batch"), kept_history(spark, sf_dir))
    return _rounded_logs(frame, S.GROUP_FEATURES)


def second_batch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the batch made part of a kept history, features of the other half over it."""
    batch, history = _pair(spark, sf_dir)
    store = HistoryStore.create(history, f"{staging_root(spark)}/second-batch-{uuid.uuid4().hex}")
    first = "CAST(substring(ClaimID, 4) AS BIGINT) % 2 = 0"
    store.add(stage(batch.filter(first), "first-half"), "first half")
    frame = batch_features(stage(batch.filter(f"NOT {first}"), "second-half"), store)
    return _rounded_logs(frame, S.GROUP_FEATURES)


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix of the batch, standardised as the history was, to six places."""
    store = kept_history(spark, sf_dir)
    levels = store.own_pool().levels()
    scaler = history_moments(store, levels).scaler()
    matrix = feature_matrix(prepared(spark, sf_dir, "batch"), store, levels)
    scaled = scaler.transform(matrix.frame)
    return scaled.selectExpr(
        ROW_ID, *[named(f"round({quoted(n)}, 6)", n) for n in matrix.names]
    )


# -------------------------------------------------------------------- the model
def _provider_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("PRV"), F.col("s_suppkey").cast("string")).alias("Provider"),
        (F.col("s_suppkey") % 10 < 3).cast("int").alias("label"),
    )


def _fitted(spark: SparkSession, sf_dir: str) -> ClaimScorer:
    """The classifier fitted on the whole history, on first use."""
    labels = _provider_labels(spark, sf_dir)
    return once(spark, sf_dir, "scorer", lambda: ClaimScorer.fit(kept_history(spark, sf_dir), labels))


def fit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trees fitted on the whole history."""
    return _fitted(spark, sf_dir).forest.table(spark)


def score_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch claims with a predicted label, from the trees fitted on the whole history."""
    batch = prepared(spark, sf_dir, "batch")
    return _fitted(spark, sf_dir).score(batch, kept_history(spark, sf_dir))


# Trees to check predictions with: every kind of feature, in units of the scaled matrix.
CHECK_TREES = Forest((
    (0, 0, "PerProviderAvg_InscClaimAmtReimbursed", 0.25, 1, 2, None),
    (0, 1, "ClmCount_Provider", -0.5, 3, 4, None),
    (0, 2, "Age", 0.4, 5, 6, None),
    (0, 3, None, None, None, None, -0.75),
    (0, 4, None, None, None, None, 0.25),
    (0, 5, None, None, None, None, 0.5),
    (0, 6, None, None, None, None, 1.0),
    (1, 0, "ClmDiagnosisCode_1TF-IDF", 0.1, 1, 2, None),
    (1, 1, "Gender_2", 0.0, 3, 4, None),
    (1, 2, None, None, None, None, -0.5),
    (1, 3, None, None, None, None, 0.125),
    (1, 4, None, None, None, None, -0.375),
    (2, 0, "PerClmDiagnosisCode_2_GrpAvg_AdmitForDays", 0.0, 1, 2, None),
    (2, 1, None, None, None, None, 0.0625),
    (2, 2, "ClmCount_Provider_ClmDiagnosisCode_3", 0.3, 3, 4, None),
    (2, 3, None, None, None, None, -0.0625),
    (2, 4, None, None, None, None, 0.3125),
))


def _check_scorer(spark: SparkSession, sf_dir: str) -> ClaimScorer:
    store = kept_history(spark, sf_dir)
    levels = store.own_pool().levels()
    return ClaimScorer(levels, history_moments(store, levels).scaler(), CHECK_TREES)


def predict_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin and label of every batch claim by given trees."""
    batch, store = prepared(spark, sf_dir, "batch"), kept_history(spark, sf_dir)
    margins = _check_scorer(spark, sf_dir).margins(batch, store)
    return margins.withColumn(S.PREDICTION, (F.col("margin") > 0).cast("int"))


def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of the batch as one vector per claim: its length, filled places and sum to four places."""
    store = kept_history(spark, sf_dir)
    levels = store.own_pool().levels()
    matrix = feature_matrix(prepared(spark, sf_dir, "batch"), store, levels)
    vectors = assemble(matrix.frame, matrix.names).select(ROW_ID, vector_to_array("features").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    filled = F.size(F.filter("v", lambda x: x != 0)).cast("long")
    return vectors.select(ROW_ID, F.size("v").cast("long").alias("n_features"), filled.alias("n_filled"), F.round(total, 4).alias("total"))


def scored_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored batch claims written as two batches, the first one twice, and read back."""
    batch = prepared(spark, sf_dir, "batch")
    scored = stage(_check_scorer(spark, sf_dir).score(batch, kept_history(spark, sf_dir)), "scored")
    sink = BatchSink(spark, f"{staging_root(spark)}/scored-{uuid.uuid4().hex}")
    for name, part in (("even", 0), ("odd", 1), ("even", 0)):
        sink.write(scored.filter(f"CAST(substring(ClaimID, 4) AS BIGINT) % 2 = {part}"), name)
    return sink.read().select(*batch.columns, S.PREDICTION, "batch")


# --------------------------------------------------------------------- sampling
def _index(spark: SparkSession, sf_dir: str) -> PositionIndex:
    """All merged claims in order of their id, written on first use."""

    def make() -> PositionIndex:
        path = f"{staging_root(spark)}/positions-{uuid.uuid4().hex}"
        return PositionIndex.write(prepared(spark, sf_dir, "all"), ["ClaimID"], path)

    return once(spark, sf_dir, "positions", make)


def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).frame()


def _sampled(pick: Callable[[PositionIndex], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(_index(spark, sf_dir))


def _sample_top(index: PositionIndex) -> DataFrame:
    return _both(index.top(250), index.top(-250))


def _sample_bottom(index: PositionIndex) -> DataFrame:
    return _both(index.bottom(250), index.bottom(-250))


def _sample_random(index: PositionIndex) -> DataFrame:
    return index.random_rows(1000, seed=SAMPLE_SEED)


def _sample_at_position(index: PositionIndex) -> DataFrame:
    return _both(index.at_position(17), index.at_position(-17))


def _sample_at_label(index: PositionIndex) -> DataFrame:
    return index.at_label(17)


def _sample_slice(index: PositionIndex) -> DataFrame:
    return _both(index.slice_positions(100, 400), index.slice_positions(-400, -100))


def _sample_between(index: PositionIndex) -> DataFrame:
    return _both(index.between_labels(100, 400), index.between_labels(-400, 100))


def sample_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks that must hold rows: how many each has, or that it was refused."""
    index = _index(spark, sf_dir)
    picks = {
        "slice": index.slice_positions(100, 400),
        "slice_past_the_end": index.slice_positions(index.total, index.total + 10),
        "top_of_none": index.top(-index.total),
        "all": index.bottom(index.total),
    }
    rows = []
    for name, pick in picks.items():
        try:
            rows.append((name, sampling.require_rows(pick).count(), False))
        except ValueError:
            rows.append((name, 0, True))
    return spark.createDataFrame(rows, "pick string, n_rows long, refused boolean")


def _both(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Results for a positive and a negative argument, told apart."""
    return positive.withColumn("argument", F.lit("positive")).unionByName(
        negative.withColumn("argument", F.lit("negative"))
    )


Query = Callable[[SparkSession, str], DataFrame]

AVG_QUERIES = {
    "avg_by_provider": "Provider",
    "avg_by_bene": "BeneID",
    "avg_by_attending": "AttendingPhysician",
    "avg_by_operating": "OperatingPhysician",
    "avg_by_dxgroup": "DiagnosisGroupCode",
    "avg_by_admit_dx": "ClmAdmitDiagnosisCode",
    "avg_by_proc1": "ClmProcedureCode_1",
    "avg_by_proc2": "ClmProcedureCode_2",
    "avg_by_dx1": "ClmDiagnosisCode_1",
    "avg_by_dx2": "ClmDiagnosisCode_2",
    "avg_by_dx3": "ClmDiagnosisCode_3",
}
PREFIX_QUERIES = {f"avg_by_dx{i}_prefix": c for i, c in enumerate(S.PREFIX_CODES, start=1)}
# Positions in the list of count key sets.
COUNT_QUERIES = {
    "count_by_physician": S.COUNT_KEYS[2:5],
    "count_by_code": S.COUNT_KEYS[5:21],
    "count_deep": S.COUNT_KEYS[21:29],
}

QUERIES: dict[str, Query] = {
    "scan_history": scan_history,
    "scan_pool": scan_pool,
    "scan_providers": scan_providers,
    "preview_merged": preview_merged,
    "preview_beneficiary": preview_beneficiary,
    "preview_inpatient": preview_inpatient,
    "preview_outpatient": preview_outpatient,
    "count_rows": count_rows,
    "recode_flags": recode_flags,
    "recode_renal": recode_renal,
    "parse_dates": parse_dates,
    "bene_age": bene_age,
    "bene_dead_flag": bene_dead_flag,
    "stay_days": stay_days,
    "union_claims": union_claims,
    "claims_join": claims_join,
    "prepare_claims": prepare_claims,
    "batch_history_union": batch_history_union,
    "dedup_keep_first": dedup_keep_first,
    "dedup_batch_history": dedup_batch_history,
    "joined_by_key": joined_by_key,
    "merged_by_key": merged_by_key,
    **{name: partial(avg_by, key) for name, key in AVG_QUERIES.items()},
    **{name: partial(avg_by_prefix, code) for name, code in PREFIX_QUERIES.items()},
    "count_provider": partial(count_by, S.COUNT_KEYS[0]),
    "count_provider_bene": partial(count_by, S.COUNT_KEYS[1]),
    **{name: partial(count_sets, sets) for name, sets in COUNT_QUERIES.items()},
    "tfidf_dx": partial(_tfidf, S.TFIDF_DIAGNOSIS),
    "tfidf_proc": partial(_tfidf, S.TFIDF_PROCEDURE),
    "batch_features": batch_features_query,
    "history_statistics": history_statistics,
    "stored_features": stored_features,
    "second_batch_features": second_batch_features,
    "onehot_gender_race": onehot_gender_race,
    "fill_zero": fill_zero,
    "feature_matrix": feature_matrix_query,
    "standard_scale": standard_scale,
    "assemble_features": assemble_features,
    "predict_claims": predict_claims,
    "scored_sink": scored_sink,
    "fit_claims": fit_claims,
    "score_claims": score_claims,
    "row_index": row_index,
    "sample_top": partial(_sampled, _sample_top),
    "sample_bottom": partial(_sampled, _sample_bottom),
    "sample_random": partial(_sampled, _sample_random),
    "sample_at_position": partial(_sampled, _sample_at_position),
    "sample_at_label": partial(_sampled, _sample_at_label),
    "sample_slice": partial(_sampled, _sample_slice),
    "sample_between": partial(_sampled, _sample_between),
    "sample_guard": sample_guard,
}
