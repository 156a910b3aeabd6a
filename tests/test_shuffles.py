"""How often rows are shuffled, with the same results at every limit."""

import glob
import os
import time

from pyspark.sql import functions as F

from conftest import plan_of, rows

from claimscope.operators import group_features, keyed
from claimscope.operators.group_features import KeyPlan, KeySet, attach, attach_counts, keyed_table, per_key
from claimscope.plans import queries
from claimscope.plans.history_store import HistoryStore
from claimscope.plans.tables import prepared
from claimscope.sources import star
from claimscope.sources.staging import stage, staging_root

PLAN = KeyPlan([KeySet(("p", "a")), KeySet(("p", "b")), KeySet(("p", "a", "b"))])


def _claims(spark):
    made = [(i, f"P{min(i % 7, 2)}" if i % 11 else None, f"a{i % 5}" if i % 3 else None, f"b{i % 4}") for i in range(400)]
    return stage(spark.createDataFrame(made, "n long, p string, a string, b string"), "made")


def test_sets_with_one_first_key_shuffle_claims_once_by_it(spark):
    claims = _claims(spark)
    wanted = PLAN.melt(claims, "n").groupBy(*PLAN.columns).agg(F.sum("n").alias("s"), F.count("n").alias("c"))
    aggregates = [F.sum("n").alias("s"), F.count("n").alias("c")]
    whole = per_key(claims, PLAN, aggregates, ["n"])
    assert plan_of(whole).count("Exchange hashpartitioning(key_0") == 1
    assert plan_of(whole).count("Exchange") == 1
    # P2 holds most claims: grouped apart by the second call, and all keys by the third.
    for found in (whole, per_key(claims, PLAN, aggregates, ["n"], 0.4, 0), per_key(claims, PLAN, aggregates, ["n"], 0.0, 0, 10)):
        assert rows(found, *PLAN.columns) == rows(wanted, *PLAN.columns)


def test_chosen_sets_alone_are_made(spark):
    found = per_key(_claims(spark), PLAN.only({1}), [F.count("n").alias("c")], ["n"])
    assert {r.set_id for r in found.collect()} == {1}


def test_lines_are_shuffled_once_for_first_copies_and_orders(spark, tmp_path):
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    line += "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    made = spark.range(40).selectExpr(
        "id % 6 AS l_orderkey", "id % 5 AS l_partkey", "id % 3 AS l_suppkey", "cast(id % 4 AS int) AS l_linenumber",
        "1D AS l_quantity", "cast(id AS double) AS l_extendedprice", "0D AS l_discount", "0D AS l_tax",
        "if(id % 2 = 0, 'R', 'N') AS l_returnflag", "'O' AS l_linestatus", "timestamp '2000-01-01' AS l_shipdate",
    )
    assert made.columns == [c.split()[0] for c in line.split(", ")]
    made.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5).selectExpr("id AS o_orderkey", "id AS o_custkey", "timestamp '2000-01-01' AS o_orderdate").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claims = star._claims(spark, str(tmp_path), "true")
        shuffles = [p for p in plan_of(claims).splitlines() if "Exchange hashpartitioning(l_orderkey" in p]
        assert len(shuffles) == 1
        found = claims.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_partkey"), F.first("l_partkey"))
        for r in found.collect():
            copies = [i for i in range(40) if (i % 6, i % 4) == (r.l_orderkey, r.l_linenumber)]
            assert (r.n, r[3], r[4]) == (1, min(i % 5 for i in copies), min(i % 5 for i in copies))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def _sides(spark):
    batch = [("A", 1, "x"), ("B", 2, "x"), (None, 3, "x"), ("A", 0, "x")]
    history = [("A", 9, "y"), ("C", 8, "y"), ("C", 7, "y"), (None, 6, "y"), ("D", 5, "y")]
    return [stage(spark.createDataFrame(t, "ClaimID string, v int, w string"), "side") for t in (batch, history)]


def test_shared_keys_are_dropped_without_a_shuffle_of_all_rows(spark):
    wanted = [(None, 3, "x", 0), ("A", 0, "x", 0), ("B", 2, "x", 0), ("C", 7, "y", 1), ("D", 5, "y", 1)]
    for hashes in (100, 0):
        before = set(os.listdir(staging_root(spark)))
        merged = keyed.merge_batch_history(*_sides(spark), broadcast_rows=0, broadcast_hashes=hashes)
        assert rows(merged, "ClaimID") == wanted
        written = {n.rsplit("-", 1)[0] for n in set(os.listdir(staging_root(spark))) - before}
        assert ("merged" in written) == (hashes == 0)


def test_rows_of_shared_keys_are_found_by_hashes_of_the_keys(spark):
    batch, history = _sides(spark)
    ids = batch.select(F.col("ClaimID").alias("_id")).distinct()
    for hashes in (100, 0):
        found = keyed.rows_with_ids(history, ids, "ClaimID", hashes)
        assert rows(found, "v") == [(None, 6, "y"), ("A", 9, "y")]
        scans = [line for line in plan_of(found).splitlines() if "xxhash64(ClaimID" in line]
        assert bool(scans) == (hashes > 0)


def test_kept_columns_do_not_change_which_copy_stays(spark):
    for limit in (0, 100):
        merged = keyed.merge_batch_history(*_sides(spark), broadcast_rows=limit, columns=["v"])
        assert merged.columns == ["ClaimID", "v", keyed.SOURCE]
        assert [r.v for r in merged.orderBy("ClaimID").collect()] == [3, 0, 2, 7, 5]


def test_levels_are_read_from_few_columns(spark, sf_dir, monkeypatch):
    seen = []
    real = queries.encode.fit_levels
    monkeypatch.setattr(queries.encode, "fit_levels", lambda df, columns: seen.append(df.columns) or real(df, columns))
    queries.onehot_gender_race(spark, sf_dir)
    assert seen == [["ClaimID", "Gender", "Race", keyed.SOURCE]]


def _counted(claims, **limits):
    marked = claims.withColumnRenamed("n", "ClaimID").withColumns({"has_id": F.expr("ClaimID % 10 > 0"), "in_batch": F.lit(True)})
    return attach_counts(marked, PLAN, "_count", **limits)


def test_groups_with_one_first_key_are_counted_where_claims_lie(spark):
    claims = _claims(spark)
    whole, texts = _counted(claims)
    assert plan_of(whole).count("Exchange") == 1
    made = claims.orderBy("n").collect()
    wanted = []
    for r in made:
        counts = []
        for s in PLAN.sets:
            key = tuple(r[k] for k in s.keys)
            same = [o for o in made if tuple(o[k] for k in s.keys) == key and o.n % 10 > 0]
            counts.append(None if None in key else len(same))
        wanted.append((r.n, *counts))
    # P2 holds most claims: looked up apart by the second call, and all keys by the third.
    for limits in ({}, {"share": 0.4, "hot_claims": 0}, {"share": 0.0, "hot_claims": 0, "broadcast_rows": 0, "claims_per_task": 10}):
        found, texts = _counted(claims, **limits)
        assert rows(found.select("ClaimID", *[texts[i] for i in range(3)]), "ClaimID") == wanted


def test_map_side_values_are_not_shuffled(spark):
    plan = KeyPlan([KeySet(("a",)), KeySet(("n",))])
    claims = _claims(spark).withColumn("in_batch", F.lit(True))
    table = keyed_table(claims, plan, {"c": F.count("*")}, "array(c, c)")
    # Five keys of the one set are broadcast, 400 of the other are looked up by a shuffle.
    found, texts = attach(claims, table, plan, 400, "_v", broadcast_rows=10, row_id="n")
    plan_text = plan_of(found.select("n", *texts.values()))
    assert "Exchange hashpartitioning" in plan_text
    top = plan_text.splitlines()
    shuffled = min(i for i, line in enumerate(top) if "Exchange hashpartitioning" in line)
    assert any("BroadcastHashJoin" in line for line in top[:shuffled])
    got = {r[0]: (r[1], r[2]) for r in found.select("n", texts[0], texts[1]).collect()}
    assert got[1] == ([53, 53], [1, 1]) and got[0] == (None, [1, 1])


def test_claims_of_a_bucket_are_written_by_several_tasks(spark, sf_dir, tmp_path):
    history = prepared(spark, sf_dir, "history")
    store = HistoryStore.create(history, f"{tmp_path}/history", rows_per_bucket=history.count() // 2 + 1)
    assert store._state().buckets == 2
    files = {b: glob.glob(f"{tmp_path}/history/claims/version=1/id_bucket={b}/*.parquet") for b in (0, 1)}
    assert all(len(names) > 1 for names in files.values())
    assert store.claims().count() == history.select("ClaimID").distinct().count()


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = _shuffle_files(spark), spark.conf.get(name)
    written = stage(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")), "counts")
    assert written.count() == 700
    for _ in range(50):
        # The files of the count just above may be left.
        left = {f.split("_")[1] for f in _shuffle_files(spark) - before}
        if len(left) <= 1:
            break
        time.sleep(0.2)
    assert len(left) <= 1
    assert spark.conf.get(name) == kept


def test_many_sets_are_counted_by_one_sort_of_thin_rows(spark, monkeypatch):
    claims = _claims(spark)
    wanted, texts = _counted(claims)
    wanted = rows(wanted.select("ClaimID", *texts.values()), "ClaimID")
    monkeypatch.setattr(group_features, "WINDOW_SETS", 0)
    whole, _ = _counted(claims)
    text = plan_of(whole)
    assert text.count("Exchange hashpartitioning(key_0") == 1 and text.count("Window [") == 1
    for limits in ({}, {"share": 0.4, "hot_claims": 0}, {"share": 0.0, "hot_claims": 0, "broadcast_rows": 0, "claims_per_task": 10}):
        found, texts = _counted(claims, **limits)
        assert rows(found.select("ClaimID", *texts.values()), "ClaimID") == wanted


def test_tables_by_the_first_key_are_looked_up_without_a_shuffle_of_thin_rows(spark):
    claims = _claims(spark).withColumn("in_batch", F.lit(True))
    table = keyed_table(claims, PLAN, {"c": F.count("*")}, "c")
    texts = {i: f"v_{i}" for i in range(3)}
    wanted = rows(group_features._looked_up(claims, table, PLAN, texts, 400, 1e-3, 0, "n"), "n")
    # The second call takes P2 and the third all first keys apart.
    for limits in ({}, {"share": 0.4, "hot_claims": 0}, {"share": 0.0, "hot_claims": 0}):
        found = group_features._looked_up_beside(claims, table, PLAN, texts, limits.pop("share", 1e-3), 0, "n", **limits)
        assert rows(found, "n") == wanted

    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        thin = PLAN.melt_beside(group_features.dealt(claims, PLAN, ["n"], [], 5), "n")
        values = table.repartition(5, "key_0")
        for how, hashed, join in (
            ("inner", False, "SortMergeJoin"),
            ("inner", True, "BuildRight"),
            ("left", True, "LeftOuter, BuildLeft"),
        ):
            found = group_features.join_beside(thin, values, PLAN, how, hashed)
            text = plan_of(found)
            assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") == 2 and join in text
            assert found.count() == thin.count()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
