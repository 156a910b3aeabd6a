"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``2 ** RING_BITS`` places. Every shard has ``VIRTUAL`` nodes on it; a row goes clockwise from the place of its id to the next
node. A shard that is full passes its rows on to the next node clockwise whose shard has room. How many rows of which arc go where
is worked out from the counts per arc, a table whose size depends on the ring alone; the rows of an arc are then
dealt out by their rank. With no slack the capacities add up to the rows, so the counts of two shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import let, load, stage

RING_BITS, VIRTUAL = 16, 256
PLACES = 1 << RING_BITS


def _place(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(PLACES)).cast("int")


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """``place, node``: for each place the place of the next node clockwise, and ``shard``, whose node it is."""
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("copy"))
    nodes = nodes.select(_place(F.lit("node"), "shard", "copy").alias("place"), "shard").groupBy("place").agg(F.min("shard").alias("shard"))
    places = spark.range(PLACES).select(F.col("id").cast("int").alias("place")).join(nodes, "place", "left")
    here = F.when(F.col("shard").isNotNull(), F.struct(F.col("place").alias("node"), "shard"))
    ahead = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    around = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.last(here, ignorenulls=True).over(ahead), F.first(here, ignorenulls=True).over(around))
    return places.select("place", following.alias("next")).select("place", "next.node", "next.shard")


def _pieces(arcs: Column, capacity: Column) -> Column:
    """Which ranks ``lo`` up to ``hi`` of each arc go to which shard, and the shard's rows before them."""
    piece = "array<struct<node:int,lo:bigint,hi:bigint,shard:int,before:bigint>>"

    def place(state: Column, shard: Column, node: Column) -> Column:
        free = F.get(state["free"], shard)
        taken = F.least(state["left"], free)
        new = F.struct(node.alias("node"), state["lo"].alias("lo"), (state["lo"] + taken).alias("hi"), shard.alias("shard"), (F.get(capacity, shard) - free).alias("before"))
        return F.struct(
            (state["left"] - taken).alias("left"),
            (state["lo"] + taken).alias("lo"),
            F.transform(state["free"], lambda f, i: F.when(i == shard, f - taken).otherwise(f)).alias("free"),
            F.when(taken > 0, F.concat(state["out"], F.array(new))).otherwise(state["out"]).alias("out"),
        )

    def arc(state: Column, a: Column) -> Column:
        start = F.struct(a["n"].alias("left"), F.lit(0).cast("long").alias("lo"), state["free"].alias("free"), F.array().cast(piece).alias("out"))
        done = F.aggregate(a["clockwise"], start, lambda s, shard: place(s, shard, a["node"]))
        both = F.transform(F.array(done), lambda d: F.struct(d["free"].alias("free"), F.concat(state["out"], d["out"]).alias("out")))
        return F.element_at(both, 1)

    return F.aggregate(arcs, F.struct(capacity.alias("free"), F.array().cast(piece).alias("out")), arc, lambda s: s["out"])


def shard_rows(docs: DataFrame, shards: int = 16, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row of ``docs``.

    ``slack`` is the share by which a shard may exceed the mean; 0 makes counts differ by one at most. ``slot`` numbers the rows of a shard
    from 0 without gaps. Rows without an id are placed by their text; repeated rows are rows of their own and interchangeable. A null
    text has no bytes: size 1. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    table = stage(ring(spark, shards), "ring")
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.coalesce(F.col(text), F.lit(""))))
    counts = docs.groupBy(_place(key).alias("place")).agg(F.count("*").alias("n"))
    placed = table.join(counts, "place", "left").fillna(0, ["n"])
    behind = Window.partitionBy("node").orderBy(F.pmod(F.col("node") - F.col("place"), F.lit(PLACES))).rowsBetween(Window.unboundedPreceding, -1)
    placed = stage(placed.withColumn("base", F.coalesce(F.sum("n").over(behind), F.lit(0))), "ring-counts")

    arcs = placed.groupBy("node", "shard").agg(F.sum("n").alias("n"))
    whole = arcs.agg(F.sort_array(F.collect_list(F.struct("node", "shard", "n"))).alias("a"), F.sum("n").alias("rows"))
    owners = F.transform("a", lambda x: x["shard"])

    def clockwise(around: Column) -> Column:
        return F.transform(
            "a",
            lambda x, i: F.struct(x["node"].alias("node"), x["n"].alias("n"), F.array_distinct(F.slice(around, i + 1, F.size("a"))).alias("clockwise")),
        )

    if slack:
        room = F.ceil(F.col("rows") * (1 + slack) / shards)
        capacity = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: room)
    else:
        capacity = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"rows div {shards}") + F.when(s < F.col("rows") % shards, 1).otherwise(0))
    plan = stage(whole.select(let(F.concat(owners, owners), clockwise).alias("arcs"), capacity.cast("array<bigint>").alias("capacity")), "ring-arcs")
    pieces = plan.select(F.explode(_pieces(F.col("arcs"), F.col("capacity"))).alias("p")).select("p.*")
    pieces = pieces.groupBy("node").agg(F.collect_list(F.struct("lo", "hi", F.col("shard").alias("to"), "before")).alias("pieces"))
    # As many rows as the ring has places, whatever the input.
    moves = F.broadcast(stage(placed.where("n > 0").join(pieces, "node").select("place", "base", "pieces"), "ring-moves"))

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        _place(key).alias("place"),
    )
    within = Window.partitionBy("place").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(moves, "place")
    at = F.col("base") + F.col("rank")
    target = F.element_at(F.filter("pieces", lambda p: (p["lo"] <= at) & (at < p["hi"])), 1)
    ranked = ranked.select("doc_id", "size", "text_crc32", at.alias("at"), target.alias("p"))
    return ranked.select("doc_id", "size", "text_crc32", F.col("p.to").alias("shard"), (F.col("p.before") + F.col("at") - F.col("p.lo")).alias("slot"))


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts differ by one at most."""
    found = shard_rows(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
