"""Hard negatives by exact inner products, with the coordinate pruning of LEMP.

Rows are put into buckets of similar length, longest first. A block of a bucket keeps its vectors and, per coordinate, the order of its rows by the
value of their unit vectors. An anchor that looks for scores of at least ``t`` needs a unit vector at an angle of at most ``arccos(t / (anchor's
length * bucket's length))``; for each of its focus coordinates, those in which its own unit vector is largest, this leaves a range of values. The
ranges are cut out of the sorted lists, the candidate sets are intersected, and the scores of the candidates are worked out exactly. Anchors
for which no list is at least halved are verified together by one matrix product.

``t`` rises while a task goes through its blocks. A first search in about the square root of all blocks gives each anchor a start value; it is a lower bound of what
the search in all blocks finds, so results do not depend on it.

Anchors are a query set taken in blocks of ``PASS_BYTES`` of vectors; each block of anchors is one broadcast and one pass over the rows, which are
written once. Tasks return the best rows per anchor and positive, not scores of pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import load, stage, staging_root
from claimscope.operators.keyed import unique_rows

POSITIVES, NEGATIVES = 5, 3
#: Per cent of the positive's score between which a hard negative scores.
LOW, HIGH = 50, 95
FOCUS = 6
BLOCK_ROWS, BLOCK_CELLS = 4096, 1 << 18
PASS_BYTES = 16 << 20
_LEAST, _MOST = -(1 << 62), 1 << 62
_SLACK = 1e-9
BLOCK = "first_id long, bucket int, n int, dims int, low_label long, high_label long, ids binary, labels binary, vectors binary, orders binary"
FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


class Block:
    """Rows of one length bucket as arrays, with their order by each unit coordinate."""

    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(n, dims)
        self.orders = np.frombuffer(row["orders"], np.int32).reshape(dims, -1)
        self.lengths = np.sqrt(np.square(self.vectors.astype(np.float64)).sum(axis=1))
        self.longest = float(self.lengths.max(initial=0.0))
        self.largest = float(np.abs(self.vectors).max(initial=0))


def _unit(vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return vectors / np.where(lengths > 0, lengths, 1.0)[:, None]


def _packed(rows: list[tuple[int, int, list[int]]], bucket: int, orders: bool) -> tuple:
    dims = max(len(v) for _, _, v in rows)
    vectors = np.zeros((len(rows), dims), np.int64)
    for i, (_, _, v) in enumerate(rows):
        vectors[i, : len(v)] = v
    labels = np.array([label for _, label, _ in rows], np.int64)
    lengths = np.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1))
    order = np.argsort(_unit(vectors, lengths), axis=0, kind="stable").T.astype(np.int32) if orders else np.zeros((dims, 0), np.int32)
    ids = np.array([i for i, _, _ in rows], np.int64)
    return (
        int(ids[0]), bucket, len(rows), dims, int(labels.min()), int(labels.max()),
        ids.tobytes(), labels.tobytes(), vectors.tobytes(), np.ascontiguousarray(order).tobytes(),
    )


def _blocks(rows: DataFrame, orders: bool) -> DataFrame:
    """``rows`` in their order as blocks; a block holds rows of one bucket, at most ``BLOCK_ROWS`` and about ``BLOCK_CELLS`` values of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list[int]]] = []
        bucket, dims = None, 0

        def packed() -> pa.RecordBatch:
            values = _packed(held, bucket, orders)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            names = [part.split()[0] for part in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for vec_id, label, vector, here in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vector", "bucket")), strict=True):
                if held and (here != bucket or len(held) >= BLOCK_ROWS or (len(held) + 1) * max(dims, len(vector)) > BLOCK_CELLS):
                    yield packed()
                    held, dims = [], 0
                bucket, dims = here, max(dims, len(vector))
                held.append((vec_id, label, vector))
        if held:
            yield packed()

    return rows.select("vec_id", "label", "vector", "bucket").mapInArrow(run, BLOCK)


def _bucket() -> Column:
    """Length bucket: each covers lengths up to a fifth apart, the null vector has its own."""
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.when(squares > 0, F.floor(F.log2(squares) * 2).cast("int")).otherwise(F.lit(-1))


def indexed_rows(rows: DataFrame) -> DataFrame:
    """All rows as written blocks: longest bucket first, rows of one label together."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("bucket"), "label", "vec_id"]
    return stage(_blocks(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order), True), "length-blocks")


@dataclass
class Anchors:
    """A bounded block of anchors, and the windows of scores that each looks through.

    Window ``w`` belongs to anchor ``owner[w]`` and takes the ``k`` best rows with a score from ``low[w]`` to ``high[w]``.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same_label: bool
    k: int
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positive_id: np.ndarray
    positive_score: np.ndarray
    lengths: np.ndarray = field(init=False)
    unit: np.ndarray = field(init=False)
    focus: np.ndarray = field(init=False)
    largest: float = field(init=False)

    def __post_init__(self):
        self.lengths = np.sqrt(np.square(self.vectors.astype(np.float64)).sum(axis=1))
        self.unit = _unit(self.vectors, self.lengths)
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.largest = float(np.abs(self.vectors).max(initial=0))


class Search:
    """The best rows per window of one task, block by block."""

    def __init__(self, anchors: Anchors):
        self.anchors = anchors
        n = len(anchors.owner)
        self.scores = np.full((n, anchors.k), _LEAST, np.int64)
        self.ids = np.full((n, anchors.k), _MOST, np.int64)
        self.found = np.zeros(n, np.int64)
        # Windows are in the order of their owners.
        self.first = np.searchsorted(anchors.owner, np.arange(len(anchors.ids) + 1))
        self.pruned = self.verified = 0

    def _least(self) -> np.ndarray:
        """The lowest score that may still change a window of each anchor."""
        floor = np.maximum(self.anchors.low, np.where(self.found == self.anchors.k, self.scores[:, -1], _LEAST))
        least = np.full(len(self.anchors.ids), _MOST, np.int64)
        np.minimum.at(least, self.anchors.owner, floor)
        return least

    def add(self, block: Block) -> None:
        a = self.anchors
        has_own = np.isin(a.labels, block.labels)
        live = has_own if a.same_label else ~(has_own & (block.labels.min() == block.labels.max()))
        least = self._least().astype(np.float64)
        reach = a.lengths * block.longest
        live &= (least < _MOST) & (least <= reach * (1 + _SLACK) + _SLACK)
        live &= self.first[1:] > self.first[:-1]
        chosen = np.flatnonzero(live)
        if not len(chosen):
            return
        lows, highs = self._ranges(block, chosen, least[chosen], reach[chosen])
        widths = highs - lows
        best = widths.argmin(axis=1) if widths.shape[1] else np.zeros(len(chosen), np.int64)
        is_wide = widths.min(axis=1, initial=len(block.ids)) * 2 > len(block.ids)
        dims = min(a.vectors.shape[1], block.vectors.shape[1])
        exact = np.float64 if a.largest * block.largest * max(dims, 1) < 2**53 else np.int64
        vectors = block.vectors[:, :dims].astype(exact)
        wide = chosen[is_wide]
        for at in range(0, len(wide), 256):
            part = wide[at : at + 256]
            scores = (a.vectors[part, :dims].astype(exact) @ vectors.T).astype(np.int64)
            for anchor, row in zip(part, scores, strict=True):
                self._offer(anchor, row, block.ids, block.labels)
        self.verified += len(wide) * len(block.ids)
        unit = _unit(block.vectors, block.lengths)
        for i in np.flatnonzero(~is_wide):
            anchor, f = chosen[i], best[i]
            rows = block.orders[a.focus[anchor, f], lows[i, f] : highs[i, f]]
            for g, coordinate in enumerate(a.focus[anchor]):
                if g != f and coordinate < dims and widths[i, g] < len(block.ids):
                    order = block.orders[coordinate]
                    values = unit[rows, coordinate]
                    first, last = unit[order[lows[i, g]], coordinate] if widths[i, g] else 2.0, unit[order[highs[i, g] - 1], coordinate]
                    rows = rows[(values >= first) & (values <= last)]
            self.pruned += len(block.ids) - len(rows)
            self.verified += len(rows)
            if len(rows):
                scores = (vectors[rows] @ a.vectors[anchor, :dims].astype(exact)).astype(np.int64)
                self._offer(anchor, scores, block.ids[rows], block.labels[rows])

    def _ranges(self, block: Block, chosen: np.ndarray, least: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the feasible values of each focus coordinate begin and end in its sorted list."""
        a, n = self.anchors, len(block.ids)
        unit = _unit(block.vectors, block.lengths)
        # An angle says nothing for a score of 0 or less: shorter rows may then be at a wider one.
        cosine = np.where((least > 0) & (reach > 0), np.minimum(least / np.where(reach > 0, reach, 1.0), 1.0), -1.0)[:, None]
        focus = a.focus[chosen]
        own = np.take_along_axis(a.unit[chosen], focus, axis=1)
        spread = np.sqrt(np.maximum(1 - own * own, 0) * np.maximum(1 - cosine * cosine, 0))
        from_value = np.where(own < -cosine, -1.0, own * cosine - spread) - _SLACK
        to_value = np.where(own > cosine, 1.0, own * cosine + spread) + _SLACK
        lows, highs = np.zeros(focus.shape, np.int64), np.full(focus.shape, n, np.int64)
        usable = (cosine > 0) & (focus < block.vectors.shape[1])
        for coordinate in np.unique(focus[usable]):
            where = usable & (focus == coordinate)
            values = unit[block.orders[coordinate], coordinate]
            lows[where] = np.searchsorted(values, from_value[where], "left")
            highs[where] = np.searchsorted(values, to_value[where], "right")
        return lows, np.maximum(highs, lows)

    def _offer(self, anchor: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        a = self.anchors
        allowed = (labels == a.labels[anchor]) == a.same_label
        allowed &= ids != a.ids[anchor]
        scores, ids = scores[allowed], ids[allowed]
        for w in range(self.first[anchor], self.first[anchor + 1]):
            least = max(a.low[w], self.scores[w, -1])
            fits = (scores >= least) & (scores <= a.high[w])
            if not fits.any():
                continue
            s, i = scores[fits], ids[fits]
            if len(s) > 4 * a.k:
                cut = np.partition(s, len(s) - a.k)[len(s) - a.k]
                s, i = s[s >= cut], i[s >= cut]
            s, i = np.concatenate([self.scores[w], s]), np.concatenate([self.ids[w], i])
            order = np.lexsort((i, -s))[: a.k]
            self.scores[w], self.ids[w] = s[order], i[order]
            self.found[w] = int((self.ids[w] < _MOST).sum())

    def rows(self) -> pa.RecordBatch:
        a = self.anchors
        w, rank = np.nonzero(self.ids < _MOST)
        columns = [a.ids[a.owner[w]], a.positive_id[w], a.positive_score[w], self.ids[w, rank], self.scores[w, rank]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])


def _search(blocks: DataFrame, anchors: Anchors) -> DataFrame:
    """The ``k`` best rows per window, ranked."""
    given = {f.name: getattr(anchors, f.name) for f in fields(anchors) if f.init}
    shared = blocks.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(Anchors(**shared.value))
        for batch in batches:
            for row in batch.to_pylist():
                search.add(Block(row))
        yield search.rows()

    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    found = blocks.drop("first_id", "bucket", "low_label", "high_label").mapInArrow(run, FOUND)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= anchors.k)


def _searched(blocks: DataFrame, seeds: DataFrame | None, anchors: Anchors, name: str) -> DataFrame:
    """``_search`` as a written table, with start values from the seed blocks."""
    if seeds is not None and len(anchors.owner):
        full = _search(seeds, anchors).groupBy("anchor_id", "positive_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        # One row per window of a bounded block of anchors.
        least = {(r.anchor_id, r.positive_id): r.least for r in full.where(F.col("n") == anchors.k).toLocalIterator()}
        found = [least.get(key, _LEAST) for key in zip(anchors.ids[anchors.owner].tolist(), anchors.positive_id.tolist(), strict=True)]
        anchors.low = np.maximum(anchors.low, np.array(found, np.int64))
    return stage(_search(blocks, anchors), name)


def _anchor_blocks(anchors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of the anchors, in blocks of about ``PASS_BYTES``, read one after the other."""
    held: list[Block] = []

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dims = max(b.vectors.shape[1] for b in held)
        vectors = np.vstack([np.pad(b.vectors, ((0, 0), (0, dims - b.vectors.shape[1]))) for b in held])
        return np.concatenate([b.ids for b in held]), np.concatenate([b.labels for b in held]), vectors

    size = 0
    for row in _blocks(anchors.withColumn("bucket", F.lit(0)), False).toLocalIterator():
        block = Block(row.asDict())
        if held and size + block.vectors.nbytes > PASS_BYTES:
            yield joined()
            held, size = [], 0
        held.append(block)
        size += block.vectors.nbytes
    if held:
        yield joined()


def mine_hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``rows``.

    ``rows`` has ``vec_id long, label long, vector array<long>, is_anchor boolean``. The positives of an anchor are the ``positives`` other rows of its
    label with the highest inner products; the negatives of a positive are the ``negatives`` rows of other labels that score highest between ``low`` and
    ``high`` per cent of it. Equal scores go by the smaller id. Rows with a null in any of the columns, also inside the vector, take no part. Of rows with the same id
    one takes part, that with the smallest label, then vector. A vector ends in zeros as far as needed. Scores must fit in 64 bits. Without anchors or rows the
    result is empty.
    """
    spark = rows.sparkSession
    whole = ["vec_id", "label", "vector", "is_anchor"]
    present = F.forall("vector", lambda x: x.isNotNull())
    kept = stage(rows.select(*whole).where(" AND ".join(f"{c} IS NOT NULL" for c in whole)).where(present), "vectors")
    kept = unique_rows(kept, "vec_id", ["label", "vector"])
    blocks = indexed_rows(kept.withColumn("bucket", _bucket()))
    share = math.isqrt(blocks.count())
    seeds = blocks.where(F.pmod(F.xxhash64("first_id"), F.lit(share)) == 0) if share > 2 else None
    folder = f"{staging_root(spark)}/hard-negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/pass=0")
    anchors = stage(kept.where("is_anchor").select("vec_id", "label", "vector"), "anchors")
    for number, (ids, labels, vectors) in enumerate(_anchor_blocks(anchors), start=1):
        n = len(ids)
        every, none = np.arange(n), np.zeros(n, np.int64)
        near = Anchors(ids, labels, vectors, True, positives, every, np.full(n, _LEAST), np.full(n, _MOST), none, none)
        index = {vec_id: i for i, vec_id in enumerate(ids.tolist())}
        # At most ``positives`` rows per anchor of the block.
        pairs = sorted((index[r.anchor_id], r.vec_id, r.score) for r in _searched(blocks, seeds, near, "positives").toLocalIterator())
        owner, positive_id, score = np.array(pairs, np.int64).reshape(-1, 3).T
        # From low * score up to high * score, in hundredths.
        least = np.array([-((-low * s) // 100) for *_, s in pairs], np.int64)
        most = np.array([(high * s) // 100 for *_, s in pairs], np.int64)
        far = Anchors(ids, labels, vectors, False, negatives, owner, least, most, positive_id, score)
        found = _searched(blocks, seeds, far, "negatives")
        found.select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.parquet(f"{folder}/pass={number}")
    return spark.read.schema(f"{schema}, pass int").parquet(folder).drop("pass")


def op12_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``, in integer arithmetic."""
    table = load(spark, sf_dir, "embeddings")
    number = F.col("vec_id").cast("long")
    label = F.col("label").cast("long")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~odd).select(
        number.alias("vec_id"),
        F.when(number % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"),
        (number % 50 == 0).alias("is_anchor"),
    )
    return mine_hard_negatives(rows)


ORACLE_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 3
"""
