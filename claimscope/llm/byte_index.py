"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes (byte and place).
Any 5 of the 8 places hold 3 places of the same half, so a pair that qualifies shares the list of at least one of the
8 triples of places within a half. Each distinct fingerprint is posted to these 8 lists. In a list the shared
positional bytes of a pair are tallied; pairs with at least 5 are kept and their differing bits counted.

Lists longer than ``LONG_LIST`` are split exactly: the pair needs 2 more of the 5 other places, so their postings move to the
lists of 5 places, 10 for each. Such a list leaves 24 bits free, so it has at most 2 ** 24 fingerprints, and is searched
by the neighbours of each fingerprint instead of by pairs. From each list only a forest of links is kept; equal fingerprints are one
node from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import bounded_batches, byte_rows, load, stage

SHINGLE_WORDS, MOST_BITS, SHARED_BYTES = 3, 3, 5
#: Fingerprints in a list from which it is split.
LONG_LIST = 2048
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def fingerprint(text: bytes) -> int:
    """SimHash of a text's word shingles; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - ends[0] if len(words) == 1 else np.concatenate([[0], ends[:-1]]))[:n].tolist()
    stops = (ends[min(SHINGLE_WORDS, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp``: each row's fingerprint as a signed 64-bit integer; a null text has no word."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t) for t in byte_rows(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _key(places: Iterable[int], number: int) -> Column:
    """A list's key: its places' bytes, and the number of the set of places in the bytes left over or above."""
    places = list(places)
    mask = sum(0xFF << (8 * p) for p in places)
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask
    return F.struct(F.lit(number).cast("byte").alias("set"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bytes"))


def _forest(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what a list's pairs connect: tally shared bytes, keep 5 and more, verify the bits."""
    left = fps
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            seeds = queue.pop()
            for seed in seeds:
                if not len(left):
                    break
                differing = left ^ seed
                tally = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                near = tally >= SHARED_BYTES
                near[near] = np.bitwise_count(differing[near]) <= MOST_BITS
                if near.any():
                    found = left[near]
                    yield np.full(len(found), seed), found
                    queue.append(found)
                    left = left[~near]


def _bounded_forest(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for a long list of 5 places: each fingerprint looks its neighbours of up to 3 bits up among the list."""
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << b for b in range(64) if free >> b & 1]
    fps = np.sort(fps)
    label = np.arange(len(fps))
    masks = [np.uint64(sum(c)) for k in range(1, MOST_BITS + 1) for c in combinations(bits, k)]
    changed = True
    while changed:
        before = label.copy()
        for mask in masks:
            at = np.searchsorted(fps, fps ^ mask)
            at[at == len(fps)] = 0
            hit = fps[at] == fps ^ mask
            np.minimum.at(label, np.flatnonzero(hit), label[at[hit]])
        while (label[label] != label).any():
            label = label[label]
        changed = (label != before).any()
    other = label != np.arange(len(fps))
    if other.any():
        yield fps[label[other]], fps[other]


def _groups(batches: Iterable[pa.RecordBatch], n_key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole lists, as (list number of each row, fp), from rows sorted by list; a list may span batches."""
    held_keys: list[np.ndarray] = []
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_key)], axis=1)
        fps = batch.column(n_key).to_numpy(zero_copy_only=False).view(np.uint64)
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut or (held and (held_keys[-1][-1] != keys[-1]).any()):
            yield np.concatenate([*held_keys, keys[:cut]]), np.concatenate([*held, fps[:cut]])
            held_keys, held = [], []
        held_keys.append(keys[cut:])
        held.append(fps[cut:])
    if held:
        yield np.concatenate(held_keys), np.concatenate(held)


def _links(forest: Callable) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _groups(batches, 2):
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            found = [pair for part in np.split(fps, starts[1:]) if len(part) > 1 for pair in forest(part)]
            if found:
                ends = [pa.array(np.concatenate(side).view(np.int64)) for side in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return run


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that connect all that differ in at most 3 bits."""
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = fps.select("fp", F.explode(F.array(*[_key(t, n) for n, t in enumerate(TRIPLES)])).alias("key"))
    lists = lists.select("key.*", "fp").withColumn("n", F.count("*").over(Window.partitionBy("set", "bytes")))
    lists = stage(lists.where("n > 1"), "byte-lists")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions, "set", "bytes").sortWithinPartitions("set", "bytes")

    short = dealt(lists.where(F.col("n") <= LONG_LIST).select("set", "bytes", "fp")).mapInArrow(_links(_forest), "a long, b long")
    finer = [
        F.when(F.col("set") == n, F.array(*[_key({*t, *more}, i) for i, more in enumerate(combinations(sorted({*range(8)} - {*t}), 2))]))
        for n, t in enumerate(TRIPLES)
    ]
    long = lists.where(F.col("n") > LONG_LIST).select(F.col("set").alias("triple"), "fp", F.explode(F.coalesce(*finer)).alias("key"))
    long = long.select((F.col("triple") * 16 + F.col("key.set")).alias("set"), "key.bytes", "fp")

    def any_size(part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return _forest(part) if len(part) <= LONG_LIST else _bounded_forest(part)

    return short.unionByName(dealt(long).mapInArrow(_links(any_size), "a long, b long"))


def connected(links: DataFrame) -> DataFrame:
    """``node, root``: for each node of ``links`` (``a, b``) the smallest node of its component.

    Alternates the two star operations until nothing changes: larger neighbours are hung onto a node's smallest neighbour, then
    smaller ones. Rounds grow with the logarithm of the longest chain; each round's links are written.
    """
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("x"), "m", "a")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("l"))
        links = stage(small.select("l.a", "l.b").where("a <> b").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    Documents whose fingerprints differ in at most 3 bits are linked; ``component_id`` is the smallest ``doc_id``
    that a row reaches, itself included, and null only where no reachable row has an id. Null and empty texts have fingerprint 0
    and are linked like any others; repeated rows each give a row; an empty table gives none. Other columns are not read.
    """
    prints = stage(with_fingerprints(docs, doc_id, text), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = connected(fingerprint_links(nodes.select("fp")))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members = stage(joined.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component of ``docs``: that with the smallest id.

    Rows of that id count as one document. Rows without an id cannot be told from each other and all stay.
    """
    kept = near_duplicates(docs, doc_id, text).where("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(kept, doc_id, "left_semi").dropDuplicates([doc_id])
    return named.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))


def op2_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    bounded_batches(spark)
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
