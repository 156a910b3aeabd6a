"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The words and word n-grams of the test items are counted by documents, with sums per task. An n-gram in few items and few
   documents is a rare seed and stands for its items alone. A common n-gram, such as a phrase with which many items begin, is a
   seed only together with one of an item's rarest words: of an item of ``m`` words that reaches ``LEAST`` with ``need`` words
   or more, the ``m - need + 1`` places of its rarest words.
2. One pass over the corpus for each block of items of bounded size. Of the items with a seed in a document those stay
   of whose words, counted by place, it holds ``need``.
3. Each passage around a seed is aligned with the item, word by word. Edited words, gaps and insertions lower the score; from
   ``LEAST`` of the score of the whole item on, the document counts as contaminated.

Rarity loses nothing. Only matched words raise a score, so a document that reaches ``LEAST`` holds ``need`` places of the item or
more and lacks ``m - need`` at most; of any ``m - need + 1`` places it holds one, also of the rarest. So a common n-gram that it
shares with the item is a seed, whatever was edited, in however many copies. What a document pays does not grow with the items
that merely share a phrase with it.

A copy in which every run of ``SEED_WORDS`` words is broken has no seed and is not found. The texts are never shuffled.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import byte_rows, kept_in_worker, load, whole_text

#: Words in a seed; items with fewer words are one seed.
SEED_WORDS = 3
#: Share of an item's full score that a contaminated passage reaches.
LEAST = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of item texts in one block; each block is another pass over the corpus.
BLOCK_BYTES = 16_000_000
#: A seed in more places of items, or in more than this share of the documents, is common.
RARE_ITEMS = 16
RARE_SHARE = 1e-3
#: Passages aligned at once, and cells of the row of the alignment table that they share.
_BATCH = 512
_CELLS = 1 << 20
FOUND = "item_id long, score double, first_word long, n_words long"


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without punctuation at their ends."""
    return [w.strip(b".,;:!?\"'()[]#*$%&|<>") or w for w in text.lower().split()]


def align(items: np.ndarray, sizes: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of pairs, one pair per row: score, first and end position in the passage.

    ``items`` is padded with -1, ``passages`` with -2, so padding never matches. Gaps cost the same per word; the
    best cell of a row along a run of gaps is a running maximum.
    """
    n, m = items.shape
    along = -GAP * np.arange(m + 1, dtype=np.int32)
    above = np.zeros((n, m + 1), np.int32)
    began = np.zeros((n, m + 1), np.int32)
    inside = np.arange(1, m + 1)[None, :] <= sizes[:, None]
    best, first, last = (np.zeros(n, np.int32) for _ in range(3))
    rows = np.arange(n)
    for t in range(passages.shape[1]):
        same = items == passages[:, t, None]
        diagonal = above[:, :-1] + np.where(same, MATCH, MISMATCH)
        vertical = above[:, 1:] + GAP
        here = np.zeros((n, m + 1), np.int32)
        start = np.full((n, m + 1), t + 1, np.int32)
        up = vertical > diagonal
        here[:, 1:] = np.maximum(np.where(up, vertical, diagonal), 0)
        # A cell of score 1 or more comes from its neighbour; a match out of nothing starts at this word.
        from_diagonal = np.where(above[:, :-1] > 0, began[:, :-1], t)
        start[:, 1:] = np.where(here[:, 1:] > 0, np.where(up, began[:, 1:], from_diagonal), t + 1)
        lifted = here + along
        reach = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(m + 1), 0), axis=1)
        here = reach - along
        start = np.take_along_axis(start, source, axis=1)
        scores = np.where(inside, here[:, 1:], 0)
        where = scores.argmax(axis=1)
        top = scores[rows, where]
        better = top > best
        best = np.where(better, top, best)
        first = np.where(better, start[rows, where + 1], first)
        last = np.where(better, t + 1, last)
        above, began = here, start
    return best, first, last


def needed(size: int) -> int:
    """The least number of matched words with which an item of ``size`` words reaches ``LEAST``."""
    return next(n for n in range(int(LEAST * size), size + 1) if MATCH * n >= LEAST * MATCH * size)


class Matcher:
    """A block of items with their seeds.

    ``keys`` and ``counts`` are what ``frequencies`` found; without them all words and seeds are equally rare.
    """

    def __init__(self, items: list[tuple[int, bytes]], keys: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.ids = [i for i, _ in items]
        vocabulary: dict[bytes, int] = {}
        seeds: dict[bytes, int] = {}
        seed, owner, place = array("i"), array("i"), array("i")
        self._codes: list[np.ndarray] = []
        for n, (_, text) in enumerate(items):
            words = words_of(text)
            self._codes.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
            for at, gram in seeds_of(words):
                seed.append(seeds.setdefault(gram, len(seeds)))
                owner.append(n)
                place.append(at)
        self._vocabulary, self._seeds = vocabulary, seeds
        order = np.argsort(np.array(seed, np.int32), kind="stable")
        #: Items and places of all seeds, those of seed k from ``_heads[k]`` up to ``_heads[k + 1]``.
        self._owner, self._place = np.array(owner, np.int32)[order], np.array(place, np.int32)[order]
        self._heads = np.concatenate([[0], np.cumsum(np.bincount(np.array(seed, np.int32), minlength=len(seeds)))]).astype(np.int64)
        self._sizes = np.array([len(c) for c in self._codes], np.int64)
        self._first = np.cumsum(self._sizes) - self._sizes
        self._all_codes = np.concatenate([*self._codes, np.empty(0, np.int32)])
        self._short = sorted({size for size in self._sizes.tolist() if size < SEED_WORDS})
        self._present = np.zeros(len(vocabulary), bool)
        self._marked = np.zeros(len(items), bool)
        documents = np.zeros(self.n_counts, np.int64)
        if keys is not None:
            documents[keys] = counts
        in_documents = documents[1 + len(vocabulary) :]
        self._common = (np.diff(self._heads) > RARE_ITEMS) | (in_documents > RARE_SHARE * documents[0])
        self._by_seed = np.repeat(np.arange(len(seeds)), np.diff(self._heads)) * len(items) + self._owner
        self._index_rare_words(documents[1 : 1 + len(vocabulary)])

    @property
    def n_counts(self) -> int:
        """Counts of a block: all documents, then each word, then each seed."""
        return 1 + len(self._vocabulary) + len(self._seeds)

    def _index_rare_words(self, documents: np.ndarray) -> None:
        """For each word the items that have it among the places of their rarest words."""
        rare = []
        for codes in self._codes:
            rarest = np.lexsort((codes, documents[codes]))[: len(codes) - needed(len(codes)) + 1]
            rare.append(np.unique(codes[rarest]))
        owners = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
        words = np.concatenate([*rare, np.empty(0, np.int32)])
        order = np.argsort(words, kind="stable")
        self._rare_items = owners[order]
        self._rare_heads = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(documents)))]).astype(np.int64)

    def codes_of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self._vocabulary.get(w, -3) for w in words), np.int32, len(words))

    def count(self, text: bytes, counts: np.ndarray) -> None:
        """Add a document to the counts of documents: all, by word and by seed."""
        words = words_of(text)
        codes = self.codes_of(words)
        counts[0] += 1
        counts[1 + np.unique(codes[codes >= 0])] += 1
        counts[1 + len(self._vocabulary) + np.fromiter(self._places(words, codes >= 0), np.int64)] += 1

    def _places(self, words: list[bytes], known: np.ndarray) -> dict[int, list[int]]:
        """Seeds in a document with the positions of each."""
        places: dict[int, list[int]] = {}
        for size in [*self._short, SEED_WORDS]:
            if len(words) < size:
                break
            full = known[: len(words) - size + 1].copy()
            for k in range(1, size):
                full &= known[k : len(words) - size + 1 + k]
            for at in np.flatnonzero(full).tolist():
                seed = self._seeds.get(b" ".join(words[at : at + size]))
                if seed is not None:
                    places.setdefault(seed, []).append(at)
        return places

    def _reachable(self, items: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Those of the items that have enough words in common with a document's ``codes`` to reach ``LEAST``."""
        seen = codes[codes >= 0]
        sizes = self._sizes[items]
        self._present[seen] = True
        common = np.add.reduceat(self._present[self._all_codes[_stretches(self._first[items], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
        self._present[seen] = False
        return items[MATCH * common >= LEAST * MATCH * sizes]

    def entries(self, seeds: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places in items of those ``seeds`` of a document that are rare, or common and beside a rare word of the item."""
        common = self._common[seeds]
        rare = seeds[~common]
        found = _stretches(self._heads[rare], self._heads[rare + 1] - self._heads[rare])
        if not common.any():
            return found
        words = np.unique(codes[codes >= 0])
        items = np.unique(self._rare_items[_stretches(self._rare_heads[words], self._rare_heads[words + 1] - self._rare_heads[words])])
        seeds = seeds[common]
        counts = self._heads[seeds + 1] - self._heads[seeds]
        if counts.sum() <= len(seeds) * len(items):
            beside = _stretches(self._heads[seeds], counts)
            self._marked[items] = True
            beside = beside[self._marked[self._owner[beside]]]
            self._marked[items] = False
        else:
            pairs = (seeds[:, None] * len(self.ids) + items).ravel()
            first = np.searchsorted(self._by_seed, pairs)
            beside = _stretches(first, np.searchsorted(self._by_seed, pairs, side="right") - first)
        return np.concatenate([found, beside])

    def candidates(self, words: list[bytes], codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Items and the stretches of a document around their seeds; stretches of an item that touch are one.

        Where a seed stands in an item more than once, the stretch has room for its first and its last place, so there are no
        more stretches than places in the document.
        """
        places = self._places(words, codes >= 0)
        if not places:
            return
        entries = self.entries(np.fromiter(places, np.int64, len(places)), codes)
        owners = self._owner[entries]
        entries = entries[np.isin(owners, self._reachable(np.unique(owners), codes))]
        ends: dict[tuple[int, int], tuple[int, int]] = {}
        for key, at in zip(self._by_seed[entries].tolist(), self._place[entries].tolist(), strict=True):
            seed, n = divmod(key, len(self.ids))
            low, high = ends.get((n, seed), (at, at))
            ends[n, seed] = min(low, at), max(high, at)
        begins: dict[int, set[tuple[int, int]]] = {}
        for (n, seed), (low, high) in ends.items():
            begins.setdefault(n, set()).update((place - high, place - low) for place in places[seed])
        for n, firsts in begins.items():
            size = len(self._codes[n])
            room = size // 2 + 2
            parts = [(max(0, low - room), min(len(words), high + size + room)) for low, high in sorted(firsts)]
            start, end = parts[0]
            for a, b in [*parts[1:], (len(words) + 1, 0)]:
                if a <= end and max(b, end) - start <= 4 * size + 16:
                    end = max(b, end)
                else:
                    yield n, start, end
                    start, end = a, b

    def find(self, texts: Iterable[bytes]) -> list[dict[int, tuple[float, int, int]]]:
        """For each text its contaminating items: share of the full score, first word, number of words."""
        found: list[dict[int, tuple[float, int, int]]] = []
        pairs: list[tuple[int, int, int, np.ndarray]] = []
        for text in texts:
            words = words_of(text)
            codes = self.codes_of(words)
            found.append({})
            for n, start, end in self.candidates(words, codes):
                passage = codes[start:end]
                # No alignment can match more words than the two have in common.
                if MATCH * np.isin(self._codes[n], passage).sum() >= LEAST * MATCH * len(self._codes[n]):
                    pairs.append((len(found) - 1, n, start, passage))
                    if len(pairs) >= 4 * _BATCH:
                        self._align(pairs, found)
                        pairs = []
        self._align(pairs, found)
        return found

    def _align(self, pairs: list, found: list[dict[int, tuple[float, int, int]]]) -> None:
        pairs.sort(key=lambda p: (len(self._codes[p[1]]), len(p[3])))
        at = 0
        while at < len(pairs):
            part = pairs[at : at + _BATCH]
            # Sizes ascend, so the last passage that fits tells the cells of all.
            part = part[: max(1, sum((row + 1) * len(self._codes[n]) <= _CELLS for row, (_, n, _, _) in enumerate(part)))]
            at += len(part)
            sizes = np.array([len(self._codes[n]) for _, n, _, _ in part])
            items = np.full((len(part), sizes.max()), -1, np.int32)
            passages = np.full((len(part), max(len(p) for *_, p in part)), -2, np.int32)
            for row, (_, n, _, passage) in enumerate(part):
                items[row, : sizes[row]] = self._codes[n]
                passages[row, : len(passage)] = passage
            for (doc, n, start, _), score, size, first, last in zip(part, *_listed(align(items, sizes, passages), sizes), strict=True):
                share = score / (MATCH * size)
                item = self.ids[n]
                if share >= LEAST and (item not in found[doc] or (-share, start + first) < (-found[doc][item][0], found[doc][item][1])):
                    found[doc][item] = (share, start + first, last - first)


def _stretches(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as its size says."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _listed(aligned: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray) -> tuple[list, ...]:
    best, first, last = (x.tolist() for x in aligned)
    return best, sizes.tolist(), first, last


def seeds_of(words: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Position and text of each seed; fewer words than a seed has are one seed."""
    size = min(SEED_WORDS, len(words))
    if size:
        for at in range(len(words) - size + 1):
            yield at, b" ".join(words[at : at + size])


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of at most ``BLOCK_BYTES``; items without an id or without a word are left out."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), whole_text(text).alias("text"))
    items = items.where("item_id IS NOT NULL").distinct().orderBy("item_id", "text")
    block, size = [], 0
    for row in items.toLocalIterator():
        data = row.text.encode("utf-8")
        if not data.split():
            continue
        if block and size + len(data) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.item_id, data))
        size += len(data)
    if block:
        yield block


def _matcher(token: str, shared: Broadcast) -> Matcher:
    """The matcher of a broadcast block, made once in a Python worker, which keeps its last one."""
    kept = kept_in_worker(("seed_align",), dict)
    if token not in kept:
        kept.clear()
        kept[token] = Matcher(*shared.value)
    return kept[token]


def frequencies(docs: DataFrame, block: list[tuple[int, bytes]], text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """In how many rows of ``docs`` the words and seeds of a block stand: keys as in ``Matcher.n_counts``, and counts.

    Each task sends its sums; the result is bounded by the block, not by the corpus.
    """
    shared, token = docs.sparkSession.sparkContext.broadcast((block,)), uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(token, shared)
        counts = np.zeros(matcher.n_counts, np.int64)
        for batch in batches:
            for data in byte_rows(batch.column(0)):
                matcher.count(data, counts)
        keys = np.flatnonzero(counts)
        for first in range(0, len(keys), 100_000):
            part = keys[first : first + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["key", "n"])

    sums = docs.select(text).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    return sums["key"].to_numpy(), sums["n"].to_numpy()


def _mapped(docs: DataFrame, block: list[tuple[int, bytes]], counted: DataFrame, text: str, emit, schema) -> DataFrame:
    shared, token = docs.sparkSession.sparkContext.broadcast((block, *frequencies(counted, block, text))), uuid.uuid4().hex
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(token, shared)
        for batch in batches:
            yield emit(batch, matcher.find(byte_rows(batch.column(at))))

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents and the items they contain: ``doc_id, item_id, score, first_word, n_words``.

    ``score`` is the share of the item's full score, 1.0 for an unchanged copy. The best passage counts, at equal scores the first.
    Null texts are empty; repeated rows give a row each; an empty table on either side gives none. Only the named columns are read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text)
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(FOUND).fields])
    names = schema.names
    kind = rows.schema["doc_id"].dataType

    def emit(batch: pa.RecordBatch, found: list[dict[int, tuple[float, int, int]]]) -> pa.RecordBatch:
        hits = [(n, item, *values) for n, own in enumerate(found) for item, values in sorted(own.items())]
        ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
        columns = [pa.array([h[i] for h in hits], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
        return pa.RecordBatch.from_arrays([ids, *columns], names=names)

    out = None
    for block in item_blocks(benchmark):
        part = _mapped(rows, block, rows, text, emit, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("doc_id", kind), *schema.fields[1:]]))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item; nothing else changes and no text is shuffled."""

    def emit(batch: pa.RecordBatch, found: list[dict[int, tuple[float, int, int]]]) -> pa.RecordBatch:
        return batch.filter(pa.array([not own for own in found], pa.bool_()))

    kept = docs
    for block in item_blocks(benchmark):
        kept = _mapped(kept, block, docs, text, emit, docs.schema)
    return kept


def op1_seed_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark, with the items."""
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
