"""Hard negatives against plain enumeration of all pairs."""

import check_oracle
import numpy as np
import pytest

from claimscope.llm import length_buckets
from claimscope.llm.length_buckets import ORACLE_SQL, Anchors, Block, Search, _packed, mine_hard_negatives, op12_length_buckets


def plain(rows, positives=5, negatives=3, low=50, high=95):
    """``rows``: id, label, vector, is_anchor."""

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for anchor, label, vector, is_anchor in rows:
        if not is_anchor:
            continue
        scored = [(-dot(vector, v), i, other) for i, other, v, _ in rows if i != anchor]
        near = sorted(s[:2] for s in scored if s[2] == label)[:positives]
        for minus, positive in near:
            fits = sorted(s[:2] for s in scored if s[2] != label and low * -minus <= 100 * -s[0] <= high * -minus)[:negatives]
            out += [(anchor, positive, n, i, -minus, -s) for n, (s, i) in enumerate(fits, start=1)]
    return sorted(out)


def mined(spark, rows, **parameters):
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>, is_anchor boolean")
    return sorted(tuple(r) for r in mine_hard_negatives(df, **parameters).collect())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    assert check_oracle.differences(op12_length_buckets(spark, folder), check_oracle.connect(folder), ORACLE_SQL) == []


def clustered(seed, n=700, dims=6):
    """Vectors of very different lengths in a few directions, with ties, copies and null vectors."""
    random = np.random.default_rng(seed)
    centres = random.normal(size=(5, dims))
    rows = []
    for i in range(n):
        vector = centres[i % 5] + random.normal(scale=0.1, size=dims)
        vector *= np.exp(random.normal(scale=1.5)) * 20
        vector = [0] * dims if i % 97 == 0 else np.round(vector).astype(int).tolist()
        rows.append((i * 3, int(random.integers(3)), vector, i % 20 == 0))
    copies = [(10_000 + i, *rows[i % 40][1:3], i % 30 == 0) for i in range(200)]
    return rows + copies + [(20_001, 7, [5] * dims, True), (20_002, 1, [], True), (20_003, 1, [9, 9], True), (20_004, 2, [3] * (dims + 3), True)]


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_any_lengths_ties_and_copies_equal_plain_enumeration(spark, monkeypatch, block_rows):
    rows = clustered(1)
    monkeypatch.setattr(length_buckets, "BLOCK_ROWS", block_rows)
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows, positives=2, negatives=1, low=10, high=100) == plain(rows, 2, 1, 10, 100)


def test_anchors_in_several_passes_give_the_same(spark, monkeypatch):
    rows = clustered(2, 300)
    monkeypatch.setattr(length_buckets, "PASS_BYTES", 300)
    monkeypatch.setattr(length_buckets, "BLOCK_ROWS", 5)
    assert mined(spark, rows) == plain(rows)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, 0, [4, 0], True), (2, 0, [4, 1], False), (3, 1, [3, 0], False), (3, 1, [3, 0], False), (3, 2, [1, 0], False)]
    odd = [(None, 0, [9, 9], True), (4, None, [9, 9], True), (5, 0, None, True), (6, 0, [9, None], True), (7, 1, [3, 3], None)]
    assert mined(spark, rows + odd) == plain(rows[:3]) == [(1, 2, 1, 3, 16, 12)]
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1], True)]) == [] and mined(spark, [(1, 0, [1], False)]) == []
    large = [(1, 0, [1 << 30, 1], True), (2, 0, [1 << 30, 3], False), (3, 1, [1 << 29, 3], False), (4, 1, [1 << 29, 4], False)]
    assert mined(spark, large, low=1, high=99) == plain(large, low=1, high=99)


def test_coordinates_prune_without_loss():
    """Narrow clusters: most rows are never verified, and the best ones are found."""
    random = np.random.default_rng(5)
    centres = random.normal(size=(40, 16)) * 100
    vectors = np.round(centres[np.arange(4000) % 40] + random.normal(scale=2.0, size=(4000, 16))).astype(np.int64)
    rows = sorted(((i, 0, v.tolist()) for i, v in enumerate(vectors)), key=lambda r: -sum(x * x for x in r[2]))
    names = [part.split()[0] for part in length_buckets.BLOCK.split(", ")]
    ids, empty = np.arange(40), np.zeros(40, np.int64)
    scores = vectors[:40] @ vectors.T
    best = [[j for j in np.lexsort((np.arange(4000), -scores[i])) if j != i][:5] for i in range(40)]
    # Without and with a start value, as a search in some of the blocks gives.
    least = np.array([scores[i, best[i][4]] - 1000 for i in range(40)])
    verified = []
    for low in (np.full(40, -(1 << 62)), least):
        search = Search(Anchors(ids, empty, vectors[:40], True, 5, ids, low, np.full(40, 1 << 62), empty, empty))
        for at in range(0, 4000, 200):
            search.add(Block(dict(zip(names, _packed(rows[at : at + 200], 0, True), strict=True))))
        for i in range(40):
            assert search.ids[i].tolist() == best[i] and search.scores[i].tolist() == scores[i, best[i]].tolist()
        assert search.pruned > 0
        verified.append(search.verified / (40 * 4000))
    assert verified[0] < 0.5 and verified[1] < 0.2, verified
