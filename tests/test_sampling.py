import hashlib
import random

import pytest
from conftest import rows

from claimscope.operators import sampling

N = 57


@pytest.fixture(scope="module")
def indexed(spark):
    ids = [f"C{i:03d}" for i in range(N)]
    random.Random(3).shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "ClaimID string").repartition(6)
    return sampling.with_row_index(df, ["ClaimID"]).cache()


def labels(df):
    return [r[0] for r in rows(df.select("row_index"), "row_index")]


ALL = list(range(N))


def test_index_follows_the_order(indexed):
    assert rows(indexed, "row_index") == [(i, f"C{i:03d}") for i in range(N)]


@pytest.mark.parametrize("n", [0, 1, 10, N, N + 5, -1, -10, -N, -N - 5])
def test_top_and_bottom_as_python_slices(indexed, n):
    assert labels(sampling.top(indexed, n)) == ALL[:n]
    expected = (ALL[-n:] if n > 0 else []) if n >= 0 else ALL[-n:]
    assert labels(sampling.bottom(indexed, n)) == expected


def test_slices_and_label_ranges(indexed):
    rng = random.Random(5)
    pairs = [(rng.randint(-N - 3, N + 3), rng.randint(-N - 3, N + 3)) for _ in range(25)]
    for a, b in pairs:
        assert labels(sampling.slice_positions(indexed, a, b)) == ALL[a:b], (a, b)
        assert labels(sampling.between_labels(indexed, a, b)) == [i for i in ALL if a <= i <= b]


def test_single_rows(indexed):
    assert labels(sampling.at_position(indexed, -1)) == [N - 1]
    assert labels(sampling.at_label(indexed, 3)) == [3]
    for n in (N, -N - 1):
        with pytest.raises(IndexError):
            sampling.at_position(indexed, n)
    for n in (N, -1):
        with pytest.raises(KeyError):
            sampling.at_label(indexed, n)


@pytest.mark.parametrize("n", [0, 1, 20, N - 1, N])
def test_random_sample_is_exact_and_repeatable(indexed, n):
    got = labels(sampling.random_rows(indexed, n, seed=7))
    ranked = sorted(ALL, key=lambda i: hashlib.md5(f"7-{i}".encode()).hexdigest())
    assert got == sorted(ranked[:n])
    assert sampling.random_rows(indexed, n, seed=7).columns == indexed.columns
    assert sampling.random_rows(indexed, n).count() == n


def test_random_sample_rejects_impossible_sizes(indexed):
    for n in (-1, N + 1):
        with pytest.raises(ValueError):
            sampling.random_rows(indexed, n)


def test_preview_count_and_empty_guard(indexed):
    assert labels(sampling.preview(indexed, 5)) == ALL[:5]
    assert sampling.row_count(indexed) == N
    assert sampling.require_rows(indexed) is indexed
    with pytest.raises(ValueError):
        sampling.require_rows(sampling.top(indexed, 0))
