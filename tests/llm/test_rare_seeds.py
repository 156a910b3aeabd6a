"""Rare seeds: no pair that any seed finds is lost, and phrases that many items share cost nothing."""

import numpy as np
import pytest

from claimscope.llm import seed_align
from claimscope.llm.seed_align import Matcher, contaminated, frequencies, needed, seeds_of, without_contaminated, words_of

PHRASE = "which of the following is correct about"


def prose(seed, n, letters="abcdefghij", size=5):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), size)) for _ in range(n)]


def edited(words, seed):
    """Words replaced, left out and put in, and the end cut off."""
    rng = np.random.default_rng(seed)
    out = []
    for w in words[: len(words) - int(rng.integers(0, len(words) // 5 + 1))]:
        kind = rng.random()
        out += [] if kind < 0.03 else ["edit"] if kind < 0.08 else [w, "more"] if kind < 0.13 else [w]
    return out


def plain_score(item, doc):
    table = np.zeros((len(doc) + 1, len(item) + 1), int)
    for i in range(1, len(doc) + 1):
        for j in range(1, len(item) + 1):
            same = seed_align.MATCH if doc[i - 1] == item[j - 1] else seed_align.MISMATCH
            table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] + seed_align.GAP, table[i, j - 1] + seed_align.GAP)
    return table.max() / (seed_align.MATCH * len(item))


def planted():
    items = [(n, PHRASE.split() + prose(n, 9)) for n in range(8)] + [(8, prose(50, 30)), (9, ["ha"] * 12), (10, prose(51, 2)), (11, ["one"])]
    docs = []
    for k in range(120):
        _, words = items[k % len(items)]
        around = prose(100 + k, 12, "klmnop")
        docs.append(around[:6] + edited(words, k) + around[6:])
    docs += [PHRASE.split() + prose(300, 20, "klmnop")] * 30 + [items[3][1]] * 40 + [[]]
    return [(n, " ".join(w).encode()) for n, w in items], [" ".join(d).encode() for d in docs]


def counted(items, docs):
    index = Matcher(items)
    counts = np.zeros(index.n_counts, np.int64)
    for doc in docs:
        index.count(doc, counts)
    keys = np.flatnonzero(counts)
    return keys, counts[keys]


@pytest.mark.parametrize("rare_items, rare_share", [(10**9, 1.0), (16, 1e-3), (0, 0.0), (4, 0.2)])
def test_found_are_all_pairs_of_the_plain_recurrence_that_share_a_seed(monkeypatch, rare_items, rare_share):
    monkeypatch.setattr(seed_align, "RARE_ITEMS", rare_items)
    monkeypatch.setattr(seed_align, "RARE_SHARE", rare_share)
    items, docs = planted()
    found = Matcher(items, *counted(items, docs)).find(docs)
    for doc, own in zip(docs, found, strict=True):
        words = words_of(doc)
        for n, text in items:
            item = words_of(text)
            shared = {g for _, g in seeds_of(item)} & {b" ".join(words[at : at + k]) for k in (1, 2, 3) for at in range(len(words) - k + 1)}
            score = plain_score(item, words) if shared else 0
            assert (n in own) == (score >= seed_align.LEAST), (n, doc)
            assert n not in own or own[n][0] == pytest.approx(score)


def test_needed_words_are_the_fewest_that_reach_the_score():
    for size in range(1, 400):
        assert needed(size) == min(n for n in range(size + 1) if 2 * n >= seed_align.LEAST * 2 * size)


@pytest.mark.parametrize("n_items", [100, 3000])
def test_items_that_only_share_a_phrase_are_no_candidates(n_items):
    items = [(n, " ".join(PHRASE.split() + prose(n, 10)).encode()) for n in range(n_items)]
    doc = " ".join(prose(1, 3, "klmnop") + words_text(items[7]) + prose(2, 50, "klmnop"))
    matcher = Matcher(items, *counted(items, [doc.encode()]))
    words = words_of(doc.encode())
    codes = matcher.codes_of(words)
    places = matcher._places(words, codes >= 0)
    entries = matcher.entries(np.fromiter(places, np.int64), codes)
    assert set(matcher._owner[entries].tolist()) == {7}


def words_text(item):
    return item[1].decode().split()


def test_an_item_of_one_word_is_aligned_in_few_stretches():
    matcher = Matcher([(1, b"ha " * 500)])
    words = words_of(b"ha " * 5000)
    stretches = list(matcher.candidates(words, matcher.codes_of(words)))
    assert len(stretches) < 20
    assert matcher.find([b"ha " * 700])[0][1][0] == 1.0


def test_counts_and_blocks(spark, monkeypatch):
    items, docs = planted()
    table = spark.createDataFrame([(i, d.decode()) for i, d in enumerate(docs)] + [(None, None)], "doc_id long, text string").repartition(5)
    keys, counts = frequencies(table, items)
    expected = counted(items, [*docs, b""])
    order = np.argsort(keys)
    assert keys[order].tolist() == expected[0].tolist() and counts[order].tolist() == expected[1].tolist()
    benchmark = spark.createDataFrame([(n, t.decode()) for n, t in items], "item_id long, text string")
    whole = sorted(map(tuple, contaminated(table, benchmark).collect()))
    clean = sorted(str(r.doc_id) for r in without_contaminated(table, benchmark).collect())
    found = Matcher(items).find(docs)
    assert [(d, i) for d, i, *_ in whole] == [(d, i) for d, own in enumerate(found) for i in sorted(own)]
    assert clean == sorted([*(str(d) for d, own in enumerate(found) if not own), "None"])
    monkeypatch.setattr(seed_align, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, contaminated(table, benchmark).collect())) == whole
    assert sorted(str(r.doc_id) for r in without_contaminated(table, benchmark).collect()) == clean
