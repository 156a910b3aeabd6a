"""Operators over documents, against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimscope.llm import byte_index, seed_align
from claimscope.llm.bounded_ring import shard_rows
from claimscope.llm.byte_index import connected, near_duplicates, without_near_duplicates
from claimscope.llm.char_tagger import CharTagger, _classes, base_spans, find_personal_data, mask_personal_data, reconcile, span_tags, tag_texts
from claimscope.llm.risk_rules import binomial_tail, fit_cutoffs, judged, kept_documents
from claimscope.llm.seed_align import contaminated, without_contaminated


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("long_list", [2048, 4])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, long_list):
    monkeypatch.setattr(byte_index, "LONG_LIST", long_list)
    base = prose(1, 400)
    rows = [(i, base.replace("a", "A", i) + f" tail{i % 9}") for i in range(30)] + [(100 + i, prose(i + 5, 60)) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (100, prose(5, 60)), (None, base)]
    found = {(r.doc_id, r.fp): r.component_id for r in near_duplicates(documents(spark, rows)).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    for n, (doc, _) in enumerate(rows):
        least = min(rows[m][0] for m in range(len(rows)) if group[m] == group[n] and rows[m][0] is not None)
        signed = prints[n] - (1 << 64) if prints[n] >> 63 else prints[n]
        assert found[doc, signed] == least


def test_bounded_forest_links_what_pairs_link():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 200).astype(np.uint64) << np.uint64(7))
    def parts(links):
        label = {int(f): int(f) for f in fps}
        for a, b in [(int(x), int(y)) for p in links for x, y in zip(*p, strict=True)]:
            old, new = label[a], label[b]
            label = {k: new if v == old else v for k, v in label.items()}
        return sorted(sorted(k for k in label if label[k] == v) for v in set(label.values()))
    pairs = [(np.array([a]), np.array([b])) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 3]
    assert parts(byte_index._bounded_forest(fps)) == parts(pairs) == parts(byte_index._forest(fps))


def test_components_of_a_chain_and_dedup(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    roots = {r.node: r.root for r in connected(chain).collect()}
    assert all(roots[i] == 0 for i in range(1, 41)) and roots[91] == 90
    rows = [(5, prose(1, 80)), (2, prose(1, 80)), (2, prose(1, 80)), (9, prose(2, 80)), (None, prose(2, 80))]
    kept = without_near_duplicates(documents(spark, rows))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 9]
    assert kept.columns == documents(spark, rows).columns
    assert near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_leaks_are_found_edited_and_clean_documents_left(spark):
    item, other = prose(7, 40), prose(8, 20)
    words = item.split()
    edited = " ".join(words[:10] + ["new"] + words[10:20] + words[22:])
    rows = [(1, prose(9, 200) + " " + item.upper() + ". " + prose(10, 50)), (2, edited), (3, prose(11, 300)), (4, None), (5, ""), (6, other), (6, other)]
    rows += [(7, " ".join(words[:8]) + " " + prose(12, 90))]
    benchmark = spark.createDataFrame([(10, item), (11, other), (12, None), (None, item), (13, "")], "item_id long, text string")
    docs = documents(spark, rows)
    found = {(r.doc_id, r.item_id): r for r in contaminated(docs, benchmark).collect()}
    assert set(found) == {(1, 10), (2, 10), (6, 11)}
    assert found[1, 10].score == 1.0 and found[1, 10].first_word == 200 and found[1, 10].n_words == 40
    assert 0.6 <= found[2, 10].score < 1
    assert sorted(r.doc_id for r in without_contaminated(docs, benchmark).collect()) == [3, 4, 5, 7]
    assert contaminated(docs, benchmark.limit(0)).count() == 0 and contaminated(docs.limit(0), benchmark).count() == 0


def test_an_item_in_every_document_keeps_its_seeds(spark):
    item = prose(7, 30)
    docs = documents(spark, [(i, prose(i, 20) + " " + item) for i in range(40)])
    assert contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 40


@pytest.mark.parametrize("copies", [1, 2, 3, 1000])
def test_edited_and_shortened_passages_are_found_however_often_they_stand(spark, copies):
    item = prose(21, 40)
    words = item.split()
    edited = " ".join("new" if n in (5, 15, 25, 35) else w for n, w in enumerate(words))
    passages = [edited, " ".join(words[:28]), " ".join(words[12:])]
    benchmark = spark.createDataFrame([(1, item), (2, prose(22, 40))], "item_id long, text string")
    for passage, score in zip(passages, (0.85, 0.7, 0.7), strict=True):
        found = contaminated(documents(spark, [(i, f"{prose(i + 30, 9)} {passage}") for i in range(copies)]), benchmark).collect()
        assert sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in found) == [(i, 1, score) for i in range(copies)]


def test_unlike_edits_of_one_item_do_not_hide_each_other(spark):
    words = prose(21, 40).split()
    rows = [(0, " ".join(words))] + [(i, " ".join(words[12:])) for i in range(1, 60)] + [(i, " ".join(words[:28])) for i in range(60, 64)]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert contaminated(documents(spark, rows), benchmark).count() == 64
    assert without_contaminated(documents(spark, rows), benchmark).count() == 0


def test_alignment_scores_are_those_of_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(30):
        item, passage = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 12))
        table = np.zeros((len(passage) + 1, len(item) + 1), int)
        for i in range(1, len(passage) + 1):
            for j in range(1, len(item) + 1):
                same = seed_align.MATCH if passage[i - 1] == item[j - 1] else seed_align.MISMATCH
                table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] + seed_align.GAP, table[i, j - 1] + seed_align.GAP)
        padded = np.append(item, [-1, -1]).astype(np.int32)[None]
        best, first, last = seed_align.align(padded, np.array([len(item)]), passage.astype(np.int32)[None])
        assert best[0] == table.max() and (best[0] == 0 or 0 <= first[0] < last[0] <= len(passage))


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(None, "a"), (None, None), (7, "t"), (7, "t")]
    found = shard_rows(documents(spark, rows)).toPandas()
    assert len(found) == 504 and found.groupby("shard").size().max() - found.groupby("shard").size().min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    loose = shard_rows(documents(spark, rows), slack=0.25).toPandas()
    assert loose.groupby("shard").size().max() <= np.ceil(504 * 1.25 / 16)
    assert shard_rows(documents(spark, rows).limit(0)).count() == 0


def test_adding_a_shard_moves_few_rows(spark):
    rows = documents(spark, [(i, "t") for i in range(2000)])
    before = shard_rows(rows, 16, 0.25).toPandas().set_index("doc_id").shard
    after = shard_rows(rows, 17, 0.25).toPandas().set_index("doc_id").shard
    assert (before != after).mean() < 0.3


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_and_verdicts(spark):
    texts = [None, "", " ", "a b", "a b c", "a b c a b c", "x x x x", "a\nb\na\n\n \n \n", "a b c\td\x0be\x0cf\rg # $%", prose(1, 60), "the cat sat " * 40, prose(2, 60) + "\n" + "%%% " * 20]
    docs = documents(spark, list(enumerate(texts)))
    cutoffs = spark.createDataFrame([("en", [0.05, None, None, None])], "stratum string, cutoffs array<double>")
    for r in judged(docs, cutoffs).collect():
        q = r.quality_rules
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == brute_measures(texts[r.doc_id]), texts[r.doc_id]
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert q.kept == (r.doc_id == 9)


def test_binomial_tail_is_exact(spark):
    from math import comb
    cases = [(float(n), float(k)) for n in (1, 20, 500, 3000) for k in (0, 1, 4, 25) if k <= n]
    rows = spark.createDataFrame(cases, "n double, k double")
    for r in rows.withColumn("p", binomial_tail(F.col("n"), F.col("k"), 0.01)).collect():
        n, k = int(r.n), int(r.k)
        exact = sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) if k < n * 0.01 else 1.0
        assert abs(r.p - exact) < 1e-9


def test_cutoffs_need_enough_labels_and_refuse_junk_only(spark):
    rows = [(i, prose(i, 60)) for i in range(900)] + [(1000 + i, prose(i, 60) + " ###" * 60) for i in range(50)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kept_documents(docs, labels).collect()}
    assert kept == set(range(900))
    few = fit_cutoffs(docs, labels.where("doc_id < 20")).first()
    assert few.cutoffs == [None] * 4
    assert kept_documents(docs.limit(0), labels).count() == 0 and kept_documents(docs, labels.limit(0)).count() == 950


def test_rule_spans_on_hard_cases():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for text in ["a@b.cd_e@f.gh", "a@@b.c", "a@b", "x..@a.b.", "a@b.c@d.e", "%@a-b.c-d.", "a@b.c d@e.f"]:
        assert base_spans(text) == [("email", *m.span()) for m in email.finditer(text)]
    assert base_spans("1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4") == [("ip", 0, 7), ("ip", 8, 15), ("ip", 26, 36)]
    assert base_spans("4111 1111 1111 1111, 4111111111111112") == [("card", 0, 19)]
    assert base_spans("+1 (555) 010-9999 +12") == [("phone", 0, 17)]
    assert base_spans("9" * 200_000) == []


def make_examples(n, seed):
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for _ in range(n):
        value = [f"ab{digits(2)}@mail.example.com", ".".join(str(x) for x in rng.integers(0, 256, 4)), f"+1 ({digits(3)}) 555-{digits(4)}"][rng.integers(0, 3)]
        out.append(prose(rng.integers(0, 10**6), 4) + " " + value + " " + prose(rng.integers(0, 10**6), 3))
    return out


def test_the_network_learns_spans_and_holds_out(spark):
    from claimscope.llm.char_tagger import _classes
    def rows(texts):
        return np.stack([np.pad(_classes(t)[:96], (0, max(0, 96 - len(t))), constant_values=129) for t in texts]), np.stack([np.pad(span_tags(len(t), base_spans(t))[:96], (0, max(0, 96 - len(t)))) for t in texts])
    tagger = CharTagger.fresh().train(*rows(make_examples(400, 1)), steps=150)
    held = make_examples(60, 2)
    hits = sum(bool(set(base_spans(t)) & {(k, a, b) for k, a, b, _ in s}) for t, s in zip(held, tagger.decode(rows(held)[0]), strict=True))
    assert hits >= 48
    texts = [(1, "mail ab12@x.org " + prose(1, 100)), (2, None), (3, prose(4, 3000) + " 10.0.0.1 "), (3, ""), (4, "plain")]
    found = {r.doc_id: r for r in find_personal_data(documents(spark, texts), tagger).collect()}
    assert found[1].n_email == 1 and found[4].spans == "" and found[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r for r in mask_personal_data(documents(spark, texts), tagger).collect() if r.text}
    assert masked[1].text.startswith("mail [EMAIL] ") and masked[1].n_chars == len(masked[1].text) and masked[4].text == "plain"


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(5)
    tagger = CharTagger.fresh(3)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    classes, tags = rng.integers(0, 129, (6, 2)), np.array([[0, 1], [1, 2], [2, 2], [0, 0], [3, 0], [4, 5]])
    def loss():
        scores = tagger._scores(np.concatenate([tagger._run(classes, s) for s in "fb"], axis=2)).astype(np.float64)
        follow = tagger.weights["next"] + tagger._allowed
        total, ahead = 0.0, scores[0]
        for t in range(1, 6):
            ahead = np.log(np.exp(ahead[:, :, None] + follow).sum(axis=1)) + scores[t]
        for b in range(2):
            path = scores[np.arange(6), b, tags[:, b]].sum() + follow[tags[:-1, b], tags[1:, b]].sum()
            total += np.log(np.exp(ahead[b]).sum()) - path
        return total / 2
    grads = tagger._gradients(classes, tags)
    for name, place in [("out", (3, 2)), ("bias", (1,)), ("fh", (2, 5)), ("bx", (int(classes[2, 0]), 7)), ("next", (1, 2))]:
        before, step = tagger.weights[name][place], 1e-3
        tagger.weights[name][place] = before + step
        up = loss()
        tagger.weights[name][place] = before - step
        down = loss()
        tagger.weights[name][place] = before
        assert abs((up - down) / (2 * step) - grads[name][place]) < 2e-3, name


def test_windows_are_reconciled():
    text = "call 12345678 now 99 x"
    found = [("card", 5, 10, 0.99), ("card", 9, 13, 0.98), ("phone", 6, 12, 0.96), ("ip", 18, 20, 0.5), ("email", 21, 22, 0.99)]
    assert reconcile(text, found, []) == [("card", 5, 13)]
    assert reconcile(text, found, [("phone", 0, 8)]) == [("phone", 0, 8)]


@pytest.mark.parametrize("size", [1, 63, 64, 65, 127, 128, 200])
@pytest.mark.parametrize("start", [0, 63, 64, 65, 128])
def test_spans_of_any_size_and_place_are_whole_over_windows(start, size):
    class Digits:
        def decode(self, rows):
            seven = _classes("7")[0]
            runs = [np.flatnonzero(row == seven) for row in rows]
            return [[("card", int(r[0]), int(r[-1]) + 1, 0.99)] if len(r) else [] for r in runs]

    text = "x" * start + "7" * size + "x" * 150
    assert [spans for _, spans in tag_texts(Digits(), [text])] == [[("card", start, start + size)]]
