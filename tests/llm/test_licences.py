"""Licence notices and expressions, against a plain word scan and plain set rules."""

import random
import re

from claimscope.llm.licence_scan import BASE_NOTICES, EXCEPTION_GAIN, FREEDOM, IDENTIFIERS, evaluate, op11_licence_scan, read_expression, scan_licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_base(text):
    words = WORD.findall(lowered(text))
    places = [(i, label) for phrase, label in BASE_NOTICES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_query_equals_a_plain_word_scan(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op11_licence_scan(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert any(r.n_base for r in got) and any(r.labels != r.base_labels for r in got) and any(not r.labels for r in got)


def test_random_words_equal_a_plain_word_scan(spark):
    pick = random.Random(3)
    parts = "under the mit license apache License, version 2 cc BY nc \n - _ é İ K nc.cc under-the (mit) 2x".split(" ")
    texts = ["".join(pick.choice(parts) + pick.choice([" ", "  ", "-", "\n", "", "é"]) for _ in range(pick.randrange(60))) for _ in range(400)]
    texts += ["under the MIT license " * 500, "cc by nc cc by nc", "CC BY-NC", "apache license version 2apache", None, "", "\x00", "x" * 200_000]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = scan_licences(docs).collect()
    assert docs.columns == scan_licences(docs).columns[:3]
    for r in rows:
        base = [h for h in r.notices if h.base]
        starts = [h.word for h in base]
        labels = ",".join(sorted({h.label for h in base}))
        assert (r._n_words, len(base), min(starts, default=None), max(starts, default=None), labels) == plain_base(texts[r.doc_id])
        assert r.n_words == -1
        for h in r.notices:
            assert len(WORD.findall(lowered(texts[r.doc_id][h.start : h.end]))) == h.n_words


def test_longer_notices_win_and_base_ones_stay(spark):
    texts = ["GNU General Public License version 3", "the GNU General Public License applies", "CC BY-NC-SA 4.0", "Licensed under the Apache License, Version 2.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in scan_licences(docs).orderBy("doc_id").collect()] == [["gpl-3"], ["gpl"], ["cc-by-nc", "cc-by-nc-sa"], ["apache-2"]]
    assert scan_licences(docs.limit(0)).collect() == []


def test_expressions_stop_where_they_are_none_any_more():
    def read(text):
        found = read_expression(text)
        return found and (" ".join(found.postfix), text[: found.end])

    assert read("MIT") == ("mit", "MIT")
    assert read("MIT OR Apache-2.0 AND ISC */") == ("mit apache-2.0 isc and or", "MIT OR Apache-2.0 AND ISC")
    assert read("(MIT OR Apache-2.0) AND ISC.") == ("mit apache-2.0 or isc and", "(MIT OR Apache-2.0) AND ISC")
    assert read("GPL-2.0+ WITH Classpath-exception-2.0 or MIT") == ("gpl-2.0+ classpath-exception-2.0 with mit or", "GPL-2.0+ WITH Classpath-exception-2.0 or MIT")
    assert read("MIT OR (ISC AND") == ("mit", "MIT")
    assert read("MIT and and ISC") == ("mit", "MIT") and read("MIT ISC") == ("mit", "MIT") and read("MIT\nOR ISC") == ("mit", "MIT")
    assert read("(MIT) WITH x") == ("mit", "(MIT)") and read("MIT WITH (x)") == ("mit", "MIT") and read("MIT WITH x WITH y") == ("mit x with", "MIT WITH x")
    assert read("DocumentRef-a:LicenseRef-b") == ("documentref-a:licenseref-b", "DocumentRef-a:LicenseRef-b")
    for bad in ("", "or MIT", "()", ")", "((MIT)", "*/", "\nMIT"):
        assert read(bad) is None, bad
    assert len(read_expression("(" * 50_000 + "mit" + ")" * 50_000 + " or isc" * 50_000).postfix) == 100_001


def test_random_expressions_equal_direct_evaluation():
    pick = random.Random(7)
    names = [*list(IDENTIFIERS)[::4], "x-1"]

    def make(depth):
        """Text with brackets around every operator or only where needed, and its value."""
        if depth == 0 or pick.random() < 0.3:
            name = pick.choice(names)
            label = IDENTIFIERS.get(name, name)
            freedom = FREEDOM.get(label, 0.2)
            if pick.random() < 0.2:
                return f"{name} with some-exception", 3, ({label}, min(1.0, freedom + EXCEPTION_GAIN))
            return name, 3, ({label}, freedom)
        word, binds = pick.choice([("or", 1), ("AND", 2)])
        sides = [make(depth - 1), make(depth - 1)]
        texts = [t if b > binds or (b == binds and i == 0) else f"({t})" for i, (t, b, _) in enumerate(sides)]
        (a, x), (b, y) = sides[0][2], sides[1][2]
        return f" {word} ".join(texts), binds, (a | b, (max if word == "or" else min)(x, y))

    for _ in range(500):
        text, _, (labels, freedom) = make(5)
        found = read_expression(text)
        assert found.end == len(text)
        value = evaluate(found.postfix)
        assert (set(value.labels), value.freedom) == (labels, freedom), text


def test_tags(spark):
    texts = {
        "# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note OR MIT\nx": (["gpl-2", "mit"], 1.0, ["gpl-2.0-only linux-syscall-note with mit or"]),
        "é SPDX-License-Identifier: LicenseRef-own": (["licenseref-own"], 0.2, ["licenseref-own"]),
        '{"license": "(MIT AND CC-BY-NC-4.0)"}': (["cc-by-nc", "mit"], 0.2, ["mit cc-by-nc-4.0 and"]),
        "License: see below. license = mit": (["mit"], 1.0, ["mit"]),
        "relicense: MIT": ([], 0.0, []),
        "license MIT": ([], 0.0, []),
        "License: all of it": ([], 0.0, []),
        "license: mit " * 2000: (["mit"], 1.0, ["mit"] * 2000),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licences(docs).collect():
        labels, freedom, postfix = texts[r.text]
        assert (r.labels, r.freedom, [s.postfix for s in r.statements]) == (labels, freedom, postfix), r.text[:60]
        assert all(read_expression(r.text[s.start : s.end]).postfix == s.postfix.split() for s in r.statements)
