"""Licence statements in texts: notice phrases and tagged licence expressions.

One Aho-Corasick automaton finds the notice phrases in the words of a text, another the identifier tags in its characters. What follows
a tag is read as a licence expression for as long as it is one, put into postfix order by a shunting-yard parser (``with`` binds closer than
``and``, ``and`` closer than ``or``) and evaluated: labels are collected, and its freedom is the least of both sides of ``and``, the greatest
of both sides of ``or``, and raised by an exception after ``with``.

Every row is judged by itself in its own task, so there is no shuffle and no group. A null text is an empty one; it, a text without a word and an
empty table have no statements. Repeated rows are judged each. Columns of the input stay; new names get underscores in front where they clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import bounded_batches, byte_rows, kept_in_worker, load, unused_name

# The phrases that are counted in every case, with their labels.
BASE_NOTICES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices. A notice inside a longer one found at the same place does not count.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "licensed under the apache license version 2 0": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "under the bsd license": "bsd",
    "under the isc license": "isc",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# Licence identifiers and the label of each.
IDENTIFIERS = {
    "0bsd": "0bsd",
    "agpl-3.0": "agpl-3",
    "agpl-3.0-only": "agpl-3",
    "agpl-3.0-or-later": "agpl-3",
    "apache-2.0": "apache-2",
    "bsd-2-clause": "bsd",
    "bsd-3-clause": "bsd",
    "bsl-1.0": "bsl",
    "cc-by-4.0": "cc-by",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nc-nd-4.0": "cc-by-nc-nd",
    "cc-by-nc-sa-4.0": "cc-by-nc-sa",
    "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc0-1.0": "cc0",
    "epl-2.0": "epl",
    "gpl-2.0": "gpl-2",
    "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2",
    "gpl-3.0": "gpl-3",
    "gpl-3.0-only": "gpl-3",
    "gpl-3.0-or-later": "gpl-3",
    "isc": "isc",
    "lgpl-2.1": "lgpl",
    "lgpl-2.1-only": "lgpl",
    "lgpl-2.1-or-later": "lgpl",
    "lgpl-3.0": "lgpl",
    "lgpl-3.0-only": "lgpl",
    "lgpl-3.0-or-later": "lgpl",
    "mit": "mit",
    "mpl-2.0": "mpl",
    "unlicense": "public-domain",
    "zlib": "zlib",
}
# How freely a text under a label may be used, from 0 (not at all) to 1.
FREEDOM = {
    "0bsd": 1.0,
    "agpl": 0.3,
    "agpl-3": 0.3,
    "all-rights-reserved": 0.0,
    "apache": 1.0,
    "apache-2": 1.0,
    "bsd": 1.0,
    "bsl": 1.0,
    "cc-by": 0.9,
    "cc-by-nc": 0.2,
    "cc-by-nc-nd": 0.1,
    "cc-by-nc-sa": 0.1,
    "cc-by-nd": 0.2,
    "cc-by-sa": 0.6,
    "cc0": 1.0,
    "epl": 0.7,
    "gpl": 0.4,
    "gpl-2": 0.4,
    "gpl-3": 0.4,
    "isc": 1.0,
    "lgpl": 0.7,
    "mit": 1.0,
    "mpl": 0.7,
    "public-domain": 1.0,
    "zlib": 1.0,
}
UNKNOWN_FREEDOM, EXCEPTION_GAIN = 0.2, 0.2
# The tags, and whether an identifier after them may be an unknown one.
TAGS = {"spdx-license-identifier": True, "license-expression": False, "license": False, "licence": False}

_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(?:([()])|((?:documentref-[A-Za-z0-9.-]+:)?[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*\+?))", re.I | re.A)
_AFTER_TAG = re.compile(r"""["']?[ \t]*[:=][ \t]*["']?""")
# A-Z to a-z, what is no part of a word to a space; bytes beyond ASCII are parts of words.
_IN_WORDS = bytes(c if c > 127 or chr(c).islower() or chr(c).isdigit() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))
_LOWER = bytes(ord(chr(c).lower()) if c < 128 else c for c in range(256))
HIT = "struct<label:string,word:bigint,n_words:bigint,start:bigint,end:bigint,base:boolean>"
STATEMENT = "struct<expression:string,postfix:string,labels:array<string>,freedom:double,start:bigint,end:bigint>"


class Expression(NamedTuple):
    """A licence expression in postfix order, and where its text ends."""

    postfix: list[str]
    end: int


def read_expression(text: str, at: int = 0) -> Expression | None:
    """The longest licence expression of one line that starts at ``at``; None if there is none."""
    tokens: list[tuple[str, str]] = []
    whole = end = depth = 0
    last = ""
    while token := _TOKEN.match(text, at):
        word = token[1] or token[2]
        kind = "operator" if word.lower() in _BINDS else word if token[1] else "id"
        operand_next = last in ("", "operator", "with", "(")
        if kind == "operator":
            kind = "with" if word.lower() == "with" else kind
            # An exception belongs to one identifier, not to a bracket or to another exception.
            fits = not operand_next and (kind != "with" or last == "id")
        elif kind == ")":
            fits = not operand_next and depth > 0
        else:
            fits = operand_next and not (kind == "(" and last == "with")
        if not fits:
            break
        depth += {"(": 1, ")": -1}.get(kind, 0)
        last = "exception" if kind == "id" and last == "with" else kind
        tokens.append((last, word))
        at = token.end()
        if depth == 0 and last in ("id", "exception", ")"):
            whole, end = len(tokens), at
    return Expression(_postfix(tokens[:whole]), end) if whole else None


def _postfix(tokens: list[tuple[str, str]]) -> list[str]:
    """Shunting-yard: operands in order, each operator after its two sides."""
    out: list[str] = []
    waiting: list[str] = []
    for kind, word in tokens:
        if kind in ("operator", "with"):
            binds = _BINDS[word.lower()]
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= binds:
                out.append(waiting.pop())
            waiting.append(word.lower())
        elif kind == "(":
            waiting.append(kind)
        elif kind == ")":
            while (operator := waiting.pop()) != "(":
                out.append(operator)
        else:
            out.append(word.lower())
    return out + waiting[::-1]


class Value(NamedTuple):
    labels: frozenset[str]
    freedom: float
    known: bool


def evaluate(postfix: list[str]) -> Value:
    """Labels, freedom and whether all identifiers are known, of a postfix expression."""
    labels, known = set(), True
    # Freedom so far, and the identifier of an operand that no operator has taken yet.
    stack: list[tuple[float, str | None]] = []

    def take() -> float:
        nonlocal known
        freedom, word = stack.pop()
        if word is not None:
            label = IDENTIFIERS.get(word.rstrip("+"))
            known = known and label is not None
            labels.add(label or word)
        return freedom

    for word in postfix:
        if word == "with":
            stack.pop()
            freedom, name = stack.pop()
            stack.append((min(1.0, freedom + EXCEPTION_GAIN), name))
        elif word in _BINDS:
            right, left = take(), take()
            stack.append(((min if word == "and" else max)(left, right), None))
        else:
            stack.append((FREEDOM.get(IDENTIFIERS.get(word.rstrip("+")), UNKNOWN_FREEDOM), word))
    freedom = take()
    return Value(frozenset(labels), freedom, known)


class Scanner:
    """The two automata for a set of notices and tags."""

    def __init__(self, notices: Mapping[str, str], base: Mapping[str, str]):
        self.phrases = ahocorasick.Automaton()
        for phrase in {**notices, **base}:
            words = _words(phrase.encode())
            label = base.get(phrase) or notices[phrase]
            if words:
                self.phrases.add_word(f" {_joined(words)} ", (label, len(words), phrase in base))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag, any_id in TAGS.items():
            self.tags.add_word(tag, (len(tag), any_id))
        self.tags.make_automaton()

    def notices(self, words: list[bytes]) -> list[tuple[str, int, int, bool]]:
        """``label, first word, words, base`` of every base notice and of the longest others, by place."""
        text = f" {_joined(words)} "
        found = [(end, *what) for end, what in self.phrases.iter(text)]
        if not found:
            return []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        # The blank after a phrase is the one after its last word.
        hits = sorted((int(np.searchsorted(ends, end)) + 1 - n, -n, label, base) for end, label, n, base in found)
        kept, reach = [], -1
        for first, minus_n, label, base in hits:
            inside = first - minus_n <= reach
            if base or not inside:
                kept.append((label, first, -minus_n, base))
            reach = max(reach, first - minus_n)
        return kept

    def statements(self, raw: bytes) -> list[tuple[Expression, Value, int]]:
        """Tagged expressions, their values and the byte at which each begins."""
        lower = raw.translate(_LOWER).decode("latin-1")
        found, done = [], -1
        for end, (n, any_id) in self.tags.iter(lower):
            begin = end + 1 - n
            if begin < done or (begin and (lower[begin - 1].isalnum() or lower[begin - 1] in "-_")):
                continue
            if not (gap := _AFTER_TAG.match(lower, end + 1)):
                continue
            expression = read_expression(lower, gap.end())
            if not expression:
                continue
            value, done = evaluate(expression.postfix), expression.end
            if value.known or any_id:
                found.append((expression, value, gap.end()))
        return found

    def scan(self, raw: bytes) -> dict:
        """Word count, notices, tagged expressions, labels and freedom of a text in UTF-8."""
        words = _words(raw)
        notices, statements = self.notices(words), self.statements(raw)
        values = [FREEDOM.get(label, UNKNOWN_FREEDOM) for label, *_ in notices] + [v.freedom for _, v, _ in statements]
        labels = {label for label, *_ in notices}.union(*(v.labels for _, v, _ in statements))
        out = {"n_words": len(words), "notices": [], "statements": [], "labels": sorted(labels), "freedom": min(values, default=0.0)}
        if not values:
            return out
        # Bytes to code points: all bytes but those that continue a character.
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        if notices:
            spans = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_IN_WORDS))]
            for label, first, n, base in notices:
                start, end = int(points[spans[first][0]]), int(points[spans[first + n - 1][1]])
                out["notices"].append({"label": label, "word": first, "n_words": n, "start": start, "end": end, "base": base})
        for expression, value, begin in statements:
            out["statements"].append({
                "expression": raw[begin : expression.end].decode().strip(), "postfix": " ".join(expression.postfix), "labels": sorted(value.labels),
                "freedom": value.freedom, "start": int(points[begin]), "end": int(points[expression.end]),
            })
        return out


def _words(raw: bytes) -> list[bytes]:
    return raw.translate(_IN_WORDS).split()


def _joined(words: list[bytes]) -> str:
    return b" ".join(words).decode("latin-1")


RESULT = {
    "n_words": "bigint",
    "notices": f"array<{HIT}>",
    "statements": f"array<{STATEMENT}>",
    "labels": "array<string>",
    "freedom": "double",
}


def scan_licences(
    docs: DataFrame, text: str = "text", notices: Mapping[str, str] = NOTICES, base: Mapping[str, str] = BASE_NOTICES
) -> DataFrame:
    """``docs`` with ``n_words, notices, statements, labels, freedom`` of each text.

    ``notices`` and ``base`` map phrases to labels; all places of a ``base`` phrase are given, of the others those that are not inside a longer
    notice. Words are runs of ASCII letters, digits and characters beyond ASCII, without regard to the case of A to Z. ``freedom`` is the least of all
    statements, 0 without any. Places are in code points, ends excluded.
    """
    names = {}
    taken = docs
    for wanted in RESULT:
        names[wanted] = unused_name(taken, wanted)
        taken = taken.withColumn(names[wanted], F.lit(None))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{names[k]}` {t}" for k, t in RESULT.items())])
    kinds = dict(zip(RESULT, (pa.int64(), *(_arrow_kind(k) for k in ("notices", "statements", "labels")), pa.float64()), strict=True))
    phrases = (tuple(notices.items()), tuple(base.items()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept_in_worker(("licences", phrases), lambda: Scanner(dict(phrases[0]), dict(phrases[1])))
        for batch in batches:
            rows = [scanner.scan(raw) for raw in byte_rows(batch.column(batch.schema.get_field_index(text)))]
            new = [pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names.values()])

    return docs.mapInArrow(run, schema)


def _arrow_kind(name: str) -> pa.DataType:
    number = {k: pa.int64() for k in ("word", "n_words", "start", "end")}
    hit = pa.struct([("label", pa.string()), *number.items(), ("base", pa.bool_())])
    statement = pa.struct([
        ("expression", pa.string()), ("postfix", pa.string()), ("labels", pa.list_(pa.string())), ("freedom", pa.float64()), ("start", pa.int64()), ("end", pa.int64()),
    ])
    return {"notices": pa.list_(hit), "statements": pa.list_(statement), "labels": pa.list_(pa.string())}[name]


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements of every document; ``score`` is the freedom that its statements leave."""
    bounded_batches(spark)
    found = scan_licences(load(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.transform(F.filter("notices", lambda h: h["base"]), lambda h: h["word"])
    base = F.transform(F.filter("notices", lambda h: h["base"]), lambda h: h["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.col("freedom").alias("score"),
        F.array_join(F.transform("statements", lambda s: s["postfix"]), "; ").alias("expressions"),
    )
