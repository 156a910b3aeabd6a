"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions.

The network is trained here, in numpy, from labelled spans. A text is cut into overlapping windows; each window is
decoded by itself, then the spans of all windows of the text are reconciled: pieces of one kind that touch or overlap are
one span, of overlapping spans of different kinds the more certain one stays, and spans of the rules win over all.

Every kind of personal data tagged here holds a digit or an ``@``, so a span without one is never accepted. A window without
such a character could only give spans that are not accepted; it is not run, which changes no result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import load, whole_text

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
#: Probability from which a span of the network counts.
CERTAIN = 0.95
#: Most documents, and most windows, that the network is trained from.
TRAIN_DOCUMENTS, TRAIN_WINDOWS = 20_000, 2_000
TRAIN_LENGTH = 96
_HIDDEN = 16
_PAD = 129
_TAGS = 1 + 2 * len(KINDS)
_BATCH = 1024
Span = tuple[str, int, int]

# The characters and shapes of the base kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches in order; each ``@`` has one possible local part, the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _is_ip(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(match: str) -> bool:
    digits = re.sub(r"[^0-9]", "", match)
    return 16 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(match: str) -> bool:
    return 8 <= len(re.sub(r"[^0-9]", "", match)) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by kind, then start; positions are code points."""
    spans = [("email", *span) for span in _emails(text)] if "@" in text else []
    if any(map(text.__contains__, "0123456789")):
        for kind, pattern, valid in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
            spans += [(kind, *m.span()) for m in pattern.finditer(text) if valid(m.group())]
    return spans


def _classes(text: str) -> np.ndarray:
    """A class per code point: ASCII characters have their own, all others share one."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.uint8)


def span_tags(length: int, spans: Iterable[Span]) -> np.ndarray:
    """Tag 0 outside, 2k + 1 at the start and 2k + 2 inside a span of kind k."""
    tags = np.zeros(length, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        tags[max(start, 0) : min(end, length)] = 2 * k + 2
        if 0 <= start < length:
            tags[start] = 2 * k + 1
    return tags


def _allowed() -> np.ndarray:
    """0 where one tag may follow another, else a large negative score."""
    scores = np.zeros((_TAGS, _TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 * k + 2
        scores[:, inside] = -1e4
        scores[inside - 1, inside] = scores[inside, inside] = 0
    return scores


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp(x)."""
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


class CharTagger:
    """The network: one-hot characters, two LSTMs, tag scores, transitions."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self._allowed = _allowed()

    @classmethod
    def fresh(cls, seed: int = 0) -> CharTagger:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        weights = {"out": normal(2 * _HIDDEN, _TAGS, scale=0.2), "bias": np.zeros(_TAGS, np.float32), "next": np.zeros((_TAGS, _TAGS), np.float32)}
        for side in "fb":
            weights[side + "x"] = normal(_PAD + 1, 4 * _HIDDEN, scale=0.3)
            weights[side + "h"] = normal(_HIDDEN, 4 * _HIDDEN, scale=0.25)
            weights[side + "x"][:, _HIDDEN : 2 * _HIDDEN] += 1.0
        return cls(weights)

    def _run(self, classes: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states, time first; gates are input, forget, output, candidate."""
        steps, batch = classes.shape
        h = c = np.zeros((batch, _HIDDEN), np.float32)
        own, h_weights = self.weights[side + "x"], self.weights[side + "h"]
        hidden = np.empty((steps, batch, _HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = own[classes[t]] + h @ h_weights
            gates = _sigmoid(z[:, : 3 * _HIDDEN])
            new = np.tanh(z[:, 3 * _HIDDEN :])
            i, f, o = np.split(gates, 3, axis=1)
            before, c_before = h, c
            c = f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            hidden[t] = h
            if keep is not None:
                keep.append((t, before, c_before, i, f, o, new, squashed))
        return hidden

    def _scores(self, hidden: np.ndarray) -> np.ndarray:
        return hidden @ self.weights["out"] + self.weights["bias"]

    def _chain(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities (time, batch, tag), and the summed probabilities of neighbouring pairs."""
        follow = self.weights["next"] + self._allowed
        steps = len(scores)
        ahead = np.empty_like(scores)
        behind = np.zeros_like(scores)
        # No text starts inside a span that is its own window's: a window may.
        ahead[0] = scores[0]
        for t in range(1, steps):
            ahead[t] = _total(ahead[t - 1][:, :, None] + follow, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = _total(follow + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        whole = _total(ahead[-1], 1)
        single = np.exp(ahead + behind - whole[None, :, None])
        pairs = np.zeros((_TAGS, _TAGS), np.float32)
        for t in range(steps - 1):
            later = scores[t + 1] + behind[t + 1] - whole[:, None]
            pairs += np.exp(np.clip(ahead[t][:, :, None] + follow + later[:, None, :], -60, 0)).sum(axis=0)
        return single, pairs

    def _gradients(self, classes: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        steps, batch = classes.shape
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = np.concatenate([self._run(classes, side, kept[side]) for side in "fb"], axis=2)
        single, pairs = self._chain(self._scores(hidden))
        onto = single
        np.subtract.at(onto, (np.arange(steps)[:, None], np.arange(batch)[None, :], tags), 1)
        np.subtract.at(pairs, (tags[:-1], tags[1:]), 1)
        onto /= batch
        flat = hidden.reshape(-1, 2 * _HIDDEN)
        out = {"out": flat.T @ onto.reshape(-1, _TAGS), "bias": onto.sum(axis=(0, 1)), "next": pairs / batch}
        d_hidden = onto @ self.weights["out"].T
        for side, part in (("f", slice(0, _HIDDEN)), ("b", slice(_HIDDEN, 2 * _HIDDEN))):
            h_weights = self.weights[side + "h"]
            dx, dw = np.zeros((steps, batch, 4 * _HIDDEN), np.float32), np.zeros_like(h_weights)
            dh = dc = np.zeros((batch, _HIDDEN), np.float32)
            for t, before, c_before, i, f, o, new, squashed in reversed(kept[side]):
                dh = dh + d_hidden[t][:, part]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * c_before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
                dx[t] = dz
                dw += before.T @ dz
                dh, dc = dz @ h_weights.T, dc * f
            hot = (np.arange(_PAD + 1)[:, None] == classes.reshape(1, -1)).astype(np.float32)
            out[side + "x"], out[side + "h"] = hot @ dx.reshape(-1, 4 * _HIDDEN), dw
        return out

    def train(self, classes: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 48, seed: int = 0, rate: float = 0.02) -> CharTagger:
        """Fit by Adam; ``classes`` and ``tags`` have a row per window. No windows: the weights stay."""
        if not len(classes):
            return self
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(classes), batch)
            grads = self._gradients(np.ascontiguousarray(classes[rows].T), np.ascontiguousarray(tags[rows].T))
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            shrink = min(1.0, 5.0 / max(norm, 1e-9))
            now = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * shrink * g
                second[k] = 0.999 * second[k] + 0.001 * (shrink * g) ** 2
                change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
                self.weights[k] = (self.weights[k] - now * change).astype(np.float32)
        return self

    def decode(self, classes: np.ndarray) -> list[list[tuple[str, int, int, float]]]:
        """For each window (a row) its best tag path's spans: kind, start, end, mean probability."""
        classes = np.ascontiguousarray(classes.T)
        scores = self._scores(np.concatenate([self._run(classes, side) for side in "fb"], axis=2))
        follow = self.weights["next"] + self._allowed
        steps, batch = classes.shape
        back = np.empty((steps, batch, _TAGS), np.int8)
        best = scores[0]
        for t in range(1, steps):
            options = best[:, :, None] + follow
            back[t] = options.argmax(axis=1)
            best = options.max(axis=1) + scores[t]
        path = np.empty((steps, batch), np.int64)
        path[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][np.arange(batch), path[t]]
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in range(batch)]
        with_spans = np.flatnonzero(path.any(axis=0))
        if len(with_spans):
            single, _ = self._chain(scores[:, with_spans])
            for column, w in enumerate(with_spans):
                out[w] = list(self._spans(path[:, w], single[:, column]))
        return out

    @staticmethod
    def _spans(path: np.ndarray, single: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
        kinds = np.where(path > 0, (path - 1) // 2, -1)
        starts = (path % 2 == 1) | ((kinds >= 0) & (np.concatenate([[-1], kinds[:-1]]) != kinds))
        for start in np.flatnonzero(starts & (kinds >= 0)):
            end = start + 1
            while end < len(path) and kinds[end] == kinds[start] and path[end] % 2 == 0:
                end += 1
            k = kinds[start]
            sure = single[start:end, [2 * k + 1, 2 * k + 2]].sum(axis=1).mean()
            yield KINDS[k], int(start), int(end), float(sure)


def reconcile(text: str, found: list[tuple[str, int, int, float]], base: list[Span]) -> list[Span]:
    """Spans of one text from its windows' spans; see the top of this module."""
    merged: list[tuple[str, int, int, float]] = []
    for kind, start, end, sure in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2])):
        if merged and merged[-1][0] == kind and start <= merged[-1][2]:
            _, first, last, other = merged[-1]
            merged[-1] = (kind, first, max(last, end), max(sure, other))
        else:
            merged.append((kind, start, end, sure))
    taken = sorted((start, end) for _, start, end in base)
    spans = list(base)
    for kind, start, end, sure in sorted(merged, key=lambda s: (-s[3], s[1])):
        part = text[start:end]
        start, end = end - len(part.lstrip()), start + len(part.rstrip())
        if sure < CERTAIN or not _TRIGGER.search(text, start, end) or any(a < end and start < b for a, b in taken):
            continue
        taken.append((start, end))
        spans.append((kind, start, end))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def tag_texts(tagger: CharTagger, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text the spans of the rules and all spans, over the whole text however long."""
    base = [base_spans(text) for text in texts]
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    rows: list[np.ndarray] = []
    where: list[tuple[int, int]] = []

    def run() -> None:
        for (n, start), spans in zip(where, tagger.decode(np.stack(rows)) if rows else (), strict=True):
            size = len(texts[n])
            for kind, a, b, sure in spans:
                # What a window's edge cuts off is whole in the next window, unless it is as long as what two windows share.
                cut = (a == 0 and start > 0) or (b == WINDOW and start + WINDOW < size)
                if start + b <= size and (not cut or b - a >= STRIDE):
                    found[n].append((kind, start + a, start + b, sure))
        rows.clear()
        where.clear()

    for n, text in enumerate(texts):
        windows = sorted({w for m in _TRIGGER.finditer(text) for w in (m.start() // STRIDE - 1, m.start() // STRIDE) if w >= 0})
        classes = _classes(text) if windows else None
        for w in windows:
            part = classes[w * STRIDE : w * STRIDE + WINDOW]
            rows.append(np.pad(part, (0, WINDOW - len(part)), constant_values=_PAD))
            where.append((n, w * STRIDE))
            if len(rows) == _BATCH:
                run()
    run()
    for text, own, spans in zip(texts, base, found, strict=True):
        yield own, reconcile(text, spans, own)


def training_windows(text: str, spans: list[Span], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows for training: around labelled spans, and around other digits and ``@``."""
    rng = np.random.default_rng(seed)
    classes, tags = _classes(text), span_tags(len(text), spans)
    places = [start for _, start, _ in spans] + [m.start() for m in _TRIGGER.finditer(text) if not tags[m.start()]][:8]
    for place in places[:32]:
        start = max(0, place - int(rng.integers(0, TRAIN_LENGTH - 24)))
        part = slice(start, start + TRAIN_LENGTH)
        short = TRAIN_LENGTH - len(classes[part])
        yield np.pad(classes[part], (0, short), constant_values=_PAD), np.pad(tags[part], (0, short))


def fit_tagger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", steps: int = 300) -> CharTagger:
    """Train on at most ``TRAIN_WINDOWS`` windows of at most about ``TRAIN_DOCUMENTS`` documents, drawn by a hash of the id.

    The labels are the spans of the rules. Without any labelled span the network stays untrained and finds nothing certain.
    """
    total = docs.count()
    share = min(1.0, TRAIN_DOCUMENTS / max(total, 1))
    drawn = F.xxhash64(F.lit("train"), F.col(doc_id))
    rows = docs.select(drawn.alias("drawn"), whole_text(text).alias("text")).where(
        (F.pmod("drawn", F.lit(1_000_000)) < F.lit(max(1, round(share * 1_000_000)))) & F.col("text").rlike("[0-9@]")
    )

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (classes, tags) in enumerate(training_windows(value, base_spans(value), key & 0xFFFF)):
                    out.append((key, n, classes.tobytes(), tags.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                names=["drawn", "n", "classes", "tags"],
            )

    sample = rows.mapInArrow(windows, "drawn long, n int, classes binary, tags binary")
    sample = sample.orderBy(F.xxhash64("drawn", "n"), "drawn", "n", "classes").limit(TRAIN_WINDOWS).collect()
    classes = np.array([np.frombuffer(r.classes, np.uint8) for r in sample]).reshape(-1, TRAIN_LENGTH)
    tags = np.array([np.frombuffer(r.tags, np.uint8) for r in sample]).reshape(-1, TRAIN_LENGTH).astype(np.int64)
    return CharTagger.fresh().train(classes, tags, steps) if tags.any() else CharTagger.fresh()


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, tagger: CharTagger, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, the counts of the rules' spans, their digest, and all spans as text.

    A null text is empty. Repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    weights = tagger.weights
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CharTagger(weights)
        for batch in batches:
            out = []
            for base, spans in tag_texts(own, batch.column(1).to_pylist()):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((*counts, hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)))
            columns = [pa.array([r[i] for r in out], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return rows.mapInArrow(find, f"doc_id {kind}, {FOUND}")


def mask_personal_data(docs: DataFrame, tagger: CharTagger, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in square brackets.

    Overlapping spans are replaced as one, by the kind that starts first. ``length``, if there is such a column and the text changed, is set
    to the new number of code points. A null text stays null; all other columns stay as they are.
    """
    weights, names = tagger.weights, docs.columns
    at = names.index(text)
    count = names.index(length) if length in names else -1

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CharTagger(weights)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            columns = list(batch.columns)
            sizes = columns[count].to_pylist() if count >= 0 else []
            for n, (_, spans) in enumerate(tag_texts(own, [t or "" for t in texts])):
                if spans:
                    parts, done = [], 0
                    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
                        if start >= done:
                            parts += [texts[n][done:start], f"[{kind.upper()}]"]
                        done = max(done, end)
                    texts[n] = "".join([*parts, texts[n][done:]])
                    if count >= 0:
                        sizes[n] = len(texts[n])
            columns[at] = pa.array(texts, columns[at].type)
            if count >= 0:
                columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(mask, docs.schema)


def op9_char_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by rules and by the network trained on a sample of the same table."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, fit_tagger(docs))
