"""Byte-level BPE through a sentencepiece model that is written straight from the rank file.

Every token of the vocabulary becomes a piece: its bytes, each mapped to a printable character, scored by
the negative rank. The model has no normalisation, so its merges are those of the ranks: always
the best-ranked neighbouring pair, leftmost first. Texts are split by the pattern first, each match is encoded on
its own; decoding maps the pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import bounded_batches, kept_in_worker, load, unused_name

#: Matches that one task remembers the ids of; later ones are encoded anew each time.
REMEMBERED_MATCHES = 250_000
#: Characters of sentencepiece's own white-space mark, which no byte may be mapped to.
FIRST_MAPPED = 0x100


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def byte_alphabet() -> list[str]:
    """One character for each byte: printable ASCII stands for itself, others for letters from U+0100 on."""
    return [chr(b) if 0x21 <= b <= 0x7E else chr(FIRST_MAPPED + b) for b in range(256)]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, payload: bytes | int | float | str) -> bytes:
    """One protobuf field: a length-delimited value, a varint or a 32-bit float."""
    if isinstance(payload, str):
        payload = payload.encode("utf-8")
    if isinstance(payload, bytes):
        return _varint(number << 3 | 2) + _varint(len(payload)) + payload
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    return _varint(number << 3) + _varint(payload)


def piece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece 0 is unknown, piece r + 1 the token of rank r."""
    alphabet = byte_alphabet()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)]
    for rank, token in enumerate(tokens):
        text = "".join(alphabet[b] for b in token)
        # A piece may not be named like the unknown one.
        text = "\U000f0000" if text == "<unk>" else text
        pieces.append(_field(1, text) + _field(2, float(-rank)) + _field(3, normal))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1)
    trainer += _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class PieceCodec:
    """Encodes and decodes texts with a rank file, by a sentencepiece model."""

    def __init__(self, rank_path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(rank_path)
        self._whole = {token: rank for rank, token in enumerate(self.tokens)}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=piece_model(self.tokens))
        self._find = regex.compile(pattern).findall
        self._alphabet = byte_alphabet()
        self._known: dict[str, bytes] = {}

    def _learn(self, matches: list[str]) -> dict[str, bytes]:
        """Pieces of matches; one that is a token as a whole is that token, as a rank encoder has it."""
        found = {}
        rest = []
        for match in matches:
            data = match.encode("utf-8")
            rank = self._whole.get(data)
            if rank is None:
                rest.append((match, data.decode("latin-1").translate(self._alphabet)))
            else:
                found[match] = struct.pack("<I", rank + 1)
        encoded = self._model.encode([mapped for _, mapped in rest], num_threads=1) if rest else []
        for (match, _), ids in zip(rest, encoded, strict=True):
            found[match] = array("I", ids).tobytes()
        return found

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        known, find = self._known, self._find
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < 2_000_000:
                size += len(texts[stop])
                stop += 1
            held = [find(text) for text in texts[at:stop]]
            learnt = self._learn(list(dict.fromkeys(m for matches in held for m in matches if m not in known)))
            for match, ids in learnt.items():
                if len(known) >= REMEMBERED_MATCHES:
                    break
                if len(match) <= 40:
                    known[match] = ids
            for matches in held:
                pieces = b"".join([known.get(m) or learnt[m] for m in matches])
                yield np.frombuffer(pieces, np.uint32).astype(np.int32) - 1
            at = stop

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that the ids stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def _with_column(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField(name, kind)])


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in a new column ``ids``; a null or empty text has an empty array.

    All other columns stay; an existing column named ``ids`` is refused. An empty table stays empty.
    """
    if unused_name(docs, ids) != ids:
        raise ValueError(f"there is a column {ids} already")
    at, names = docs.columns.index(text), [*docs.columns, ids]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(("pieces", rank_path, pattern), lambda: PieceCodec(rank_path, pattern))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            start = 0
            while start < len(texts):
                # Rows whose ids stay well below the size of one Arrow batch.
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < 8_000_000):
                    size += len(texts[stop])
                    stop += 1
                rows = list(codec.encode_many(texts[start:stop]))
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                values = pa.array(np.concatenate(rows))
                column = pa.ListArray.from_arrays(pa.array(offsets), values)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=names)
                start = stop

    return docs.mapInArrow(encode, _with_column(docs, ids, T.ArrayType(T.IntegerType())))


def decode_ids(docs: DataFrame, rank_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of ``ids`` in a new column ``out``; null ids are no bytes."""
    if unused_name(docs, out) != out:
        raise ValueError(f"there is a column {out} already")
    at, names = docs.columns.index(ids), [*docs.columns, out]

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_in_worker(("ranks", rank_path), lambda: read_ranks(rank_path))
        for batch in batches:
            lists = batch.column(at)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            texts = [b"".join([tokens[i] for i in values[a:b].tolist()]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=names)

    return docs.mapInArrow(decode, _with_column(docs, out, T.BinaryType()))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    import public_tokenizers

    bounded_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    decoded = decode_ids(encoded, ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
