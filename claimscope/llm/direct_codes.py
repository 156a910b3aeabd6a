"""Token ids as directly addressable codes.

A file holds segments of at most ``SEGMENT_TOKENS`` ids. A segment splits each id into
chunks of eight bits, lowest first. Level 0 has the lowest chunk of every id, level k the
k-th chunk of the ids that are long enough. Every level but the last has a bitmap that says which
of its ids go on, and a rank directory: for each block of 512 bits, the set bits before it.
The chunk of id i on the next level is at rank(i), so one id is read with a few small reads and no
block of ids is decoded. A footer has the documents, in ascending order, with their first id.

Tasks write their file under a name of their own attempt; the table of the files, which Spark commits, says
which files count. What a lost executor left behind is in no table and is never read.

File layout, little-endian: segments, footer, 8 bytes footer length, magic.
"""

from __future__ import annotations

import json
import string
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import byte_rows, kept_in_worker, load, stage, staging_root, whole_text

MAGIC = b"DACIDS01"
SEGMENT_TOKENS = 1 << 20
BLOCK_BYTES = 64
#: Words that one task remembers the ids of; the words after these are encoded anew each time.
REMEMBERED_WORDS = 700_000
#: Bytes of text, or one text, whose words are looked up together.
HELD_BYTES = 4_000_000
PUNCTUATION = string.punctuation.encode()
MANIFEST = "file_no int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, first long, n_tokens long, ids_crc32 long"


def pack_segment(ids: np.ndarray) -> bytes:
    """The bytes of one segment."""
    values = ids.astype(np.uint32)
    levels: list[bytes] = []
    while True:
        chunk = (values & 0xFF).astype(np.uint8).tobytes()
        longer = values > 0xFF
        if not longer.any():
            levels.append(struct.pack("<IB", len(values), 0) + chunk)
            break
        bits = np.packbits(longer, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % BLOCK_BYTES))
        ones = np.bitwise_count(bits).reshape(-1, BLOCK_BYTES).sum(axis=1, dtype=np.uint32)
        before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
        levels.append(struct.pack("<IB", len(values), 1) + chunk + bits.tobytes() + before.tobytes())
        values = values[longer] >> 8
    return struct.pack("<B", len(levels)) + b"".join(levels)


class Segment:
    """Ids of a packed segment, addressed by position. ``read(start, stop)`` gives its bytes."""

    def __init__(self, read):
        self._read = read
        self._levels = []
        (count,) = read(0, 1)
        at = 1
        for _ in range(count):
            n, more = struct.unpack("<IB", read(at, at + 5))
            chunks = at + 5
            bits = chunks + n
            padded = -(-n // (8 * BLOCK_BYTES)) * BLOCK_BYTES if more else 0
            ranks = bits + padded
            at = ranks + padded // BLOCK_BYTES * 4
            self._levels.append((chunks, bits if more else None, ranks))

    def _rank(self, level: int, i: int) -> int:
        _, bits, ranks = self._levels[level]
        block, rest = divmod(i, 8 * BLOCK_BYTES)
        (before,) = struct.unpack("<I", self._read(ranks + 4 * block, ranks + 4 * block + 4))
        start = bits + block * BLOCK_BYTES
        inside = np.frombuffer(self._read(start, start + -(-rest // 8)), np.uint8)
        return before + int(np.unpackbits(inside, bitorder="little")[:rest].sum())

    def token(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self._levels):
            value |= self._read(chunks + i, chunks + i + 1)[0] << (8 * level)
            if bits is None or not self._read(bits + i // 8, bits + i // 8 + 1)[0] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids at positions ``start`` up to ``stop``."""
        values = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self._levels):
            chunk = np.frombuffer(self._read(chunks + start, chunks + stop), np.uint8)
            values[where] |= chunk.astype(np.uint32) << np.uint32(8 * level)
            if bits is None or start == stop:
                break
            own = np.frombuffer(self._read(bits + start // 8, bits + -(-stop // 8)), np.uint8)
            on = np.unpackbits(own, bitorder="little")[start % 8 :][: stop - start].astype(bool)
            start = self._rank(level, start)
            where = where[on]
            stop = start + len(where)
        return values


class CodeWriter:
    """Writes one file; documents come in ascending order."""

    def __init__(self, out):
        self._out = out
        self._size = 0
        self._held: list[np.ndarray] = []
        self._n_held = 0
        self._segments: list[tuple[int, int]] = []
        self._doc_ids: list[int | None] = []
        self._firsts: list[int] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._doc_ids.append(doc_id)
        self._firsts.append(self.n_tokens)
        self.n_tokens += len(ids)
        while len(ids):
            part, ids = np.split(ids, [SEGMENT_TOKENS - self._n_held])
            self._held.append(part)
            self._n_held += len(part)
            if self._n_held == SEGMENT_TOKENS:
                self._flush()

    def _write(self, data: bytes) -> None:
        self._out.write(data)
        self._size += len(data)

    def _flush(self) -> None:
        if self._n_held:
            packed = pack_segment(np.concatenate(self._held))
            self._segments.append((self._size, len(packed)))
            self._write(packed)
            self._held, self._n_held = [], 0

    def close(self) -> None:
        self._flush()
        missing = np.array([x is None for x in self._doc_ids], np.uint8)
        footer = b"".join(
            [
                struct.pack("<QQQ", self.n_tokens, len(self._segments), len(self._doc_ids)),
                np.array(self._segments, "<u8").tobytes(),
                np.array([x or 0 for x in self._doc_ids], "<i8").tobytes(),
                missing.tobytes(),
                np.array(self._firsts, "<u8").tobytes(),
            ]
        )
        self._write(footer + struct.pack("<Q", len(footer)) + MAGIC)

    @property
    def n_docs(self) -> int:
        return len(self._doc_ids)


class CodeFile:
    """Random access to the ids of a written file."""

    def __init__(self, path: str):
        filesystem, inner = pafs.FileSystem.from_uri(path)
        self._file = filesystem.open_input_file(inner)
        size = self._file.size()
        length, magic = struct.unpack("<Q8s", self._file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a file of token ids")
        footer = self._file.read_at(length, size - 16 - length)
        self.n_tokens, n_segments, n_docs = struct.unpack_from("<QQQ", footer)
        at = 24
        self._segments = np.frombuffer(footer, "<u8", 2 * n_segments, at).reshape(-1, 2)
        at += 16 * n_segments
        self.doc_ids = np.frombuffer(footer, "<i8", n_docs, at)
        at += 8 * n_docs
        self.missing = np.frombuffer(footer, np.uint8, n_docs, at)
        at += n_docs
        self.firsts = np.append(np.frombuffer(footer, "<u8", n_docs, at), self.n_tokens).astype(np.int64)
        self._loaded: tuple[int, Segment] | None = None

    def token(self, i: int) -> int:
        """The id at position ``i`` of the file, by reads of single bytes."""
        k, inside = divmod(i, SEGMENT_TOKENS)
        offset = int(self._segments[k][0])
        return Segment(lambda a, b: self._file.read_at(b - a, offset + a)).token(inside)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``; one segment is kept in memory."""
        parts = []
        while start < stop:
            k, inside = divmod(start, SEGMENT_TOKENS)
            if self._loaded is None or self._loaded[0] != k:
                offset, size = map(int, self._segments[k])
                data = memoryview(self._file.read_at(size, offset))
                self._loaded = (k, Segment(lambda a, b, data=data: data[a:b]))
            n = min(stop - start, SEGMENT_TOKENS - inside)
            parts.append(self._loaded[1].tokens(inside, inside + n))
            start += n
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def close(self) -> None:
        self._file.close()


def ends_in_letter(word: bytes) -> bool:
    """Whether the last character is a lower-case ASCII letter or a letter of Latin-1 beyond ASCII."""
    last = word[-1:]
    return b"a" <= last <= b"z" or word[-2:-1] == b"\xc3" and last not in b"\x97\xb7"


class WordEncoder:
    """Ids of whole texts from the tokenizers library, which is asked once for a word.

    The tokenizer drops white space and never merges across it, so the ids of a text are those
    of its words. ASCII letters are lower-cased first, as its normaliser does anyway, and ASCII punctuation that ends a word
    after a letter is always cut off. Arrow splits the texts, finds the distinct words of a few megabytes and puts the
    ids of each text together; only distinct words are looked up here. A text with the start of a special token goes to the library as it is.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as file:
            self._tokenizer = Tokenizer.from_str(file.read())
        vocabulary = json.loads(self._tokenizer.to_str())["model"]["vocab"]
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._known: dict[bytes, bytes] = {}

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words; those of single-token-run words come from one call for many words."""
        found: dict[bytes, bytes] = {}
        texts = [w.decode("utf-8") for w in words]
        simple = [(w, t) for w, t in zip(words, texts, strict=True) if t.isalpha()]
        for at in range(0, len(simple), 512):
            part = simple[at : at + 512]
            (encoding,) = self._tokenizer.encode_batch_fast([" ".join(t for _, t in part)], add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4")
            stops = np.flatnonzero(self._ends[np.minimum(ids, len(self._ends) - 1)]) + 1
            if len(stops) == len(part):
                data, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
                found.update((w, data[a:b]) for (w, _), a, b in zip(part, cuts[:-1], cuts[1:], strict=True))
        rest = [(w, t) for w, t in zip(words, texts, strict=True) if w not in found]
        for at in range(0, len(rest), 512):
            part = rest[at : at + 512]
            encodings = self._tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)
            found.update((w, np.array(e.ids, "<u4").tobytes()) for (w, _), e in zip(part, encodings, strict=True))
        return found

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        known = self._known
        found = list(map(known.get, words))
        whole: list[int] = []
        parted: list[tuple[int, bytes, bytes]] = []
        new: dict[bytes, None] = {}
        for k in [k for k, ids in enumerate(found) if ids is None]:
            word = words[k]
            stem = word.rstrip(PUNCTUATION)
            if len(stem) < len(word) and ends_in_letter(stem):
                tail = word[len(stem) :]
                parted.append((k, stem, tail))
                new.update({w: None for w in (stem, tail) if w not in known})
            else:
                whole.append(k)
                new[word] = None
        learnt = self._learn(list(new))
        for k in whole:
            found[k] = learnt[words[k]]
        for k, stem, tail in parted:
            found[k] = (learnt[stem] if stem in learnt else known[stem]) + (learnt[tail] if tail in learnt else known[tail])
        for word, ids in learnt.items():
            if len(known) >= REMEMBERED_WORDS:
                break
            if len(word) <= 40:
                known[word] = ids
        return found

    def encode_many(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """For each text the ids as little-endian 32-bit integers."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > HELD_BYTES:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, held: list[bytes]) -> Iterator[bytes]:
        special = [b"<|" in text for text in held]
        split = pa.array([b"" if s else text for text, s in zip(held, special, strict=True)], pa.large_binary())
        split = pc.ascii_split_whitespace(pc.ascii_lower(split.cast(pa.large_string())))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._look_up(distinct), pa.large_binary()).take(words.indices)
        for text, s, own in zip(held, special, pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids), pa.scalar(b"", pa.large_binary())), strict=True):
            yield self._plain(text.decode("utf-8")).tobytes() if s else own.as_py()


def write_codes(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    files: int | None = None,
) -> DataFrame:
    """Encode ``text``, append ``end_id`` to each document and write the files.

    Documents are dealt out by ranges of ``doc_id`` (nulls first; repeated ids by their text), so the files one after another hold them in
    ascending order. A null text is empty and has only the end id. Returns the table of the files:
    ``file_no, path, n_docs, n_tokens``; an empty ``docs`` has none. Other columns are not read. ``folder`` must be seen by all executors.
    """
    session = docs.sparkSession
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    count = files or int(session.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(count, *order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = None
        number = TaskContext.get().partitionId()
        path = f"{folder}/part-{number:05d}-{uuid.uuid4().hex}.dac"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = kept_in_worker(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
                filesystem, inner = pafs.FileSystem.from_uri(path)
                out = filesystem.open_output_stream(inner)
                writer = CodeWriter(out)
            end = np.array([end_id], "<u4").tobytes()
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(byte_rows(batch.column(1))), strict=True):
                writer.add(key, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([path]), pa.array([writer.n_docs]), pa.array([writer.n_tokens])],
                names=["file_no", "path", "n_docs", "n_tokens"],
            )

    return stage(rows.mapInArrow(write, MANIFEST), "code-files")


def read_codes(files: DataFrame) -> DataFrame:
    """Read files back: ``doc_id, first`` (ids of all documents before it), ``n_tokens, ids_crc32``.

    One row per document. Positions run on over the files in the order of ``file_no``.
    """
    order = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = CodeFile(path)
                for at in range(0, len(file.doc_ids), 20_000):
                    spans = file.firsts[at : at + 20_001]
                    part = slice(at, at + len(spans) - 1)
                    crcs = [zlib.crc32(file.tokens(a, b).astype("<u4").tobytes()) for a, b in zip(spans[:-1], spans[1:], strict=True)]
                    ids = pa.array(file.doc_ids[part], mask=file.missing[part].astype(bool))
                    columns = [ids, pa.array(spans[:-1] + before), pa.array(np.diff(spans)), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first", "n_tokens", "ids_crc32"])
                file.close()

    spread = placed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(read, DOCUMENTS)


def op10_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as directly addressable codes and read back."""
    import public_tokenizers

    folder = f"{staging_root(spark)}/codes-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    files = write_codes(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_codes(files).select("doc_id", F.col("first").alias("start"), "n_tokens", "ids_crc32")
