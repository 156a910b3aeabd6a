"""Token ids: the two codecs and the file format, against the public libraries."""

import base64
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimscope.llm import direct_codes
from claimscope.llm.direct_codes import Segment, WordEncoder, pack_segment, read_codes, write_codes
from claimscope.llm.piece_codec import PieceCodec, decode_ids, encode_texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "  ", "It's a\n\n b.", "<unk> ▁ <|endoftext|>", "日本語 \x00\x7f", "a" * 5000, " " * 300, "ÀÈ! 123456", "été, \U0001f642\U0001f44d", None]


def tiktoken_encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_piece_codec_gives_the_ids_of_the_rank_encoder(spark):
    expected = tiktoken_encoding()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    encoded = encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    for row in decode_ids(encoded, RANKS).collect():
        text = row.text or ""
        assert row.ids == expected.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
        assert row.n_tokens == "x"


def test_every_token_is_reached_by_merges():
    codec = PieceCodec(RANKS, public_tokenizers.PATTERN)
    for rank, token in list(enumerate(codec.tokens))[::97]:
        assert codec._model.encode(token.decode("latin-1").translate(codec._alphabet)) == [rank + 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_segments_give_any_id_and_any_range():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 500), [0, 255, 256, 2**32 - 1]]).astype(np.uint32)
    rng.shuffle(ids)
    data = pack_segment(ids)
    segment = Segment(lambda a, b: data[a:b])
    assert [segment.token(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()
    for a, b in [(0, len(ids)), (5, 5), (511, 513), (700, 3100), (len(ids) - 1, len(ids))]:
        assert segment.tokens(a, b).tolist() == ids[a:b].tolist()


def test_word_encoder_equals_the_library():
    library = Tokenizer.from_file(WORDS)
    texts = [t or "" for t in TEXTS] + ["The END. the end, end.. .x x.y,z", "KK İI Σσς", "a b c"]
    got = [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(WORDS).encode_many(t.encode() for t in texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_asked_for_once_and_without_their_punctuation():
    asked = []

    class Asked(WordEncoder):
        def _learn(self, words):
            asked.extend(words)
            return super()._learn(words)

    library = Tokenizer.from_file(WORDS)
    ends = ["", ".", ",!!", "&&&", "'", "`^~", ".\u0301", "'s", "!1"]
    words = ["word", "\u00e9t\u00e9", "\u00c9", "\u00ff", "Z", "\u00f7", "\u00d7", "1", "\u00aa", "e\u0301", "don't", "'"]
    texts = ["  ".join(w + e for e in ends) for w in words] + ["word!! word) (word", "\n\t", "", "<|endoftext|> word!!"] * 2
    got = [np.frombuffer(x, "<u4").tolist() for x in Asked(WORDS).encode_many(t.encode() for t in texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked))
    assert [w for w in asked if w.startswith(b"word")] == [b"word", "word.\u0301".encode(), b"word's", b"word!1"]


def test_words_beyond_those_remembered_and_texts_beyond_a_lookup(monkeypatch):
    monkeypatch.setattr(direct_codes, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(direct_codes, "HELD_BYTES", 20)
    library = Tokenizer.from_file(WORDS)
    texts = [f"word{i % 3}, {'long' * i}!! w\u00e9\u00e9. again..." for i in range(30)]
    got = [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(WORDS).encode_many(t.encode() for t in texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_are_read_back_in_order(spark, tmp_path):
    rows = [(i, f"word {i} " * (i % 7)) for i in range(50)] + [(3, "again"), (3, "again"), (None, "no id"), (60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit("clash"))
    files = write_codes(docs, WORDS, f"file://{tmp_path}", files=4)
    found = read_codes(files).orderBy("first").collect()
    library = Tokenizer.from_file(WORDS)
    expected = sorted((i if i is not None else -1, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in rows)
    assert [r.doc_id if r.doc_id is not None else -1 for r in found] == [i for i, _ in expected]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in found) == expected
    assert [r.first for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()


def test_no_documents_no_files(spark, tmp_path):
    files = write_codes(spark.createDataFrame([], "doc_id long, text string"), WORDS, f"file://{tmp_path}")
    assert files.count() == 0 and read_codes(files).count() == 0
