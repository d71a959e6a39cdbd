"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from brindle.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.default_model())


def same(library, own, texts):
    want, got = library.encode(texts, add_eos=True), own.encode(texts)
    for text, a, b in zip(texts, want, got):
        assert a == b, text[:200]
        assert library.decode(a) == own.decode(b), text[:200]


def test_shapes(library, own):
    same(library, own, ["", " ", "  a ", "▁", "▁▁ a", "a\x00b", "<s></s><unk><0x41>", "日本語", "😀 x", "\r\n\t", "é" * 9, " " * 100 + "執" + " " * 33 + "the" + " " * 16 + "x" + " " * 17, *(" " * n for n in range(70)), *(" " * n + "the" for n in range(40))])


def test_random(library, own):
    r = random.Random(3)
    letters = [" ", "a", "e", "t", "h", "▁", "\n", "執", "é", "😀", "_", "0", "-", "​", "q", "ß", "า"]
    same(library, own, ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)])
    same(library, own, ["".join(r.choices("etaoinshrdlu", k=r.randint(0, 60))) for _ in range(3000)])
    same(library, own, ["".join(r.choices(own.pieces[3:], k=r.randint(0, 30))) for _ in range(3000)])
    same(library, own, ["".join(chr(r.randrange(1, 0xD7FF)) for _ in range(20)) for _ in range(1000)])
    same(library, own, ["".join(r.choices(" e-=*#", [20, 1, 1, 1, 1, 1], k=r.randint(0, 90))) for _ in range(3000)])


def test_long(library, own):
    """Words of 100,000 letters, runs of a million characters, and texts of several segments."""
    r = random.Random(4)
    same(library, own, ["thequick" * 12_500, "".join(r.choices("abcdefghijklmnop", k=50_000)), "a" * 1_000_000, " " * 1_000_000, "".join(r.choices(["the ", "quick\n", "  brown"], k=400_000))])


def test_small_segments_and_tables(library, own, monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENT", 7)
    monkeypatch.setattr(pieces, "WORDS", 3)
    same(library, own, ["a b c d  e", "the quick brown fox  jumps", "", "x" * 30 + " y"] * 5)


def test_decode_any_ids(library, own):
    r = random.Random(5)
    some = [0, 1, 2, 259, 29871, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0x20, 3 + 0xF0, 3 + 0x80, 3 + 0x41]
    for _ in range(5000):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.choice(some) for _ in range(r.randint(0, 8))]
        assert library.decode(ids) == own.decode(ids), ids


def test_merges_wait(own):
    """A pair that a merge makes, of a lesser rank than the merge, comes first."""
    a, b, ab, bab = 1, 2, 3, 4
    own = object.__new__(pieces.Pieces)
    own.size = 5
    own.keys, own.made, own.ranks = np.array([a * 5 + b, b * 5 + ab]), np.array([ab, bab], np.int32), np.array([7, 2], np.int32)
    symbols = np.array([b, a, b, a, b], np.int32)
    assert own.merge(symbols, np.zeros(5, np.int64))[0].tolist() == [bab, ab]
    assert own.merge(np.array([a, b, b, a, b], np.int32), np.zeros(5, np.int64))[0].tolist() == [ab, bab]


def test_query_columns(spark, library):
    """Nulls, empty texts, repeated rows, other columns; an empty table gives no rows."""
    rows = [(1, "The quick  brown fox", 1, "x"), (1, "The quick  brown fox", 1, "x"), (2, None, 2, None), (3, "", 3, ""), (None, "é執", 4, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids_sha256 string")
    got = pieces.digests(df).collect()
    assert len(got) == 5
    for r, (doc, text, _, _) in zip(got, rows):
        ids = library.encode(text or "", add_eos=True)
        assert tuple(r) == (doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert pieces.digests(df.limit(0)).collect() == []


def test_columns_of_ids(spark, library):
    df = spark.createDataFrame([(1, "a b", "keep"), (2, None, "keep")], "doc_id long, text string, ids string")
    out = pieces.encode(df)
    assert out.columns == ["doc_id", "text", "ids", "_ids"]
    rows = pieces.decode(out, "_ids").collect()
    assert [r["_ids"] for r in rows] == [library.encode("a b", add_eos=True), [2]] and [r["decoded"] for r in rows] == ["a b", ""]
