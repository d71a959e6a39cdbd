"""Encoding in small groups, other patterns and ranks, and what a worker gives back."""

import numpy as np
import pytest

from brindle.llm import bpe


@pytest.fixture()
def small(monkeypatch):
    for name, value in (("KEEP_CHUNKS", 40), ("KEEP_FIRST", 10), ("GROUP_IDS", 7), ("GROUP_BYTES", 30), ("MOST_ROWS", 200)):
        monkeypatch.setattr(bpe, name, value)


def test_small_groups_give_the_same(small):
    import tiktoken

    path, pattern = bpe.vocabulary()
    own = bpe.Codec(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    texts = [None, "", *(f"some words{k} and  others\n{k} " + "xyzzy" * k for k in range(30))]
    for text, (ids, plain) in zip(texts, own.round_trip(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or "") and plain == (text or "").encode()
    own.rest()
    assert not own.chunks and own._db is None
    assert own.encode(["again"]) == [np.array(library.encode_ordinary("again"), "<u4").tobytes()]


def test_other_patterns_and_ranks(tmp_path):
    """Ranks over 65,536, and a pattern that the blanks do not cut."""
    import base64

    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 70_000, b"bc": 70_001, b"abc": 200_000, b" a": 70_002, b"a b": 300_000}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    for pattern in (r"[\s\S]{1,5}", r"\S+|\s+"):
        own = bpe.Codec(str(path), pattern)
        library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for text in ("abc abcab bca", "a b a b\nabc", "abab abab ab"):
            ids, plain = own.round_trip([text])[0]
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and plain == text.encode()


def test_long_words(tmp_path, monkeypatch):
    """Words of up to a million letters, one after the other, in a folder that cannot be written."""
    import os
    import random
    import time

    import tiktoken

    path, pattern = bpe.vocabulary()
    own = bpe.Codec(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(3)
    folder = tmp_path / "closed"
    folder.mkdir()
    monkeypatch.chdir(folder)
    os.chmod(folder, 0o500)
    for text in ("thequick" * 12_500, "a" * 1_000_000, "".join(r.choices("abcdefgh", k=3000)), "antidisestablishment" * 40):
        began = time.perf_counter()
        ids, plain = own.round_trip([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and plain == text.encode()
        assert time.perf_counter() - began < 60
    os.chmod(folder, 0o700)
    assert list(folder.iterdir()) == []
