"""Ranked search against a score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import ranked

DOCS, ITEMS = "doc_id long, text string, score long, rank string", "item_id long, text string, rank int, doc_id string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, most=50):
    held = [(d, Counter(words(t))) for d, t, *_ in docs]
    held = [(d, c) for d, c in held if c]
    total, every = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text, *_ in items:
        scored = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * total) // every
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:most], 1)]
    return out


def check(spark, docs, items, parts=3):
    got = ranked.result(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, got)) == sorted(map(key, plain(docs, items)))


def made(n, seed=1):
    r = random.Random(seed)
    letters = [a + b for a in "abcdefgh" for b in "aeiou"]
    word = lambda: letters[min(int(r.expovariate(0.15)), len(letters) - 1)]
    return [(i * 3, " ".join(word() for _ in range(r.randint(0, 40))), 0, "x") for i in range(n)], letters


def test_brute_force(spark):
    docs, letters = made(1500)
    r = random.Random(2)
    check(spark, docs, [(k, " ".join(r.choices(letters, k=r.randint(0, 12))), 0, "y") for k in range(40)])


def test_ties_and_repeats(spark):
    """A third of the rows are copies: the first ids of the copies, rows with equal ids each."""
    docs, _ = made(200)
    docs += [(10_000 - i, "aa be copy", 0, "") for i in range(300)] + [(5, "aa be copy", 0, "")] * 3
    check(spark, docs, [(1, "copy", 0, ""), (1, "copy", 0, ""), (2, "COPY aa", 0, "")], 7)


def test_edges(spark):
    """Nulls, empty and long texts, terms of other scripts, no terms, unknown terms."""
    docs = [(1, None, 0, ""), (2, "", 0, ""), (3, "É É é x_y", 0, ""), (None, "x null", 0, ""), (4, "日本 x", 0, ""), (5, "word " * 200_000 + "end", 0, ""), (6, " .,- ", 0, "")]
    check(spark, docs, [(1, None, 0, ""), (2, "...", 0, ""), (3, "É", 0, ""), (4, "x Y 日本", 0, ""), (5, "END nothing", 0, ""), (None, "null", 0, "")])


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a", 0, "")], DOCS), spark.createDataFrame([(1, "a", 0, "")], ITEMS)
    assert ranked.result(docs.limit(0), items).collect() == []
    assert ranked.result(docs, items.limit(0)).collect() == []


def test_blocks(spark, monkeypatch):
    """Items in many blocks have the results of one block."""
    monkeypatch.setattr(ranked, "BLOCK", 200)
    docs, letters = made(300)
    items = [(k, " ".join(letters[k : k + 5]), 0, "") for k in range(12)]
    assert len(list(ranked.blocks_of(spark.createDataFrame(items, ITEMS), "item_id", "text"))) > 3
    check(spark, docs, items)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 513, 4097])
def test_tree(n):
    """Bounds hold on every level; a search opens few leaves and finds the best and the ties."""
    r = np.random.default_rng(n)
    counts = [Counter(r.integers(0, 6, r.integers(0, 5)).tolist()) for _ in range(n)]
    term = [t for t in range(6) for c in counts if c[t]]
    at = [i for t in range(6) for i, c in enumerate(counts) if c[t]]
    own = sorted(set(term))
    row = {"docs": pa.array(range(n)), "sizes": [max(1, sum(c.values())) for c in counts], "terms": own, "starts": np.r_[0, np.cumsum([term.count(t) for t in own])], "at": at, "counts": [counts[i][t] for t, i in zip(term, at)]}
    shard = ranked.Shard(row, np.arange(1, 7) * 100, n, max(1, sum(row["sizes"])))
    every = sorted(((s, i) for k in range(shard.levels[0].shape[1]) for s, i in shard.leaf(shard.terms([0, 2, 5]), k)), key=lambda x: (-x[0], x[1]))
    assert shard.search([0, 2, 5], 50, 1) == every[:50]
    assert shard.bound([0, 2, 5]) >= (every[0][0] if every else 0)
    for low, high in zip(shard.levels, shard.levels[1:]):
        assert all((low[:, k] <= high[:, k // ranked.FAN]).all() for k in range(low.shape[1]))
    opened, leaf = [], shard.leaf
    shard.leaf = lambda own, k: opened.append(k) or leaf(own, k)
    if every:
        shard.search([0, 2, 5], 50, shard.bound([0, 2, 5]) + 1)
        assert not opened
