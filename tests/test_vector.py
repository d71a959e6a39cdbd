"""Blocked scores against plain Python."""

import random

import pytest

from brindle.operators import vector

SCHEMA = "point_id string, embedding array<float>, text string, type string, source string, path string, session_id string, history_hash string"


def cosine(a, b):
    dot = na = nb = 0.0
    for x, y in zip(a, b):
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    return dot / (na**0.5 * nb**0.5) if na and nb else 0.0


def made(spark, n=400, size=8, parts=5):
    r = random.Random(7)
    pool = [[float(r.randint(-2, 2)) for _ in range(size)] for _ in range(30)] + [[0.0] * size]
    rows = [(f"{r.getrandbits(40):010x}", r.choice(pool), f"t{k}", r.choice(["prompt", "answer", None]), r.choice("ab"), f"p{k}", f"s{k % 7}", "h") for k in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(rows, query, limit, keep=lambda r: True):
    return [(r[0], s) for s, r in sorted(((cosine(r[1], query), r) for r in rows if keep(r)), key=lambda x: (-x[0], x[1][0]))[:limit]]


@pytest.mark.parametrize("block", [1, 100, 1 << 20])
def test_search(spark, block):
    """Equal vectors stand in many rows, so ids decide at every limit."""
    rows, store = made(spark)
    query = [1.0, -1.0, 0.5, 0.0, 2.0, 1.0, -0.25, 1.0]
    vector.BLOCK = block
    try:
        for limit in (1, 5, 37, 1000):
            assert [(r["point_id"], r["score"]) for r in vector.search(store, query, limit).collect()] == plain(rows, query, limit)
        got = vector.search(store, query, 9, kind="prompt", sources=["a"], session="s3").collect()
        assert [(r["point_id"], r["score"]) for r in got] == plain(rows, query, 9, lambda r: r[3] == "prompt" and r[4] == "a" and r[6] == "s3")
    finally:
        vector.BLOCK = 4 << 20
    assert vector.search(store, query, 0).collect() == []


def test_pairs(spark):
    rows, store = made(spark)
    query = [0.5] * 8
    got = vector.paired(store, query, 6).collect()
    for kind in ("prompt", "answer", None):
        own = sorted((r["rank"], r["point_id"], r["score"]) for r in got if r["type"] == kind)
        assert [x[1:] for x in own] == plain(rows, query, 6, lambda r: r[3] == kind) and [x[0] for x in own] == list(range(1, 7))


def test_edges(spark):
    rows, store = made(spark, 3)
    query = [0.0] * 8
    assert [r["score"] for r in vector.search(store, query, 5).collect()] == [0.0] * 3
    assert vector.search(store.limit(0), query, 5).collect() == []
    null = spark.createDataFrame([("x", None, "t", "prompt", "a", "p", "s", "h")], SCHEMA)
    assert vector.search(null, query, 5).collect() == []
    for bad in ([1.0] * 7, [1.0] * 16):
        with pytest.raises(Exception, match="8 dimensions, the query"):
            vector.search(store, bad, 5).collect()
