"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest

from brindle.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, g string, pos string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r, add=0):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + add, r[1])))


def climb(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, at):
    for level in levels[:-1]:
        other = at ^ 1
        yield (level[other] if other < len(level) else "", other < at)
        at >>= 1


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    key = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf(r) for r in sorted(groups[g], key=key)]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, r in enumerate(sorted(groups[g], key=key)):
            proof = [*path(trees[g], at), *path(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r, 1 if bad else 0)
            for other, left in proof:
                now = h(other, now) if left else h(now, other)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(x for x, _ in proof)), now, now == top[-1][0]))
    return out


def row(i, text="x", lang="en", source="s", n=1):
    return (i, text, lang, source, n, 7, "clash", "clash")


def check(spark, rows, **more):
    got = merkle.result(spark.createDataFrame(rows, SCHEMA), **more).collect()
    text = lambda x: tuple(map(str, x))
    assert sorted(map(text, got)) == sorted(map(text, plain(rows)))
    return got


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 33, 300])
def test_sizes(spark, n):
    """Groups of one node, of a full block, of one more, and of several persisted levels."""
    rows = [row(i * 3, f"text {i}") for i in range(n)] + [row(10_000 + i, "é" * i, "fr") for i in range(n // 2)]
    assert any(not r["verified"] for r in check(spark, rows)) or n < 17


def test_one_level_a_table(spark):
    check(spark, [row(i, lang=f"l{i % 19:02d}") for i in range(150)], step=1)


def test_edges(spark):
    """Null in every column, empty and long texts, repeated ids and rows, groups by bytes, columns with clashing names."""
    rows = [row(1), row(1), row(1, "other"), row(2, None), row(3, ""), row(None), row(None, "y"), row(4, lang=None), row(5, lang=""), row(6, lang="Z"), row(7, lang="é"), row(8, lang="\U00010000"), row(9, lang="￿"), row(10, "long " * 200_000), row(11, source=None), row(0, n=None), row(33, n=None)]
    check(spark, rows)


def test_empty(spark):
    assert merkle.result(spark.createDataFrame([], SCHEMA)).collect() == []


def test_any_columns(spark):
    """The operator itself: other names, a proof that leads to the root, a change that does not."""
    df = spark.range(40).selectExpr("id AS k", "id % 3 AS part", "cast(id AS string) AS v")
    from pyspark.sql import functions as F

    out = merkle.manifest(df, "k", "part", ("k", "v"), tampered={"v": F.lit("changed")}, where=F.col("k") == 5).collect()
    assert len(out) == 40 and {r["k"] for r in out if not r["verified"]} == {5} and len({r["root"] for r in out}) == 1
