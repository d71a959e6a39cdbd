"""Exact removal of repeated byte strings with sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Suffixes
are sampled by content: among the starts of ``CONTEXT`` bytes inside a string of LENGTH bytes
the one with the least hash is the string's anchor, so equal strings have equal anchors at
equal offsets, and every string is examined at its anchor alone.

1. Anchors whose context occurs once hold no repeat.  Contexts are counted over all documents.
2. Where all texts around a context agree, all their strings repeat.  Of the others one copy of
   each distinct text is kept for comparison.
3. Those suffixes (from the anchor on, then the bytes before it) are dealt out by range, with
   splitters sampled from the whole suffixes, so that a frequent context spreads over buckets.
   Each bucket sorts by multikey quicksort, eight bytes a digit, once to the right of the anchor
   and once to its left; strings are equal if both sides fall in one class at their depths.
4. Suffixes that agree with a bucket's first or last one as far as one of their strings goes
   may go on in the next bucket.  Each is dealt out once more, now by what stands to its left,
   and compared again; only strings at the borders of both dealings are compared by digest.
5. Covered bytes are merged and removed for each document.

Defined results: a null or empty text has no bytes and keeps them all; texts shorter than
LENGTH keep all; rows that repeat in full are copies of each other, so their strings go from
both; long texts are worked on in segments; overlaps count, ties need no order; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import collect_garbage, cut, drop

LENGTH, CONTEXT = 200, 64
WINDOW = LENGTH - CONTEXT + 1
SEGMENT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LOW = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (BASE, inverse)]
    return _powers


def hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of the k bytes from every position on."""
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(b) - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes):
    """(context hash, anchor, first start, last start) arrays: the strings that start from the
    first to the last start have this anchor."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, SEGMENT):
        b = np.frombuffer(data, np.uint8, count=min(SEGMENT + LENGTH - 1, len(data) - at), offset=at)
        h = hashes(b, CONTEXT)
        keys = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        own = (sliding_least(keys, WINDOW) & LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        last = np.append(first[1:], len(own)) - 1
        out.append((h[own[first]].view(np.int64), own[first] + at, first + at, last + at))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, data): doc is a key of the row's id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    return src.select("id", F.xxhash64("id", "text").alias("doc"), F.col("text").cast("binary").alias("data"))


def anchor_rows(src: DataFrame, full: bool) -> DataFrame:
    """(ctx, body[, doc, a, lo, hi]): body is a digest of all strings at the anchor together."""
    names = ["ctx", "body"] + ["doc", "a", "lo", "hi"] * full
    kinds = [pa.int64(), pa.int64()] + [pa.int64(), pa.int32(), pa.int32(), pa.int32()] * full
    schema = pa.schema(list(zip(names, kinds)))

    def rows(it):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in it:
            docs, texts = batch.column("doc").to_pylist(), batch.column("data")
            parts = [[] for _ in names]

            def flush():
                return pa.RecordBatch.from_pydict({n: np.concatenate(p) for n, p in zip(names, parts)}, schema=schema)

            size = 0
            for doc, text in zip(docs, texts):
                data = text.as_py()
                if len(data) < LENGTH:
                    continue
                ctx, a, lo, hi = anchors(data)
                body = np.array([digest(data[x : y + LENGTH], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (a - lo).tolist())], np.uint64).view(np.int64)
                for p, v in zip(parts, (ctx, body, np.full(len(a), doc), a, lo, hi)):
                    p.append(v)
                size += len(a)
                if size > 200_000:
                    yield flush()
                    parts, size = [[] for _ in names], 0
            if size:
                yield flush()

    return src.select("doc", "data").mapInArrow(rows, "ctx long, body long" + ", doc long, a int, lo int, hi int" * full)


def multikey_sort(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, common prefix with the one before, matrix in order, sizes in order)

    One digit of eight bytes at a time, and only inside runs that are still equal.
    """
    n, width = len(strings), -(-width // 8) * 8
    sizes = np.fromiter(map(len, strings), np.int64, n)
    m = np.zeros((n, width), np.uint8)
    m[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    digits = m.view(">u8").astype(np.uint64)
    order, run, live = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for k in range(width // 8 + 1):
        part = order[live]
        digit = digits[part, k] if k < width // 8 else sizes[part].astype(np.uint64)
        inside = np.lexsort((digit, run[live]))
        order[live] = part[inside]
        digit, group = digit[inside], run[live]
        new = np.zeros(n, bool)
        new[live[1:]] = (digit[1:] != digit[:-1]) & (group[1:] == group[:-1])
        starts = np.zeros(n, bool)
        starts[0:1] = True
        starts[1:] = run[1:] != run[:-1]
        starts |= new
        run = np.cumsum(starts)
        same = np.zeros(n, bool)
        same[1:] = run[1:] == run[:-1]
        live = np.flatnonzero(same | np.append(same[1:], False))
        if not len(live):
            break
    m, sizes = m[order], sizes[order]
    return order, common(m[1:], m[:-1], np.minimum(sizes[1:], sizes[:-1]), True), m, sizes


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray, lead: bool = False) -> np.ndarray:
    """Common prefix of rows, ``most`` at most; with a leading 0 for a first row."""
    differ = a != b
    got = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    got = np.minimum(got, most)
    return np.concatenate([[0], got]) if lead else got


def to_borders(order: np.ndarray, matrix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row the longest common prefix with the first or the last one of the order."""
    edge = np.zeros(len(order), np.int64)
    for k in (0, len(order) - 1):
        edge[order] = np.maximum(edge[order], common(matrix, np.broadcast_to(matrix[k], matrix.shape), np.minimum(sizes, sizes[k])))
    return edge


def compare(right: list[bytes], left: list[bytes], near: np.ndarray, far: np.ndarray, weight: np.ndarray, reach: np.ndarray | None = None):
    """Strings of a bucket: (row, first offset, last offset) of runs that repeat in it, and what
    may go on in other buckets.

    Row k has the strings at offsets near[k]..far[k]: that many bytes from ``left`` (which runs
    backwards from the anchor), the rest from ``right``; ``weight`` says how often its text occurs.
    In the first dealing that is (rows, their agreement with a border to the right).  In the
    second one, given this agreement as ``reach``, it is (row, offset, weight) of each class of
    strings that may go on across borders of both.
    """
    n = len(right)
    r_order, r_common, r_matrix, r_sizes = multikey_sort(right, LENGTH)
    l_order, l_common, l_matrix, l_sizes = multikey_sort(left, WINDOW)
    r_at, l_at = np.empty(n, np.int64), np.empty(n, np.int64)
    r_at[r_order], l_at[l_order] = np.arange(n), np.arange(n)
    edge = to_borders(r_order, r_matrix, r_sizes) if reach is None else to_borders(l_order, l_matrix, l_sizes)
    repeats, borders = [], []
    for d in range(int(near.min()), int(far.max()) + 1):
        rows = np.flatnonzero((near <= d) & (d <= far))
        if not len(rows):
            continue
        # Rows that are shorter than the depth stand before those that share it, never between.
        key = np.cumsum(r_common < LENGTH - d)[r_at[rows]] * np.int64(n + 1) + np.cumsum(l_common < d)[l_at[rows]]
        inside = np.argsort(key, kind="stable")
        new = np.append(True, key[inside][1:] != key[inside][:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(rows)))
        hit = rows[inside[count[np.cumsum(new) - 1] > 1]]
        repeats.append((hit, np.full(len(hit), d)))
        if reach is not None:
            total = np.add.reduceat(weight[rows[inside]], first)
            shown = rows[inside[first]]
            outer = (edge[shown] >= d) & (np.maximum.reduceat(reach[rows[inside]], first) >= LENGTH - d)
            borders.append((shown[outer], np.full(int(outer.sum()), d), total[outer]))
    row, d = (np.concatenate(x) for x in zip(*repeats))
    order = np.lexsort((d, row))
    row, d = row[order], d[order]
    starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (d[1:] != d[:-1] + 1))[: len(row)])
    ends = np.append(starts[1:], len(row))[: len(starts)] - 1
    runs = row[starts], d[starts], d[ends]
    if reach is None:
        further = np.flatnonzero(edge >= LENGTH - far)
        return runs, (further, edge[further])
    return runs, tuple(np.concatenate(x) for x in zip(*borders))


SUFFIX = "ctx long, doc long, a int, lo int, hi int, n long, r binary, l binary"
#: Suffixes in a bucket, about.
BUCKET = 50_000


def by_range(suffixes: DataFrame, first: str, then: str) -> DataFrame:
    """Suffixes in ranges of bounded size; splitters are sampled by the exchange."""
    return suffixes.repartitionByRange(max(1, -(-suffixes.count() // BUCKET)), first, then)


def fields(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def opened(it):
    """A bucket as its table and the arguments of ``compare``; nothing for an empty one."""
    if not (it := list(it)):
        return
    table = pa.Table.from_batches(it)
    if table.num_rows:
        a, lo, hi, n = (table[c].to_numpy() for c in ("a", "lo", "hi", "n"))
        yield table, (table["r"].to_pylist(), table["l"].to_pylist(), a - hi, a - lo, n)


def runs_of(table: pa.Table, found) -> dict:
    row, near, far = found
    alone = table["n"].to_numpy()[row] == 1  # the strings of texts that occur twice are known to repeat
    row, near, far = row[alone], near[alone], far[alone]
    a = table["a"].to_numpy()[row]
    return {"doc": table["doc"].to_numpy()[row], "s": a - far, "e": a - near + LENGTH}


FIRST = "s int, e int, reach int, " + SUFFIX


def sorted_buckets(it):
    """Compare each bucket: rows with s and e are runs of repeated strings, the others suffixes
    that may go on in another bucket, at most one for each suffix."""
    schema = fields(FIRST)
    for table, (right, left, near, far, n) in opened(it):
        runs, (further, reach) = compare(right, left, near, far, n)
        found = runs_of(table, runs)
        none = pa.nulls(len(found["s"]))
        yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else none.cast(f.type) for f in schema], schema=schema)
        for at in range(0, len(further), 20_000):
            part = table.take(pa.array(further[at : at + 20_000])).combine_chunks()
            extra = {"reach": pa.array(reach[at : at + 20_000], pa.int32())}
            columns = [part[f.name].combine_chunks() if f.name in part.column_names else extra.get(f.name, pa.nulls(part.num_rows, f.type)) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


SECOND = "doc long, s int, e int, ctx long, h1 long, weight long"


def border_buckets(it):
    """Compare suffixes dealt out by their left side: runs (weight null), and classes of strings at borders."""
    import xxhash

    schema = fields(SECOND)
    for table, (right, left, near, far, n) in opened(it):
        runs, (edge, at, weight) = compare(right, left, near, far, n, table["reach"].to_numpy())
        found = runs_of(table, runs)
        yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(len(found["s"]), f.type) for f in schema], schema=schema)
        doc, a, ctx = (table[c].to_numpy() for c in ("doc", "a", "ctx"))
        for k in range(0, len(edge), 100_000):
            x, d, w = edge[k : k + 100_000], at[k : k + 100_000], weight[k : k + 100_000]
            whole = [xxhash.xxh3_64_intdigest(left[i][:q][::-1] + right[i][: LENGTH - q], q) for i, q in zip(x.tolist(), d.tolist())]
            yield pa.RecordBatch.from_pydict({"doc": doc[x], "s": a[x] - d, "e": a[x] - d + LENGTH, "ctx": ctx[x], "h1": np.array(whole, np.uint64).view(np.int64), "weight": w}, schema=schema)


def with_texts(src: DataFrame, reps: DataFrame) -> DataFrame:
    """The suffixes to compare: (ctx, doc, a, lo, hi, n, r, l)."""
    schema = fields(SUFFIX)

    def rows(it):
        for batch in it:
            for doc, data, own in zip(batch["doc"].to_pylist(), batch["data"].to_pylist(), batch["own"].to_pylist()):
                out = {n: [] for n in schema.names}
                for x in own:
                    a, lo, hi = x["a"], x["lo"], x["hi"]
                    for name, v in zip(out, (x["ctx"], doc, a, lo, hi, x["n"], data[a : hi + LENGTH], data[lo:a][::-1])):
                        out[name].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    by = reps.groupBy("doc").agg(F.collect_list(F.struct("ctx", "a", "lo", "hi", "n")).alias("own"))
    # Rows that repeat in full share a key; one of them is enough.
    pairs = src.select("doc", "data").join(by.withColumnRenamed("doc", "k"), F.col("doc") == F.col("k")).select("doc", "data", "own")
    return pairs.mapInArrow(rows, SUFFIX)


def spans(src: DataFrame) -> DataFrame:
    """(doc, runs array<struct<s, e>>): byte ranges covered by repeated strings, not yet merged."""
    spark = src.sparkSession
    counted = anchor_rows(src, False).groupBy("ctx").agg(F.count("*").alias("c"), F.min("body").alias("x"), F.max("body").alias("y"))
    known = cut(counted.where("c > 1").select(F.col("ctx").alias("k"), (F.col("x") != F.col("y")).alias("mixed")), "contexts")
    collect_garbage(spark)
    # The table of contexts is read from files, so both sides are dealt out and a hot one is split.
    again = anchor_rows(src, True)
    found = cut(again.join(known, again["ctx"] == known["k"]).drop("k"), "anchors")
    drop(known)
    collect_garbage(spark)
    mixed = found.where("mixed")
    pick = lambda c: F.first(c).alias(c)
    bodies = cut(mixed.groupBy("ctx", "body").agg(F.count("*").alias("n"), *[pick(c) for c in ("doc", "a", "lo", "hi")]), "bodies")
    suffixes = cut(with_texts(src, bodies).dropDuplicates(["doc", "a", "lo", "hi"]), "suffixes")
    collect_garbage(spark)
    compared = cut(by_range(suffixes, "r", "l").mapInArrow(sorted_buckets, FIRST), "compared")
    drop(suffixes)
    further = compared.where("s IS NULL").select("reach", *suffixes.columns)
    collect_garbage(spark)
    crossed = cut(by_range(further, "l", "r").mapInArrow(border_buckets, SECOND), "again")
    border = crossed.where("weight IS NOT NULL")
    twice = cut(border.groupBy("ctx", "h1").agg(F.sum("weight").alias("w")).where("w > 1").select(F.col("ctx").alias("c"), F.col("h1").alias("h")), "borders")
    # Classes of several strings are known to repeat; the others ask whether another bucket has theirs.
    across = border.where("weight = 1").join(twice, (F.col("ctx") == F.col("c")) & (F.col("h1") == F.col("h"))).select("doc", "s", "e")
    inside = compared.where("s IS NOT NULL").select("doc", "s", "e").unionByName(crossed.where("weight IS NULL").select("doc", "s", "e"))
    single = inside.unionByName(across)
    whole = lambda df: df.select("doc", F.col("lo").alias("s"), (F.col("hi") + LENGTH).alias("e"))
    often = bodies.where("n > 1").select(F.col("ctx").alias("c"), F.col("body").alias("b"))
    copied = mixed.join(often, (F.col("ctx") == F.col("c")) & (F.col("body") == F.col("b")))
    every = single.unionByName(whole(found.where("NOT mixed"))).unionByName(whole(copied))
    runs = cut(every.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("runs")), "runs")
    drop(found, bodies, compared, crossed, twice)
    return runs


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, removed array<struct<s, e>>)"""
    src = keyed(docs, id_col, text_col)
    runs = spans(src)
    collect_garbage(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def rows(it):
        for batch in it:
            out = {n: [] for n in schema.names}
            for key, data, own in zip(batch["id"].to_pylist(), batch["data"].to_pylist(), batch["runs"].to_pylist()):
                gone, at, kept = merged(own or []), 0, []
                for s, e in gone:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                values = (key, len(data), sum(e - s for s, e in gone), len(gone), b"".join(kept), [{"s": s, "e": e} for s, e in gone])
                for column, v in zip(out.values(), values):
                    column.append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    both = src.join(runs.withColumnRenamed("doc", "k"), F.col("doc") == F.col("k"), "left").select("id", "data", "runs")
    return both.mapInArrow(rows, "id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<s:int,e:int>>").withColumnRenamed("id", id_col)


def result(docs: DataFrame) -> DataFrame:
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by a table of all strings: for tests."""
    from collections import Counter

    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = Counter(hash(b[k : k + length]) for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if seen[hash(b[k : k + length])] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes()
        out.append((len(b), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


#: Strings of LENGTH bytes as hex, every start of every text; those that start twice cover.
ORACLE = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (
    SELECT doc_id, h, (length(h) // 2)::BIGINT AS n_bytes, row_number() OVER () AS r FROM d
), starts AS (
    SELECT r, s, md5_number(substr(h, 2 * s + 1, 400)) AS k
    FROM (SELECT r, h, unnest(range(0, n_bytes - 199)) AS s FROM n WHERE n_bytes >= 200)
), twice AS (
    SELECT k FROM starts GROUP BY k HAVING count(*) > 1
), hit AS (
    SELECT r, s FROM starts SEMI JOIN twice USING (k)
), runs AS (
    SELECT r, s, sum((gap IS NULL OR gap > 200)::INT) OVER (PARTITION BY r ORDER BY s) AS g
    FROM (SELECT r, s, s - lag(s) OVER (PARTITION BY r ORDER BY s) AS gap FROM hit)
), spans AS (
    SELECT r, g, min(s) AS s, max(s) + 200 AS e FROM runs GROUP BY r, g
), kept AS (
    SELECT r, string_agg(part, '' ORDER BY place) AS h
    FROM (
        SELECT n.r, coalesce(p.e, 0) AS place, substr(n.h, 2 * coalesce(p.e, 0) + 1, 2 * (coalesce(p.nxt, n.n_bytes) - coalesce(p.e, 0))) AS part
        FROM n JOIN (
            SELECT r, e, lead(s) OVER (PARTITION BY r ORDER BY s) AS nxt FROM spans
            UNION ALL SELECT r, 0, min(s) FROM spans GROUP BY r
        ) p ON p.r = n.r
    ) GROUP BY r
), removed AS (
    SELECT r, sum(e - s)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY r
)
SELECT n.doc_id, n.n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""
