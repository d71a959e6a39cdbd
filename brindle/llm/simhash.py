"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 majority bits over the XXH64 of word shingles.  Distinct fingerprints meet
in buckets: the 64 bits fall into six blocks, and of two fingerprints that differ in at most
three bits, three blocks agree, so that each of the 20 choices of three blocks (about 32 bits)
is a table of buckets and none is missed.  In a bucket the members' bit planes stand
vertically, 64 members to a word; for a query all distances to a block of 64 are updated at
once, plane by plane, by carry-save counters, and a (query, block) pair is given up once every
member exceeds the radius.  Buckets of more than ``MOST`` fingerprints are dealt again by
choices among their remaining bits, which loses no pair and ends, as bits run out.  Links go
into connected components by rounds of hooking and pointer jumping over tables.

Defined results: a null, empty or blank text has fingerprint zero and links like any other;
fewer words than a shingle make one shingle of all; repeated rows and equal texts share a
fingerprint and thus a component; a component's id is its smallest id, null only if it has
none; an empty table gives an empty table; other columns are ignored by ``components`` and
kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches, cut, drop, fresh, utf8

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bit ranges (first, length) of the blocks of a fingerprint, and how many must agree.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
AGREE = len(BLOCKS) - RADIUS
#: A bucket with more members is dealt again by further bits.
MOST = 1024
#: A (query, block) pair is tested for having been exceeded after so many planes.
STRIDE = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = utf8(text).lower().split()  # of bytes: A-Z only, and ASCII blanks only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit integer."""

    def rows(it):
        schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
        fn = lambda c: {"id": c["id"], "fp": np.array([fingerprint(t, shingle) for t in c["text"]], np.uint64).view(np.int64)}
        return batches(it, fn, schema)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(rows, "id long, fp long")


def bits_at(col: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(col, first).bitwiseAND(F.lit((1 << n) - 1))


def even(width: int) -> list[tuple[int, int]]:
    """``width`` bits in as many blocks as BLOCKS has."""
    n = len(BLOCKS)
    sizes = [width // n + (k < width % n) for k in range(n)]
    return [(sum(sizes[:k]), size) for k, size in enumerate(sizes)]


def joined(blocks, start: Column) -> Column:
    for first, n in blocks:
        start = F.shiftleft(start, n).bitwiseOR(bits_at(F.col("rest"), first, n))
    return start


def dealt(blocks) -> Column:
    """For each choice of AGREE blocks of ``rest``: (key, what remains of ``rest``)."""
    tables = []
    for k, chosen in enumerate(combinations(blocks, AGREE)):
        left = [b for b in blocks if b not in chosen]
        key = F.shiftleft(joined(chosen, F.lit(0).cast("long")), 5).bitwiseOR(F.lit(k))
        tables.append(F.struct(key.alias("key"), joined(left, F.lit(0).cast("long")).alias("rest")))
    return F.array(*tables)


def buckets(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(members array<long>): sets of 2 to ``most`` fingerprints that hold every close pair.

    ``most`` is 64 at least: after four rounds so few bits are left that no bucket has more.
    """
    if most < 64:
        raise ValueError("most must be at least 64")
    rows, blocks, out = fps.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("path")), BLOCKS, None
    while True:
        keyed = rows.select("fp", "path", F.explode(dealt(blocks)).alias("t")).select("fp", "path", "t.*")
        sizes = keyed.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        sizes = cut(sizes.where("n > 1"), "buckets")
        again = keyed.join(sizes.where("n > 2").select("path", "key", "n"), ["path", "key"])
        lists = again.where(F.col("n") <= most).groupBy("path", "key").agg(F.collect_list("fp").alias("members"))
        both = sizes.where("n = 2").select(F.array("a", "b").alias("members")).unionByName(lists.select("members"))
        out = both if out is None else out.unionByName(both)
        if sizes.where(F.col("n") > most).isEmpty():
            return out
        rows = cut(again.where(F.col("n") > most).select("fp", "rest", F.xxhash64("path", "key").alias("path")), "large")
        blocks = even(max(sum(n for _, n in left) for left in combinations(blocks, len(blocks) - AGREE)))


def planes_of(prints: np.ndarray, lane_of: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(bit planes of each block of 64 lanes, lanes in use) for ``prints`` of one or more words."""
    words = prints.shape[1]
    lanes = np.zeros((n_blocks * 64, words), np.uint64)
    lanes[lane_of] = prints
    in_use = np.zeros(n_blocks * 64, np.uint8)
    in_use[lane_of] = 1
    used = np.packbits(in_use.reshape(n_blocks, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
    cube = np.unpackbits(lanes.view(np.uint8).reshape(n_blocks, 64, 8 * words), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(cube.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")
    return planes.reshape(n_blocks, 64 * words), used


def close_lanes(planes: np.ndarray, used: np.ndarray, block: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, lane) where query ``prints[k]`` is within ``radius`` of that lane of ``block[k]``.

    The counters of 64 distances stand bit-sliced.  They start so high that exceeding the
    radius is an overflow, two planes at a time go through a carry-save adder, and what
    overflows stays marked.
    """
    size = max(2, radius.bit_length())
    start = (1 << size) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(len(block))
    counters = [np.full(len(block), full if start >> k & 1 else np.uint64(0)) for k in range(size)]
    over, queries = ~used[block], prints
    for bit in range(0, planes.shape[1], 2):
        word = queries[:, bit >> 6]
        at = bit & 63
        x, y = (planes[block, bit + k] ^ (np.uint64(0) - ((word >> np.uint64(at + k)) & np.uint64(1))) for k in (0, 1))
        half = counters[0] ^ x
        carry = (counters[0] & x) | (half & y)
        counters[0] = half ^ y
        for k in range(1, size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if bit % STRIDE == STRIDE - 2:
            keep = over != full
            if not keep.all():
                live, block, over, queries = live[keep], block[keep], over[keep], queries[keep]
                counters = [c[keep] for c in counters]
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, lane = np.nonzero(near)
    return live[k], lane


def close_pairs(members: list[np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as flat positions) within ``radius`` in each of the lists, compared bit-sliced.

    A list is an array of fingerprints, or of rows of several 64-bit words each.
    """
    sizes = np.array([len(m) for m in members])
    flat = np.concatenate(members).view(np.uint64)
    flat = flat.reshape(len(flat), -1)
    starts = np.cumsum(sizes) - sizes
    blocks_of = -(-sizes // 64)
    first_block = np.cumsum(blocks_of) - blocks_of
    n_blocks = int(blocks_of.sum())
    # Lanes: member k of a list is lane k % 64 of its block k // 64.
    own = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(flat)) - starts[own]
    lane_of = (first_block[own] + within // 64) * 64 + within % 64
    at_lane = np.full(n_blocks * 64, -1)
    at_lane[lane_of] = np.arange(len(flat))
    planes, used = planes_of(flat, lane_of, n_blocks)
    # Each member is a query against the blocks of its list from its own block on.
    todo = blocks_of[own] - within // 64
    query = np.repeat(np.arange(len(flat)), todo)
    block = np.arange(len(query)) - np.repeat(np.cumsum(todo) - todo, todo) + np.repeat(first_block[own] + within // 64, todo)
    k, lane = close_lanes(planes, used, block, flat[query], radius)
    a, b = query[k], at_lane[block[k] * 64 + lane]
    return a[a < b], b[a < b]


def links(found: DataFrame) -> DataFrame:
    """(node, root): a spanning forest, for each task, of the links in its buckets."""

    def rows(it):
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

        def flush():
            nodes = [x for x in parent if root(x) != x]
            yield pa.RecordBatch.from_pydict({"node": nodes, "root": [root(x) for x in nodes]}, schema=schema)
            parent.clear()

        for batch in it:
            for at in range(0, batch.num_rows, 2048):
                lists = [np.array(m, np.int64) for m in batch.column(0).slice(at, 2048).to_pylist()]
                flat = np.concatenate(lists)
                for a, b in zip(*close_pairs(lists)):
                    x, y = root(int(flat[a])), root(int(flat[b]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                if len(parent) > 500_000:
                    yield from flush()
        yield from flush()

    return found.mapInArrow(rows, "node long, root long")


def connect(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes with a link.

    A round hooks every node to its least neighbour, jumps pointers until all point at roots,
    and relabels the links; the number of roots at least halves.  Tables are written after
    each step, so a lost executor costs one step.
    """
    edges, labels = cut(edges.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u != v").distinct(), "links"), None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        while True:
            up = parent.select(F.col("u").alias("q"), F.col("p").alias("pp"))
            jumped = cut(parent.join(up, parent["p"] == up["q"], "left").select("u", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "parents")
            drop(parent)
            parent = jumped
            if jumped.where("moved").isEmpty():
                break
        left, right = parent.select(F.col("u").alias("a"), F.col("p").alias("x")), parent.select(F.col("u").alias("b"), F.col("p").alias("y"))
        old = edges
        edges = cut(edges.join(left, edges["u"] == left["a"]).join(right, F.col("v") == F.col("b")).where("x != y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "links")
        drop(old)
        if labels is None:
            labels = parent
        else:
            up, known = parent.select(F.col("u").alias("q"), F.col("p").alias("pp")), labels
            labels = cut(labels.join(up, labels["p"] == up["q"], "left").select("u", F.coalesce("pp", "p").alias("p")), "labels")
            drop(known, parent)
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels.select(F.col("u").alias("node"), F.col("p").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, root, component_id): root is the least fingerprint of the component."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    labels = connect(links(buckets(distinct)))
    linked = cut(labels.join(distinct, labels["node"] == distinct["fp"]).select("node", "root", "least"), "linked")
    # Written first, so that a root with most nodes can be split in the join.
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = linked.join(least, "root").select("node", "root", "component_id")
    every = distinct.join(named, distinct["fp"] == named["node"], "left")
    every = cut(every.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "components")
    drop(distinct, linked, least)
    out = prints.join(every, "fp").select(F.col("id").alias(id_col), "fp", "root", "component_id")
    out.cut_needs = (prints, every)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, the one with the component's id, with all its columns."""
    signed = lambda t: int(np.uint64(fingerprint(t, shingle)).view(np.int64))
    return keep_first(docs, components(docs, id_col, text_col, shingle), signed, id_col, text_col)


def keep_first(docs: DataFrame, classes: DataFrame, print_of, id_col: str, text_col: str) -> DataFrame:
    """``keep_one`` for given (id, fp, root, component_id), where ``print_of`` gives a text's fp."""
    key, own, best_of, top = fresh(docs, "_id", "_fp", "_best", "_root")
    found = cut(classes.withColumnRenamed(id_col, key), "classes")
    drop(*getattr(classes, "cut_needs", ()))
    per_id = found.groupBy(key).agg(F.count("*").alias("n"), F.max(F.col(key) != F.col("component_id")).alias("out"))
    per_id = cut(per_id.where(f"n > 1 OR out OR {key} IS NULL").select(key, "n"), "out")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key))
    # How many ids go grows with the data, so they are not broadcast.
    single = docs.join(per_id.select(key).hint("merge"), same, "left_anti")
    many = per_id.where(f"n > 1 OR {key} IS NULL")
    if many.isEmpty():
        return single
    # Ids that several rows share (and null): told apart by fingerprint.
    @F.pandas_udf("long")
    def fp_of(texts):
        return texts.map(print_of).astype("int64")

    shared = docs.join(many.select(key), same, "left_semi").withColumn(own, fp_of(F.col(text_col)))
    best = found.groupBy(F.col("root").alias(top)).agg(F.min(F.struct(F.col(key).isNull().alias("no"), F.col(key), F.col("fp"))).alias("b"))
    best = best.select(top, F.col(f"b.{key}").alias(key), F.col("b.fp").alias(best_of))
    kept = shared.join(best, same & (F.col(own) == F.col(best_of)), "left_semi")
    return single.unionByName(kept.dropDuplicates([id_col, own]).select(*docs.columns))


def result(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id)"""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
