"""SimHash near-duplicates at a similarity of word shingles: the pipeline's stage.

Two texts link if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
At that similarity fingerprints differ in about 15 % of their bits, so 64 bits cannot tell and
blocks of bits cannot find the pairs; fingerprints here have 512 bits, and texts meet in
buckets of equal minimum hashes (32 bands of four: a pair at 0.8 shares none with a chance of
5e-8, and less above).  In a bucket fingerprints are compared bit-sliced, at a radius four
and a half standard deviations above 0.8, and what is left is decided on the words.

1. Every member of a bucket is compared with the bucket's least one: one pair a member.
2. Buckets whose members are then in several components compare the members outside the
   largest component with all others, in parts of bounded size.  A pair is looked at in the
   first of its common bands only, decided on the spot, and only if no earlier pair of the
   part has joined its components; a part gives at most as many links as it has components.

Both go by joins and bounded lists, so a bucket may hold any share of the rows.  Texts travel
compressed, those of bucket members alone, and never by broadcast: how many there are grows
with the data.

Defined results: words are as in op9 (A-Z lowered, ASCII blanks); fewer words than a shingle
make one shingle of all; texts without words are copies of each other; a component's id is its
smallest id, null only if it has none; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .common import batches, cut, drop, utf8

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4
#: 64-bit words of a fingerprint, the radius, and the radius of texts with under FEW shingles.
WORDS, RADIUS, FEW, FEW_RADIUS = 8, 114, 16, 140
#: Members of one part of a bucket, and bytes of their texts, about.
PART, PART_BYTES = 512, 4 << 20
_random = np.random.default_rng(9)
FLIP = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
FACTOR = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | bytes | None) -> set[bytes]:
    words = (text if isinstance(text, bytes) else utf8(text)).lower().split()
    if len(words) < SHINGLE:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))


def unpacked(packed: bytes) -> set[bytes]:
    from zstandard import ZstdDecompressor

    return shingles(ZstdDecompressor().decompress(packed))


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def print_of(text: str | None) -> int:
    """A signed 64-bit key of the words of a text in order."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(utf8(text).lower().split()))).view(np.int64))


def sketch(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket key of each band, fingerprint words, number of shingles)"""
    import xxhash

    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g) for g in shingles(text)], np.uint64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(h), 1024):
        part = h[at : at + 1024, None]
        np.minimum(least, ((part ^ FLIP) * FACTOR).min(axis=0), out=least)
        wide = (part ^ FLIP[:WORDS]) * FACTOR[WORDS : 2 * WORDS]
        wide = (wide ^ (wide >> np.uint64(29))) * MIX
        counts += np.unpackbits((wide ^ (wide >> np.uint64(32))).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    keys = np.array([digest(bytes([k]) + band.tobytes()) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    return keys.view(np.int64), np.packbits(2 * counts > len(h), bitorder="little").view("<u8").view(np.int64), len(h)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, packed, keys, sim, n) of each row; packed is the text, compressed."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("packed", pa.binary()), ("keys", pa.list_(pa.int64())), ("sim", pa.binary()), ("n", pa.int32())])

    def fn(c):
        from zstandard import ZstdCompressor

        found, pack = [sketch(t) for t in c["text"]], ZstdCompressor(level=3).compress
        return {"id": c["id"], "fp": [print_of(t) for t in c["text"]], "packed": [pack(utf8(t)) for t in c["text"]], "keys": [k for k, _, _ in found], "sim": [s.tobytes() for _, s, _ in found], "n": [n for _, _, n in found]}

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lambda it: batches(it, fn, schema), "id long, fp long, packed binary, keys array<long>, sim binary, n int")


def words_of(sims) -> np.ndarray:
    return np.frombuffer(b"".join(sims), "<u8").reshape(-1, WORDS)


def close(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which rows of fingerprints are near enough, given the lesser number of shingles."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= np.where(n < FEW, FEW_RADIUS, RADIUS)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def against_first(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints are near: each ``a`` is a query against blocks of its b."""

    def rows(it):
        for batch in it:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            x, y = words_of(batch["x"].to_pylist()), words_of(batch["y"].to_pylist())
            order = np.argsort(a, kind="stable")
            first = np.append(True, a[order][1:] != a[order][:-1])
            group = np.cumsum(first) - 1
            within = np.arange(len(a)) - np.flatnonzero(first)[group]
            new = first | (within % 64 == 0)
            block = np.cumsum(new) - 1
            lane_of = block * 64 + within % 64
            planes, used = simhash.planes_of(y[order], lane_of, int(block[-1]) + 1)
            k, lane = simhash.close_lanes(planes, used, np.arange(len(used)), x[order][new], FEW_RADIUS)
            at = np.zeros(len(used) * 64, np.int64)
            at[lane_of] = order
            hit = at[k * 64 + lane]
            hit = hit[close(x[hit], y[hit], batch["n"].to_numpy()[hit])]
            yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit])], schema=PAIRS)

    return pairs.select("a", "b", "x", "y", "n").where("a IS NOT NULL").mapInArrow(rows, "a long, b long")


def across(lists: DataFrame) -> DataFrame:
    """Links of each list (band, members array<struct<fp, sim, keys, n, packed, label, side>>) that join
    its components, where one member at least is outside of the largest one (side 1)."""

    def rows(it):
        for batch in it:
            for at in range(batch.num_rows):
                band, own = batch.column(0)[at].as_py(), pa.array(batch.column(1).slice(at, 1)).flatten()
                fps, labels, sides, n = (own.field(c).to_numpy() for c in ("fp", "label", "side", "n"))
                sims, texts = words_of(own.field("sim").to_pylist()), own.field("packed")
                keys = own.field("keys").flatten().to_numpy().reshape(-1, BANDS)
                planes, used = simhash.planes_of(sims, np.arange(len(fps)), -(-len(fps) // 64))
                up, sets, found = {int(x): int(x) for x in labels}, {}, []

                def root(x):
                    while up[x] != x:
                        up[x] = x = up[up[x]]
                    return x

                def words(k):
                    if k not in sets:
                        sets[k] = unpacked(texts[k].as_py())
                    return sets[k]

                asked = np.flatnonzero(sides == 1)  # the largest component's members are queried only by the others
                for first in range(0, len(asked), 64):
                    some = asked[first : first + 64]
                    query, block = np.repeat(some, len(used)), np.tile(np.arange(len(used)), len(some))
                    k, lane = simhash.close_lanes(planes, used, block, sims[query], FEW_RADIUS)
                    a, b = query[k], block[k] * 64 + lane
                    keep = (labels[a] != labels[b]) & ((sides[b] == 0) | (a < b))
                    a, b = a[keep], b[keep]
                    keep = close(sims[a], sims[b], np.minimum(n[a], n[b])) & ((keys[a] == keys[b]).argmax(axis=1) == band)
                    a, b = a[keep], b[keep]
                    nearest = np.argsort(np.bitwise_count(sims[a] ^ sims[b]).sum(axis=1, dtype=np.int64), kind="stable")
                    for i, j in zip(a[nearest].tolist(), b[nearest].tolist()):
                        x, y = root(int(labels[i])), root(int(labels[j]))
                        if x != y and jaccard(words(i), words(j)) >= SIMILAR:
                            up[x] = y
                            found.append((int(fps[i]), int(fps[j])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=PAIRS)

    return lists.select("band", "members").mapInArrow(rows, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingles are similar, decided on the texts (fp, packed)."""
    last: list = [None, None]

    def similar(a, x, y):
        if last[0] != a:
            last[:] = a, unpacked(x)
        return jaccard(last[1], unpacked(y)) >= SIMILAR

    def fn(c):
        hit = [similar(*row) for row in zip(c["a"], c["x"], c["y"])]
        return {n: [v for v, h in zip(c[n], hit) if h] for n in ("a", "b")}

    x, y = texts.select(F.col("fp").alias("p"), F.col("packed").alias("x")), texts.select(F.col("fp").alias("q"), F.col("packed").alias("y"))
    both = pairs.join(y.hint("merge"), F.col("b") == F.col("q")).join(x.hint("merge"), F.col("a") == F.col("p")).select("a", "b", "x", "y")
    return cut(both.mapInArrow(lambda it: batches(it, fn, PAIRS), "a long, b long"), "similar")


def share(n, size):
    """The number of parts for ``n`` members with ``size`` shingles in all, of some eight bytes each."""
    return F.greatest(F.ceil(n / F.lit(PART)), F.ceil(size * 8 / F.lit(PART_BYTES)), F.lit(1)).cast("int")


def parts(labelled: DataFrame) -> DataFrame:
    """(bucket, part, band, side, fp, label): members outside of a bucket's largest component
    (side 1) meet every other member in some part; parts have about 2 * PART members."""
    by = labelled.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    by = by.groupBy("bucket").agg(F.max(F.struct("c", "label", "w")).alias("top"), F.sum("c").alias("all"), F.sum("w").alias("words"), F.count("*").alias("labels")).where("labels > 1")
    by = by.select(F.col("bucket").alias("k"), F.col("top.label").alias("main"), share(F.col("top.c"), F.col("top.w")).alias("ga"), share(F.col("all") - F.col("top.c"), F.col("words") - F.col("top.w")).alias("gb"))
    by = cut(by, "mixed")
    rows = labelled.join(by, F.col("bucket") == F.col("k")).withColumn("side", (F.col("label") != F.col("main")).cast("int"))
    own = lambda g: F.pmod(F.xxhash64("fp"), F.col(g)).cast("int")
    upto = lambda g: F.sequence(F.lit(0), F.col(g) - 1)
    main = F.transform(upto("gb"), lambda j: F.concat_ws(":", F.lit("m"), own("ga"), j))
    with_main = F.transform(upto("ga"), lambda j: F.concat_ws(":", F.lit("m"), j, own("gb")))
    with_rest = F.transform(upto("gb"), lambda j: F.concat_ws(":", F.lit("r"), F.least(j, own("gb")), F.greatest(j, own("gb"))))
    rows = rows.withColumn("part", F.explode(F.when(F.col("side") == 0, main).otherwise(F.concat(with_main, with_rest))))
    return rows.select("bucket", "part", "band", "side", "fp", "label")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, root, component_id): root is the least key of the component."""
    prints = cut(sketches(docs, id_col, text_col), "prints")
    one = cut(prints.select("fp", "keys", "sim", "n").dropDuplicates(["fp"]), "one")
    keyed = one.select("fp", "n", F.posexplode("keys").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("c"), F.min("fp").alias("least"), F.max("fp").alias("most"), F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("total")).where("c > 1")
    # Bands with the same members need one look, in the first of them.
    sizes = sizes.groupBy("c", "least", "most", "total").agg(F.min(F.struct("band", "key")).alias("first"))
    sizes = cut(sizes.select(F.col("first.key").alias("bucket"), F.col("first.band").alias("at"), "least"), "buckets")
    members = cut(keyed.join(sizes, (F.col("key") == F.col("bucket")) & (F.col("band") == F.col("at"))).select("bucket", "band", "least", "fp", "n"), "members")
    first = cut(members.where("fp != least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct(), "first")
    x = one.select(F.col("fp").alias("p"), F.col("sim").alias("x"), F.col("n").alias("nx"))
    y = one.select(F.col("fp").alias("q"), F.col("sim").alias("y"), F.col("n").alias("ny"))
    near = first.join(y, F.col("b") == F.col("q")).join(x, F.col("a") == F.col("p")).withColumn("n", F.least("nx", "ny"))
    near = cut(against_first(near), "near")
    nodes = members.select(F.col("fp").alias("node")).distinct()
    texts = cut(prints.join(nodes.hint("merge"), F.col("fp") == F.col("node"), "left_semi").select("fp", "packed").dropDuplicates(["fp"]), "texts")
    links = verified(near, texts)
    labels = simhash.connect(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
    named = members.join(labels, F.col("fp") == labels["node"], "left").select("bucket", "band", "fp", "n", F.coalesce("root", "fp").alias("label"))
    named = cut(named, "named")
    met = cut(parts(named), "parts")
    drop(sizes, members, first, near, named)
    known = texts.select(F.col("fp").alias("q"), "packed").hint("merge")
    packed = one.select(F.col("fp").alias("p"), "sim", "keys", "n")
    met = met.join(packed, F.col("fp") == F.col("p")).join(known, F.col("fp") == F.col("q"))
    lists = met.groupBy("bucket", "part", "band").agg(F.collect_list(F.struct("fp", "sim", "keys", "n", "packed", "label", "side")).alias("members"))
    rest = cut(across(lists), "rest")
    if not rest.isEmpty():
        links = links.unionByName(rest)
        labels = simhash.connect(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
    ids = prints.select("id", "fp").join(labels, F.col("fp") == F.col("node"), "left").select("id", "fp", F.coalesce("root", "fp").alias("root"))
    ids = cut(ids, "ids")
    drop(prints, one, texts)
    least = cut(ids.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    out = ids.join(least, "root").select(F.col("id").alias(id_col), "fp", "root", "component_id")
    out.cut_needs = (ids, least)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the component's id, with all its columns."""
    return simhash.keep_first(docs, components(docs, id_col, text_col), print_of, id_col, text_col)
