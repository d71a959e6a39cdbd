"""Ranked lexical search over a hierarchical max tree, by best-first branch and bound.

The documents are cut into ranges: a shard is a range of consecutive rows of an input partition,
a leaf a range of ``LEAF`` documents of it.  A shard is one row of the index table: its documents
and, for each term of the queries, the documents that hold it.  For each term the tree has the
highest part of a score that a document of a range can get from it, in leaves, in ranges of
``FAN`` leaves and so on up to the shard; the shards lie below the root of the whole table.

A search opens ranges by their summed bounds, the highest first.  Over the table: the bounds of
all shards give the shards to open first, their documents a least score that every item's
results must reach, and the last pass opens every shard whose bound reaches it.  Inside a shard a
heap holds the open ranges; it ends when the highest bound is below the least score of the
item's results so far.  Ranges whose bound equals it are opened, since equal scores go by id.

The items of a search are taken in blocks of bounded size, each against all documents.  What is
sent to the tasks is a block's items, its terms and one least score for each item.

Defined results: null and empty texts have no terms and are in no result, an item without terms
has none, equal scores go by ascending id (null first), repeated rows are documents of their own,
an empty table on either side gives no rows; columns other than the named ones are ignored.  Ids
of documents are integers or strings.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import cut, drop, give_back

#: Documents of a shard, postings of it, documents of a leaf, children of a range.
SHARD, POSTINGS, LEAF, FAN = 8192, 1 << 19, 64, 8
#: Shards that each item opens to find its least score, and bytes of the items of a block.
FIRST, BLOCK = 2, 8 << 20
#: Salts of the last ranking.
SALTS = 32

#: Bytes of a term stay, A-Z in lower case; all others are blanks.
TERM_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
INDEX = "docs array<{key}>, sizes array<long>, terms array<int>, starts array<int>, at array<int>, counts array<int>, some long, words long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


@dataclass
class Block:
    """Items and their distinct terms, numbered."""

    items: list[tuple[object, list[int]]]
    terms: dict[bytes, int]


def blocks_of(items: DataFrame, key: str, text: str):
    """Blocks of items, read one after the other; an item is whole in one block."""
    own, terms, size = [], {}, 0
    for item, body in items.select(key, text).toLocalIterator():
        found = list(dict.fromkeys(terms_of(body)))
        cost = 64 + sum(map(len, found)) + 8 * len(found)
        if own and size + cost > BLOCK:
            yield Block(own, terms)
            own, terms, size = [], {}, 0
        size += cost
        own.append((item, [terms.setdefault(t, len(terms)) for t in found]))
    if own:
        yield Block(own, terms)


def weight(total: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * holding + 1)))


def index(docs: DataFrame, block: Block, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each shard: documents with a term, their sizes, and the postings by term.

    ``at`` and ``counts`` have, for term number k, the places of its documents and how often they
    hold it, from starts[k] up to starts[k + 1]; ``some`` and ``words`` count documents and terms.
    Only terms of the block are kept; the counts are those of all terms.
    """
    kind = dict(docs.dtypes)[key]
    known = docs.sparkSession.sparkContext.broadcast(block.terms)
    arrow = pa.schema([("docs", pa.list_(ARROW[kind])), ("sizes", pa.list_(pa.int64())), *[(n, pa.list_(pa.int32())) for n in ("terms", "starts", "at", "counts")], ("some", pa.int64()), ("words", pa.int64())])

    def row(ids, sizes, found):
        at = np.repeat(np.arange(len(found)), [len(f) for f in found])
        term = np.fromiter((t for f in found for t in f), np.int64, len(at))
        count = np.fromiter((c for f in found for c in f.values()), np.int64, len(at))
        order = np.argsort(term, kind="stable")
        term, at, count = term[order], at[order], count[order]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        values = [[ids], [sizes], [term[starts].astype(np.int32)], [np.r_[starts, len(term)].astype(np.int32)], [at.astype(np.int32)], [count.astype(np.int32)], [len(ids)], [sum(sizes)]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches):
        number = known.value
        ids, sizes, found, held = [], [], [], 0
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(body.as_py())
                if not words:
                    continue
                own = Counter(map(number.__getitem__, filter(number.__contains__, words)))
                ids.append(doc)
                sizes.append(len(words))
                found.append(own)
                held += len(own)
                if len(ids) >= SHARD or held >= POSTINGS:
                    yield row(ids, sizes, found)
                    ids, sizes, found, held = [], [], [], 0
        if ids:
            yield row(ids, sizes, found)
        give_back()

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, INDEX.format(key=kind))


class Shard:
    """A shard with its tree: for each of its terms, the highest part in every range of a level."""

    def __init__(self, row: dict, weights: np.ndarray, total: int, words: int):
        self.docs, sizes = row["docs"], np.asarray(row["sizes"], np.int64)
        self.starts, self.at = np.asarray(row["starts"], np.int64), np.asarray(row["at"], np.int64)
        self.local = {t: k for k, t in enumerate(np.asarray(row["terms"]).tolist())}
        count = np.asarray(row["counts"], np.int64)
        size = 50 + (50 * sizes * total) // words
        term = np.repeat(np.arange(len(self.local)), np.diff(self.starts))
        self.part = weights[np.asarray(row["terms"], np.int64)][term] * ((1_000_000_000 * count) // (1000 * count + 20 * size[self.at]))
        leaves = -(-len(sizes) // LEAF)
        lowest = np.zeros((len(self.local), leaves), np.int64)
        if len(self.at):
            cell = term * leaves + self.at // LEAF
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            lowest.reshape(-1)[cell[first]] = np.maximum.reduceat(self.part, first)
        self.levels = [lowest]
        while self.levels[-1].shape[1] > 1:
            last = self.levels[-1]
            wide = np.zeros((last.shape[0], -(-last.shape[1] // FAN) * FAN), np.int64)
            wide[:, : last.shape[1]] = last
            self.levels.append(wide.reshape(last.shape[0], -1, FAN).max(axis=2))

    def terms(self, item: list[int]) -> np.ndarray:
        return np.array([self.local[t] for t in item if t in self.local], np.int64)

    def bound(self, item: list[int]) -> int:
        own = self.terms(item)
        return int(self.levels[-1][own, 0].sum()) if len(own) else 0

    def leaf(self, own: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, place) of the leaf's documents with a score."""
        scores = np.zeros(LEAF, np.int64)
        for t in own.tolist():
            if self.levels[0][t, k]:
                a, b = self.starts[t], self.starts[t + 1]
                lo, hi = a + np.searchsorted(self.at[a:b], (k * LEAF, (k + 1) * LEAF))
                scores[self.at[lo:hi] - k * LEAF] += self.part[lo:hi]
        return [(int(scores[i]), k * LEAF + i) for i in np.flatnonzero(scores).tolist()]

    def search(self, item: list[int], most: int, least: int) -> list[tuple[int, object]]:
        """(score, id) of the shard's ``most`` best documents with at least ``least``."""
        own = self.terms(item)
        top = len(self.levels) - 1
        if not len(own):
            return []
        heap, best, found = [(-int(self.levels[top][own, 0].sum()), top, 0)], [], []
        while heap:
            bound, level, k = heapq.heappop(heap)
            if -bound < max(least, 1):
                break
            if level:
                below = self.levels[level - 1]
                a, b = k * FAN, min((k + 1) * FAN, below.shape[1])
                for child, value in enumerate(below[own, a:b].sum(axis=0).tolist(), a):
                    if value >= max(least, 1):
                        heapq.heappush(heap, (-value, level - 1, child))
                continue
            for score, place in self.leaf(own, k):
                if score >= least:
                    found.append((score, place))
                    heapq.heappush(best, score)
                    if len(best) > most:
                        heapq.heappop(best)
            if len(best) == most:
                least = max(least, best[0])
        # Ties at the least score may be many: the first ids of them.
        named = [(score, self.docs[place].as_py()) for score, place in found if score >= least]
        return sorted(named, key=lambda x: (-x[0], x[1] is not None, x[1]) if x[1] is not None else (-x[0], False))[:most]


def counted(table: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """(documents with a term, their terms, documents that hold each term of the block)."""
    total = table.agg(F.sum("some"), F.sum("words")).first()
    held = table.select(F.posexplode("terms").alias("k", "term"), "starts").select("term", (F.get("starts", F.col("k") + 1) - F.get("starts", F.col("k"))).cast("long").alias("n"))
    out = np.zeros(len(block.terms), np.int64)
    for term, n in held.groupBy("term").agg(F.sum("n")).toLocalIterator():
        out[term] = n
    return total[0] or 0, total[1] or 0, out


def over_shards(table: DataFrame, shared, columns: dict[str, str], work) -> DataFrame:
    """Rows of these columns that ``work(shard, items, shard's number)`` gives as tuples."""
    arrow = pa.schema([(n, ARROW[t]) for n, t in columns.items()])

    def run(batches):
        items, weights, total, words = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                arrays = {n: row[n].values.to_numpy(zero_copy_only=False) for n in ("sizes", "terms", "starts", "at", "counts")}
                shard = Shard(arrays | {"docs": row["docs"].values}, weights, total, words)
                rows = work(shard, items, row["number"].as_py())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)
        give_back()

    return table.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in columns.items()))


def search_block(docs: DataFrame, block: Block, most: int, key: str, text: str) -> DataFrame:
    """(item, doc, score) with the ``most`` best documents of each item of the block, and others."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    table = cut(index(docs, block, key, text).withColumn("number", F.monotonically_increasing_id()), "ranked-index")
    total, words, held = counted(table, block)
    weights = np.array([weight(total, int(n)) if n else 0 for n in held], np.int64)
    items = [terms for _, terms in block.items]
    shared = spark.sparkContext.broadcast((items, weights, total, max(words, 1)))

    def bounds(shard, items, number):
        found = ((k, shard.bound(terms)) for k, terms in enumerate(items))
        return [(k, number, b) for k, b in found if b]

    upper = cut(over_shards(table, shared, {"item": "int", "number": "bigint", "bound": "bigint"}, bounds), "ranked-bounds")
    salted = W.partitionBy("item", F.pmod("number", F.lit(SALTS))).orderBy(F.desc("bound"), "number")
    best = upper.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= FIRST)
    best = best.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "number"))).where(F.col("r") <= FIRST)
    opened: dict[int, list[int]] = {}
    for r in best.select("item", "number").toLocalIterator():  # at most FIRST for each item of the block
        opened.setdefault(r["number"], []).append(r["item"])
    first = spark.sparkContext.broadcast(opened)

    def probe(shard, items, number):
        return [(k, s) for k in first.value.get(number, ()) for s, _ in shard.search(items[k], most, 1)]

    chosen = table.join(F.broadcast(spark.createDataFrame([(n,) for n in opened], "number long")), "number", "left_semi").select(*table.columns)
    ranks = W.partitionBy("item").orderBy(F.desc("score"))
    least = over_shards(chosen, shared, {"item": "int", "score": "bigint"}, probe).withColumn("r", F.row_number().over(ranks)).where(F.col("r") == most)
    floor = spark.sparkContext.broadcast({r["item"]: r["score"] for r in least.toLocalIterator()})

    def final(shard, items, number):
        return [(k, d, s) for k, terms in enumerate(items) for s, d in shard.search(terms, most, floor.value.get(k, 1))]

    out = cut(over_shards(table, shared, {"item": "int", "doc": kind, "score": "bigint"}, final), "ranked-found")
    drop(table, upper)
    return out


def search(docs: DataFrame, items: DataFrame, most: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): the ``most`` best documents with a score above 0 for each item."""
    spark: SparkSession = docs.sparkSession
    kinds = dict(items.dtypes)[item], dict(docs.dtypes)[key]
    found = []
    for block in blocks_of(items, item, item_text):
        rows = search_block(docs, block, most, key, text)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block.items)], f"item int, name {kinds[0]}")
        found.append(rows.join(F.broadcast(names), "item").select("item", "name", "doc", "score", F.lit(len(found)).alias("block")))
    if not found:
        return spark.createDataFrame([], f"`{item}` {kinds[0]}, rank int, `{key}` {kinds[1]}, score long")
    rows = reduce(DataFrame.unionByName, found)
    order = (F.desc("score"), F.asc("doc"))
    salted = W.partitionBy("block", "item", F.pmod(F.hash("doc"), F.lit(SALTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("block", "item").orderBy(*order))).where(F.col("rank") <= most)
    return rows.select(F.col("name").alias(item), "rank", F.col("doc").alias(key), "score")


def result(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


ORACLE = r"""
WITH asked AS (
    SELECT item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms, row_number() OVER () AS item FROM benchmark
), wanted AS (SELECT item, item_id, unnest(terms) AS term FROM asked),
held AS (
    SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sized AS (SELECT doc, doc_id, len(terms)::BIGINT AS n, terms FROM held WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS words FROM sized),
postings AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, whole GROUP BY term, total),
parts AS (
    SELECT p.doc, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total) // words))) AS part
    FROM postings p JOIN weights USING (term) JOIN sized USING (doc), whole
), scored AS (SELECT item, item_id, doc, sum(part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM scored JOIN sized USING (doc)
) WHERE rank <= 50
"""
