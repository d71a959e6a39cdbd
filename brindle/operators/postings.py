"""Inverted lists for the two text searches: terms of note sections, trigrams of transcript nodes.

Both are tables split by a hash of the term, so a search lists and reads the folders of its own
terms only.  The lists decide as much as they can; texts are read for the rows that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from . import kb, transcript

#: Folders of an index.
BUCKETS = 64
#: Where a term stands: heading, path, body; and how many hashes of paths there are.
KINDS, FILES = ("h", "a", "b"), 1 << 11
#: Bytes of nodes whose lists are made together.
BLOCK = 16 << 20


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def buckets_of(spark: SparkSession, terms: list[str], buckets: int) -> list[int]:
    """The folders of these terms; the hash is Spark's, so Spark computes it."""
    if not terms:
        return []
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t"))
    return sorted({r["b"] for r in rows.select(bucket(F.col("t"), buckets).alias("b")).collect()})


def lists(table: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of some terms: a filter on the folders, and one that the files' statistics see."""
    own = buckets_of(table.sparkSession, terms, buckets)
    return table.where(F.col("bucket").isin(own)).where(F.col("term").isin(terms))


def write(rows: DataFrame, path: str) -> None:
    """Sorted by term within a folder; a large folder goes to several files."""
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with the number that lists name them by; to be written, since it is new each time."""
    return nodes.withColumn("node", F.monotonically_increasing_id())


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, nodes, facts) of blocks of (node, facts, h, a, b): one row for each term of a block."""
    for batch in batches:
        step = max(1, BLOCK * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            lists = [pc.split_pattern(pc.fill_null(part[k], ""), " ") for k in KINDS]
            words = pa.concat_arrays([x.flatten() for x in lists])
            place = np.concatenate([np.repeat(np.arange(part.num_rows) * len(KINDS) + k, pc.list_value_length(x)) for k, x in enumerate(lists)])
            some = pc.not_equal(words, "")
            words, place = words.filter(some).dictionary_encode(), place[some.to_numpy(zero_copy_only=False)]
            if not len(place):
                continue
            # One number for each term of a field of a node, by term and then by node; how often it occurs.
            found, n = np.unique(words.indices.to_numpy() * np.int64(part.num_rows * len(KINDS)) + place, return_counts=True)
            code, place = np.divmod(found, part.num_rows * len(KINDS))
            node, kind = np.divmod(place, len(KINDS))
            sizes = np.bincount(pc.list_parent_indices(lists[-1]).to_numpy()[pc.not_equal(lists[-1].flatten(), "").to_numpy(zero_copy_only=False)], minlength=part.num_rows)
            divisor = np.maximum(1, np.sqrt(sizes).astype(np.int64))
            facts = (divisor * (FILES * 2 * 16) + part["facts"].to_numpy())[node] + kind * 4 + np.minimum(n, T.TERM_CAP)
            starts = pa.array(np.searchsorted(code, np.arange(len(words.dictionary) + 1)), pa.int32())
            columns = [words.dictionary, pa.ListArray.from_arrays(starts, part["node"].take(pa.array(node))), pa.ListArray.from_arrays(starts, pa.array(facts.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "nodes", "facts"])


def of_notes(nodes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, term, nodes, facts): where a term stands, see ``unpacked``.

    A task counts the terms of a block of nodes together, so that what is dealt out is one row for
    each term of a block, with its nodes in one list and their facts in another.
    Facts fit in 31 bits: a divisor has 15, since a text has less than 2**30 tokens.
    """
    live = F.when(T.is_archive(F.col("path")), 0).otherwise(1)
    facts = (F.pmod(F.xxhash64("path"), F.lit(FILES)) * 2 + live) * 16
    rows = nodes.select("node", facts.cast("long").alias("facts"), T.spaced("heading_path").alias("h"), T.spaced("path").alias("a"), T.spaced("normalized_body").alias("b"))
    rows = rows.mapInArrow(listed, "term string, nodes array<long>, facts array<int>")
    return rows.select(bucket(F.col("term"), buckets).alias("bucket"), "term", "nodes", "facts")


def unpacked(table: DataFrame) -> DataFrame:
    """(term, node, kind, n, divisor, live, file) of lists.

    ``kind`` is heading (h), path (a) or body (b), ``n`` is capped as the score caps it,
    ``divisor`` is that of the section's body, ``live`` is false in archives, ``file`` a short hash
    of the path.
    """
    part = lambda shift, mask: F.shiftright("facts", shift).bitwiseAND(F.lit(mask))
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), part(2, 3).cast("int"))
    rows = table.select("term", F.inline(F.arrays_zip("nodes", "facts")).alias("node", "facts"))
    return rows.select("term", "node", kind.alias("kind"), part(0, 3).alias("n"), F.shiftright("facts", 5 + FILES.bit_length() - 1).alias("divisor"), (part(4, 1) == 1).alias("live"), part(5, FILES - 1).alias("file"))


def search_notes(nodes: DataFrame, table: DataFrame, query: str, limit: int = 5, buckets: int = BUCKETS) -> DataFrame:
    """As ``kb.search`` over the numbered nodes that the lists were made of.

    The lists give every section's score but for the phrase.  Only sections of the fullest tier
    can be results, and only those whose score with the phrase's bonus reaches the least of the
    best ``limit`` files; these alone are looked up in ``nodes`` and held against the phrase.
    (Two paths of one hash count as one file, which can only lower that least score.)
    """
    phrase = T.python_tokens(query)
    terms = list(dict.fromkeys(phrase))
    if not terms or limit < 1:
        return kb.search(nodes, "", 0)
    weight = F.when(F.col("kind") == "h", T.HEADING_WEIGHT).when(F.col("kind") == "a", T.PATH_WEIGHT).otherwise(0) * F.col("n")
    body = F.when(F.col("kind") == "b", T.BODY_WEIGHT * F.col("n")).otherwise(0)
    found = unpacked(lists(table, terms, buckets)).groupBy("node").agg(
        F.count_distinct("term").alias("matched"), F.sum(weight).alias("structure"), F.sum(body * T.SCALE).alias("body_part"),
        F.first("divisor").alias("divisor"), F.first("live").alias("live"), F.first("file").alias("file"))
    base = F.col("matched") * T.stride(len(terms)) + F.col("structure") * T.SCALE + F.expr("body_part div divisor")
    found = found.select("node", "matched", "live", "file", base.cast("long").alias("base"))
    top = found.agg(F.max(F.struct("matched", "live")).alias("t")).first()["t"]
    if top is None:
        return kb.search(nodes, "", 0)
    fullest = found.where((F.col("matched") == top["matched"]) & (F.col("live") == top["live"]))
    best = fullest.groupBy("file").agg(F.max("base").alias("base")).orderBy(F.desc("base")).limit(limit).collect()
    rest = fullest.where(F.col("base") >= min(r["base"] for r in best) - T.PHRASE_BONUS).select("node", "matched", "base")
    rows = kb.tokenized(nodes.join(rest, "node"))
    bonus = F.when(T.has_phrase(F.col("b_tok"), phrase), T.PHRASE_BONUS).otherwise(0)
    return kb.ranked(rows.withColumn("score", (F.col("base") + bonus).cast("long")), limit)


@F.pandas_udf(ArrayType(StringType()))
def grams(texts: pd.Series) -> pd.Series:
    """Distinct trigrams of the runs of ASCII letters and digits, in order."""
    import re

    def own(text: str) -> list[str]:
        return sorted({run[k : k + 3] for run in set(re.findall(r"[a-z0-9]{3,}", text)) for k in range(len(run) - 2)})

    return texts.map(lambda t: own(t) if t else [])


def of_transcripts(nodes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, term, doc_id, node_id): the trigrams of what a query looks at."""
    rows = nodes.select("doc_id", "node_id", F.explode(grams(transcript.searched())).alias("term"))
    return rows.select(bucket(F.col("term"), buckets).alias("bucket"), "term", "doc_id", "node_id")


def search_transcripts(docs: DataFrame, nodes: DataFrame, table: DataFrame, text: str, limit: int = 5, buckets: int = BUCKETS, **more) -> DataFrame:
    """As ``transcript.query`` over the nodes that the lists were made of.

    A node that holds a term has all its trigrams; the substring test decides among those.  A
    query with a term of fewer than three characters has no trigram for it and scans the nodes.
    """
    terms = list(dict.fromkeys(T.query_terms(text)))
    if not terms or any(len(t) < 3 for t in terms):
        return transcript.query(docs, nodes, text, limit, **more)
    wanted = {t: sorted({t[k : k + 3] for k in range(len(t) - 2)}) for t in terms}
    every = sorted({g for gs in wanted.values() for g in gs})
    held = lists(table, every, buckets).groupBy("doc_id", "node_id").agg(F.collect_set("term").alias("held"))
    whole = F.lit(False)
    for gs in wanted.values():
        whole = whole | (F.size(F.array_intersect("held", F.array(*[F.lit(g) for g in gs]))) == len(gs))
    candidates = held.where(whole).select("doc_id", "node_id")
    return transcript.query(docs, nodes.join(candidates, ["doc_id", "node_id"], "left_semi"), text, limit, **more)
