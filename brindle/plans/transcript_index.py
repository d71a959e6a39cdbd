"""The transcript outline index: two tables, documents and their nodes."""

from __future__ import annotations

import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..operators import postings, transcript, tree
from ..sources import documents, files, transcripts
from .kb_index import locked, swap


GRAMS = "term string, doc_id string, node_id string, bucket int"


def turns(spark: SparkSession, found: list[str]) -> DataFrame:
    """Turns of transcripts; of files with one document id the last path stays; a broken file raises."""
    if not found:
        return spark.createDataFrame([], "doc_id string, source_path string, role string, text string, turn_index int, has_tool_use boolean, tool_call_count int")
    lines = transcripts.read_lines(spark, found, "fail").withColumn("doc_id", T.sanitize(T.session_id(F.col("path"))))
    env = F.array_contains(F.split("path", "/"), ".codex")
    both = transcripts.typed_turns(lines.where(~env), "path", "doc_id").unionByName(transcripts.enveloped_turns(lines.where(env), "path", "doc_id"))
    last = W.partitionBy("doc_id").orderBy(F.split("path", "/").desc())
    both = both.withColumn("_r", F.dense_rank().over(last)).where("_r = 1")
    return both.select("doc_id", F.col("path").alias("source_path"), "role", "text", "turn_index", "has_tool_use", "tool_call_count")


def build(spark: SparkSession, roots: list[files.Rule], out: str, max_sessions: int | None = None) -> dict[str, int]:
    """Write the tables; sessions beyond ``max_sessions`` in path order are left out.

    Both tables come from turns that were read once, are written beside the index and take its
    place together; if a step fails the old index stays.
    """
    found = [f.path for f in files.discover(roots)][:max_sessions]
    folder, name = os.path.split(os.path.abspath(out))
    with locked(out):
        stage = os.path.join(folder, f".{name}.stage-{uuid.uuid4().hex}")
        try:
            read = os.path.join(stage, "turns")
            made = turns(spark, found)
            made.write.parquet(read)
            rows = spark.read.schema(made.schema).parquet(read)
            transcript.documents(rows).write.parquet(os.path.join(stage, "documents"))
            made = os.path.join(stage, "nodes")
            transcript.nodes(rows).write.parquet(made)
            postings.write(postings.of_transcripts(spark.read.parquet(made)), os.path.join(stage, "grams"))
            shutil.rmtree(read)
            swap(stage, out)
        finally:
            shutil.rmtree(stage, ignore_errors=True)
    spark.catalog.refreshByPath(out)
    docs, nodes = load(spark, out)
    return {"files": len(found), "sessions": docs.count(), "nodes": nodes.count()}


def load(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(os.path.join(out, "documents")), spark.read.parquet(os.path.join(out, "nodes"))


def tree_rows(nodes: DataFrame) -> DataFrame:
    """The nodes of an index as rows of a tree of one level."""
    position = F.col("node_id").cast("int") - 1
    named = [F.col(n).cast(t).alias(n) for n, t in tree.FIELDS]
    return nodes.select("doc_id", position.alias("position"), F.lit(-1).alias("parent_position"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("depth"), F.array(position).alias("path"), *named)


def write_json(spark: SparkSession, out: str, target: str) -> None:
    """One indented JSON file for each document with its nodes, for other tools."""
    docs, nodes = load(spark, out)
    documents.write(docs, tree_rows(nodes), target)


def read_json(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """Documents and nodes of such files, nested nodes too; a bad file raises, a missing folder has none."""
    return documents.read(spark, source)


def query(spark: SparkSession, out: str, text: str, limit: int = 5) -> DataFrame:
    docs, nodes = load(spark, out)
    lists = os.path.join(out, "grams")
    if not os.path.isdir(lists):  # an index of an earlier version
        return transcript.query(docs, nodes, text, limit)
    return postings.search_transcripts(docs, nodes, spark.read.schema(GRAMS).parquet(lists), text, limit)


def names_of(selector: str) -> list[str]:
    """Document ids that a selector may mean, the likeliest first: as it stands, without ``.json``,
    sanitised, its stem sanitised, and its file name without a transcript suffix."""
    plain = lambda x: re.sub(r"[^A-Za-z0-9_-]", "_", x)
    name = os.path.basename(selector)
    stem = os.path.splitext(name)[0]
    for suffix in (".json", ".jsonl.zst", ".jsonl"):
        name = name.removesuffix(suffix)
    return list(dict.fromkeys((selector, selector.removesuffix(".json"), plain(selector), plain(stem), name, plain(name))))


def content(spark: SparkSession, out: str, selector: str, locator: str) -> str:
    """Text of the first document that the selector may mean; if there is none, it raises."""
    docs, nodes = load(spark, out)
    names = names_of(selector)
    there = {r["doc_id"] for r in docs.where(F.col("doc_id").isin(*names)).select("doc_id").distinct().collect()}
    if not there:
        raise ValueError(f"document not found in the transcript index: {selector}")
    return transcript.content(docs, nodes, next(n for n in names if n in there), locator)
