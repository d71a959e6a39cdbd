"""The Markdown index: build, freshness, atomic replacement, search.

The index is a folder with Parquet tables ``nodes``, ``terms`` (see postings) and ``manifest``.  A new one
is staged beside it and renamed into place under a lock that other processes respect.
"""

from __future__ import annotations

import fcntl
import os
import shutil
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import python_tokens
from ..operators import kb, postings
from ..sources import files, transcripts

TERMS = "term string, nodes array<long>, facts array<int>, bucket int"
MANIFEST = "path string, mtime_ns long, size long"


@contextmanager
def locked(index: str):
    folder, name = os.path.split(os.path.abspath(index))
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f".{name}.lock"), "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def swap(stage: str, index: str) -> None:
    """Put ``stage`` where ``index`` is; the old one comes back if that fails."""
    folder, name = os.path.split(os.path.abspath(index))
    backup = os.path.join(folder, f".{name}.backup-{uuid.uuid4().hex}")
    had = os.path.exists(index)
    if had:
        os.rename(index, backup)
    try:
        os.rename(stage, index)
    except OSError:
        if had:
            os.rename(backup, index)
        raise
    if had:
        shutil.rmtree(backup)


def source_lines(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, line_no, line) with paths relative to ``root``; text that is no UTF-8 raises."""
    if not paths:
        return spark.createDataFrame([], "path string, line_no int, line string")
    base = os.path.abspath(root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").load([os.path.join(base, p) for p in paths])
    # createDataFrame would decode on the driver; decode() here raises on malformed bytes.
    text = F.expr("decode(content, 'UTF-8')")
    bad = F.encode(text, "UTF-8") != F.col("content")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not UTF-8: "), "path")).cast("string")).otherwise(text)
    rel = F.substring_index(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), base, -1)
    return transcripts.lines_of(raw.select(rel.alias("path"), checked.alias("text")), "path")


def fresh(spark: SparkSession, root: str, index: str) -> bool:
    """The manifest of the index equals the present files."""
    path = os.path.join(index, "manifest")
    if not os.path.isdir(path):
        return False
    new = spark.createDataFrame(files.manifest(root), MANIFEST)
    return kb.changed(spark.read.schema(MANIFEST).parquet(path), new).isEmpty()


@dataclass(frozen=True)
class Summary:
    files: int
    nodes: int


def _build(spark: SparkSession, root: str, index: str) -> Summary:
    files.disjoint(root, index)
    before = files.manifest(root)
    folder, name = os.path.split(os.path.abspath(index))
    stage = os.path.join(folder, f".{name}.staging-{uuid.uuid4().hex}")
    try:
        lines = source_lines(spark, root, [p for p, _, size in before if size])
        postings.numbered(kb.nodes(lines)).write.parquet(f"{stage}/nodes")
        postings.write(postings.of_notes(spark.read.parquet(f"{stage}/nodes")), f"{stage}/terms")
        spark.createDataFrame(before, MANIFEST).coalesce(1).write.parquet(f"{stage}/manifest")
        if files.manifest(root) != before:
            raise RuntimeError(f"files below {root} changed while they were read")
        n = spark.read.parquet(f"{stage}/nodes").count()
        swap(stage, index)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    spark.catalog.refreshByPath(index)
    return Summary(len(before), n)


def build(spark: SparkSession, root: str, index: str) -> Summary:
    with locked(index):
        return _build(spark, root, index)


def _search(spark: SparkSession, index: str, query: str, limit: int) -> DataFrame:
    nodes = spark.read.parquet(f"{index}/nodes")
    lists = os.path.join(index, "terms")
    if not os.path.isdir(lists):  # an index of an earlier version
        return kb.search(nodes, query, limit)
    return postings.search_notes(nodes, spark.read.schema(TERMS).parquet(lists), query, limit)


def search(spark: SparkSession, root: str, index: str, query: str, limit: int = 5, rebuild: bool = True) -> DataFrame:
    """Ranked notes; a missing or stale index is rebuilt, or raises with ``rebuild`` off."""
    if limit == 0 or not python_tokens(query):
        return kb.search(kb.nodes(source_lines(spark, root, [])), "", 0)
    with locked(index):
        if not fresh(spark, root, index):
            if not rebuild:
                raise RuntimeError(f"index {index} is missing or stale")
            _build(spark, root, index)
        return _search(spark, index, query, limit)


def with_text(spark: SparkSession, root: str, results: DataFrame) -> DataFrame:
    """Results (few) with their exact source lines."""
    rows = results.collect()
    if not rows:
        return results
    own = spark.createDataFrame(rows, results.schema)
    return kb.with_source_text(own, source_lines(spark, root, sorted({r["path"] for r in rows})))


def context(spark: SparkSession, root: str, index: str, query: str, limit: int = 5) -> tuple[list, str | None]:
    """(results, warning): fresh, rebuilt, stale with a warning, or none with a warning."""
    try:
        with locked(index):
            warning = None
            if not fresh(spark, root, index):
                try:
                    _build(spark, root, index)
                except Exception as e:  # any failure to read the files
                    warning = f"KB PageIndex rebuild failed; using stale index: {first_line(e)}"
                    if not os.path.isdir(os.path.join(index, "nodes")):
                        return [], f"KB PageIndex unavailable: {first_line(e)}"
            found = _search(spark, index, query, limit)
            if warning is None:
                found = with_text(spark, root, found)
            return sorted(found.collect(), key=lambda r: (-r["score"], r["path"], r["heading"], r["node_id"])), warning
    except (OSError, PySparkException, Py4JError) as e:
        return [], f"KB PageIndex unavailable: {first_line(e)}"


def first_line(e: Exception) -> str:
    return (str(e).splitlines() or [type(e).__name__])[0]
