"""The history store: discover, extract, chunk, skip what is known, embed, append, search.

Points lie in buckets by the leading digits of their ids: ``points/gen=<n>/bucket=<digits>/type=<t>``.
A run writes one generation, and ``_points.json`` names the generations that each bucket consists
of; it is replaced in one step, so readers see a run whole or not at all.  A run reads and writes
only the buckets that its own points fall in.  The store lies in a folder of this machine's file
system (shared or not); one run at a time changes it.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..embed import Embedder, embedded
from ..functions import chunking, text as T
from ..operators import history, vector
from ..sources import files, transcripts
from .kb_index import locked

COLUMNS = "point_id string, embedding array<float>, text string, type string, source string, path string, session_id string, history_hash string"


def ensure(store: str, size: int) -> None:
    """Fix the vector size of a new store; a store of another size raises and stays as it is."""
    if "://" in store:
        raise ValueError(f"a store is a local or mounted folder, not {store}")
    meta = os.path.join(store, "_store.json")
    if os.path.exists(meta):
        with open(meta) as f:
            own = json.load(f)["vector_size"]
        if own != size:
            raise ValueError(f"store has {own} dimensions, the embedder {size}")
        return
    os.makedirs(store, exist_ok=True)
    with open(meta, "w") as f:
        json.dump({"vector_size": size, "distance": "cosine"}, f)


#: Hex digits of a bucket in new stores, and generations of a bucket before it is written anew.
DIGITS, GENERATIONS = 2, 16
POINTERS = "_points.json"


def pointers(store: str) -> dict:
    """{"digits": n, "buckets": {bucket: [generation, …]}} of a store."""
    try:
        with open(os.path.join(store, POINTERS)) as f:
            return json.load(f)
    except FileNotFoundError:
        return {"digits": DIGITS, "buckets": {}}


def point_to(store: str, state: dict) -> None:
    fresh = os.path.join(store, f".{POINTERS}-{uuid.uuid4().hex}")
    with open(fresh, "w") as f:
        json.dump(state, f)
    os.replace(fresh, os.path.join(store, POINTERS))


def bucket_of(point_id, digits: int):
    return F.substring(point_id, 1, digits)


def points(spark: SparkSession, store: str, buckets: set[str] | None = None) -> DataFrame:
    """The points of a store, or of some of its buckets: other buckets' folders are not listed."""
    live = {b: gens for b, gens in pointers(store)["buckets"].items() if buckets is None or b in buckets}
    base = os.path.join(store, "points")
    paths = [os.path.join(base, f"gen={g}", f"bucket={b}") for b, gens in sorted(live.items()) for g in gens]
    if not paths:
        return spark.createDataFrame([], COLUMNS)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.read.schema(COLUMNS + ", gen int, bucket string").option("basePath", base).parquet(*paths).select(*names)


def clear(store: str, state: dict) -> None:
    """Remove generations that no bucket consists of: what a run before the last has replaced."""
    base = os.path.join(store, "points")
    live = {g for gens in state["buckets"].values() for g in gens}
    for name in os.listdir(base) if os.path.isdir(base) else ():
        if int(name.removeprefix("gen=")) not in live:
            shutil.rmtree(os.path.join(base, name), ignore_errors=True)


def next_generation(store: str, state: dict) -> int:
    base = os.path.join(store, "points")
    there = [int(n.removeprefix("gen=")) for n in os.listdir(base)] if os.path.isdir(base) else []
    return 1 + max([0, *there, *(g for gens in state["buckets"].values() for g in gens)])


def extracted(spark: SparkSession, found: list[files.IndexFile], bases: dict[str, str] | None = None, errors: str = "skip") -> DataFrame:
    """(type, source, path, full_path, session_id, text): the stream of each file and type.

    With ``skip`` a broken file ends before its first broken line, with ``fail`` it raises.
    """
    if not found:
        return spark.createDataFrame([], "type string, source string, path string, full_path string, session_id string, text string")
    lines = transcripts.read_lines(spark, [f.path for f in found], errors)
    info = spark.createDataFrame([(f.path, f.format, f.source) for f in found], "path string, format string, source string")
    if headed := [f.path for f in found if f.header]:
        needed = spark.createDataFrame([(p,) for p in headed], "path string")
        opened = transcripts.with_session_header(lines.join(needed, "path", "left_semi"), "path")
        lines = lines.join(needed.join(opened, "path", "left_anti"), "path", "left_anti")
    lines = lines.join(info, "path")  # the listing grows with the corpus
    typed, env = lines.where("format = 'typed'"), lines.where("format = 'enveloped'")
    keys = ("path", "source")
    prompts = transcripts.typed_prompts(typed, *keys).unionByName(transcripts.enveloped_messages(env, "user", *keys))
    answers = transcripts.typed_answers(typed, *keys).unionByName(transcripts.enveloped_messages(env, "assistant", *keys))
    every = prompts.withColumn("type", F.lit("prompt")).unionByName(answers.withColumn("type", F.lit("answer")))
    out = history.streams(every, "type", "source", "path")
    return shown(out, bases).select("type", "source", "path", "full_path", "session_id", "text")


def shown(rows: DataFrame, bases: dict[str, str] | None) -> DataFrame:
    """Paths relative to their roots (archives: the name) with ``full_path`` and ``session_id``."""
    name = F.element_at(F.split("path", "/"), -1)
    short = F.when(F.col("source") == "archive", name)
    for root in sorted((bases or {}).values(), key=len, reverse=True):
        prefix = os.path.abspath(root).rstrip("/") + "/"
        short = F.coalesce(short, F.when(F.startswith("path", F.lit(prefix)), F.substring(F.col("path"), len(prefix) + 1, 1 << 30)))
    named = rows.withColumns({"full_path": F.col("path"), "session_id": T.session_id(F.col("path"))})
    return named.withColumn("path", F.coalesce(short, F.col("full_path")))


def index(spark: SparkSession, found: list[files.IndexFile], store: str, make: Callable[[], Embedder], fresh: bool = False, bases: dict[str, str] | None = None, errors: str = "skip") -> int:
    """Add what the store does not have; returns how many points were written.

    ``fresh`` ignores what is stored: every point is embedded again and replaces the one of
    its id; points of other files stay.
    """
    chunked = history.identified(extracted(spark, found, bases, errors)).withColumnRenamed("chunk", "text")
    return change_store(spark, chunked, store, make, fresh)


def change(spark: SparkSession, changes: DataFrame, store: str, make: Callable[[], Embedder], bases: dict[str, str] | None = None) -> int:
    """Put and drop chunks (type, source, full_path, chunk, chunk_idx, put); returns how many were written.

    A dropped chunk goes only if the store has it from the same file.
    """
    rows = shown(changes.withColumnRenamed("chunk", "text").withColumnRenamed("full_path", "path"), bases)
    rows = rows.withColumn("history_hash", chunking.history_hash(F.col("type"), F.col("source"), chunking.text_hash(F.col("text"))))
    rows = rows.withColumn("point_id", chunking.point_id(F.col("history_hash")))
    return change_store(spark, rows, store, make)


def change_store(spark: SparkSession, chunked: DataFrame, store: str, make: Callable[[], Embedder], fresh: bool = False) -> int:
    """Write what the store does not have, and rewrite the buckets that lose or replace points."""
    ensure(store, make().size)
    with locked(store):
        state = pointers(store)
        clear(store, state)
        digits = state["digits"]
        stage = os.path.join(store, f".stage-{uuid.uuid4().hex}")
        try:
            # Read once: the buckets to look at, then the rows.
            read = os.path.join(stage, "chunks")
            if "put" not in chunked.columns:
                chunked = chunked.withColumn("put", F.lit(True))
            chunked.withColumn("bucket", bucket_of("point_id", digits)).write.parquet(read)
            chunked = spark.read.parquet(read)
            drops = chunked.where("NOT put").select("point_id", "path")
            touched = chunked.groupBy("bucket", "put").count().collect()  # at most twice 16 ** digits
            chunked = chunked.where("put")
            if fresh:
                chunked = history.first_of_each(chunked)
            else:
                chunked = history.unseen(chunked, points(spark, store, {r["bucket"] for r in touched if r["put"]}))
            made = embedded(chunked, make).select("point_id", "embedding", "text", "source", "path", "session_id", "history_hash", "bucket", "type")
            # Large buckets go to several files, small ones share a task.
            laid_out = lambda df: df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "type", "point_id").write.partitionBy("bucket", "type")
            laid_out(made).parquet(os.path.join(stage, "new"))
            rows = spark.read.schema(made.schema).parquet(os.path.join(stage, "new"))
            held = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
            live = state["buckets"]
            dropping = {r["bucket"] for r in touched if not r["put"]} & live.keys()
            again = dropping | {b for b in held if b in live and (fresh or len(live[b]) >= GENERATIONS)}
            if not held and not again:
                return 0
            if again:
                old = points(spark, store, again).join(rows.select("point_id"), "point_id", "left_anti").join(drops, ["point_id", "path"], "left_anti")
                laid_out(old.withColumn("bucket", bucket_of("point_id", digits)).select(*rows.columns).unionByName(rows)).parquet(os.path.join(stage, "all"))
            g = next_generation(store, state)
            os.makedirs(os.path.join(store, "points"), exist_ok=True)
            os.rename(os.path.join(stage, "all" if again else "new"), os.path.join(store, "points", f"gen={g}"))
            there = {n.removeprefix("bucket=") for n in os.listdir(os.path.join(store, "points", f"gen={g}")) if n.startswith("bucket=")}
            kept = {b: [g] if b in again else [*live.get(b, []), g] for b in there}
            point_to(store, {"digits": digits, "buckets": {b: x for b, x in live.items() if b not in again} | kept})
        finally:
            shutil.rmtree(stage, ignore_errors=True)
    return sum(held.values())


def index_file(spark: SparkSession, path: str, store: str, make: Callable[[], Embedder]) -> int:
    """One finished transcript, its format found from its first known line; a broken one raises."""
    if path.endswith(".zst"):
        kind = "typed"
    else:
        row = transcripts.sniff(transcripts.read_lines(spark, [path], "fail"), "path").first()
        if row is None:
            raise ValueError(f"unknown transcript format: {path}")
        kind = row["format"]
    source = "archive" if files.is_archive_session(path) else "session"
    return index(spark, [files.IndexFile(os.path.abspath(path), kind, source)], store, make, bases={"own": os.path.dirname(os.path.abspath(path))}, errors="fail")


def same_size(store: str, embedder: Embedder) -> None:
    """A query of another vector size than the store's raises."""
    try:
        with open(os.path.join(store, "_store.json")) as f:
            own = json.load(f)["vector_size"]
    except FileNotFoundError:
        return
    if own != embedder.size:
        raise ValueError(f"store has {own} dimensions, the embedder {embedder.size}")


def search(spark: SparkSession, store: str, query: str, embedder: Embedder, limit: int = 5, session: str | None = None, kind: str | None = None, sources: list[str] | None = None, enabled: bool = True) -> DataFrame:
    """Ranked history; nothing is embedded if search is off or no session matches."""
    if session is not None and not session.strip():
        raise ValueError("session filter must not be empty")
    same_size(store, embedder)
    table = points(spark, store)
    if not enabled or limit == 0 or (session is not None and vector.restricted(table, session=session).isEmpty()):
        return table.withColumn("score", F.lit(0.0)).drop("embedding").limit(0)
    return vector.search(table, embedder.embed_query(query), limit, kind=kind, sources=sources, session=session)


def search_vector(spark: SparkSession, store: str, query: list[float], limit: int = 5, **filters) -> DataFrame:
    """Ranked history for a vector that is already there."""
    return vector.search(points(spark, store), query, limit, **filters)


def paired(spark: SparkSession, store: str, query: str, embedder: Embedder, limit: int = 5, sources: list[str] | None = None, enabled: bool = True) -> DataFrame:
    """Prompts and answers of one embedding, in one pass; none if search is off."""
    same_size(store, embedder)
    if not enabled or limit == 0:
        return points(spark, store).drop("embedding").withColumns({"score": F.lit(0.0), "rank": F.lit(0)}).limit(0)
    return vector.paired(points(spark, store), embedder.embed_query(query), limit, sources=sources)


def stats(spark: SparkSession, store: str) -> int:
    return points(spark, store).count()
