"""Session history: streams, identity, deduplication, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.chunking import chunks, history_hash, point_id


def streams(messages: DataFrame, *keys: str) -> DataFrame:
    """(keys…, text): all messages of a stream joined by newlines, in order of line and seq."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "seq", "text")))
    return messages.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def identified(streamed: DataFrame) -> DataFrame:
    """Chunks of (type, source, path, session_id, text) with history_hash and point_id."""
    cut = chunks(streamed)
    identity = history_hash(F.col("type"), F.col("source"), F.col("hash"))
    return cut.withColumn("history_hash", identity).withColumn("point_id", point_id(F.col("history_hash")))


def first_of_each(chunked: DataFrame) -> DataFrame:
    """The first chunk of each identity: prompts before answers, paths by component, then position.

    Where there is a ``full_path`` it decides, since shown paths are relative to their roots.
    """
    path = "full_path" if "full_path" in chunked.columns else "path"
    order = W.partitionBy("history_hash").orderBy(F.col("type").desc(), F.split(path, "/"), "chunk_idx")
    return chunked.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def unseen(chunked: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose identity the store does not have, each once."""
    return first_of_each(chunked.join(store.select("history_hash"), "history_hash", "left_anti"))
