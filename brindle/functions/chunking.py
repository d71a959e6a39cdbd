"""Overlapping chunks and content identity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

SIZE, OVERLAP = 1600, 320
#: Code points and rows of chunks in one Arrow batch.
BATCH, ROWS = 1 << 20, 4096


def cut_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of ``size`` code points that end after a late newline and overlap the next."""
    return list(windows(text, size, overlap))


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """``cut_text`` one after the other."""
    text, at = text.strip(), 0
    if len(text) <= size:
        if text:
            yield text
        return
    while at < len(text):
        end = min(at + size, len(text))
        stop = end
        if end < len(text):
            newline = text.rfind("\n", at, end)
            if newline - at > overlap:
                stop = newline + 1
        if piece := text[at:stop].strip():
            yield piece
        step = max(stop - at - overlap, 0)
        at = at + step if step else end


def cut_batches(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """One row for each window, in batches of about ``BATCH`` code points however long the texts are."""
    for batch in batches:
        rest, kind = batch.drop_columns([text_col]), batch.schema.field(text_col).type

        def table(rows: list[int], numbers: list[int], pieces: list[str], rest=rest, kind=kind) -> pa.RecordBatch:
            own = [c.take(pa.array(rows, pa.int32())) for c in rest.columns]
            return pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), pa.array(pieces, kind)], names=[*rest.schema.names, "chunk_idx", "chunk"])

        cut, size = ([], [], []), 0
        for row, text in enumerate(batch.column(text_col)):
            for k, piece in enumerate(windows(text.as_py() or "")):
                for values, value in zip(cut, (row, k, piece)):
                    values.append(value)
                size += len(piece)
                if size >= BATCH or len(cut[0]) == ROWS:
                    yield table(*cut)
                    cut, size = ([], [], []), 0
        if cut[0]:
            yield table(*cut)


def chunks(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each chunk: all other columns, chunk_idx (from 0), chunk, hash.

    The cut of each window depends on the one before it, so this is an Arrow map.
    """
    schema = StructType([f for f in df.schema if f.name != text_col]).add("chunk_idx", IntegerType()).add("chunk", StringType())
    cut = df.mapInArrow(lambda batches: cut_batches(batches, text_col), schema)
    return cut.withColumn("hash", text_hash(F.col("chunk")))


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def history_hash(kind: Column, source: Column, chunk_hash: Column) -> Column:
    """Identity of a chunk; path and session are no part of it."""
    return F.concat_ws(":", kind, source, chunk_hash)


def point_id(identity: Column) -> Column:
    return F.regexp_replace(F.substring(F.sha2(identity, 256), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
