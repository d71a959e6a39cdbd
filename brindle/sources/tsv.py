"""Interchange files of the note index: escaped TSV rows, checked as they are read."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import escape_tsv, unescape_tsv
from . import lines

NODES = (("path", "string"), ("line_start", "long"), ("line_end", "long"), ("heading_path", "string"), ("normalized_body", "string"))
MANIFEST = (("path", "string"), ("mtime_ns", "long"), ("size", "long"))


def render(df: DataFrame, fields=NODES) -> DataFrame:
    """(value): one line for each row."""
    return df.select(F.concat_ws("\t", *[escape_tsv(F.col(n).cast("string")) for n, _ in fields]).alias("value"))


def parse(rows: DataFrame, fields=NODES, extra: Column | None = None) -> DataFrame:
    """Rows of (row, value); a wrong field count, number or escape raises and names the row."""
    parts = F.split("value", "\t", -1)

    def check(ok: Column, what: str, value: Column) -> Column:
        said = F.concat(F.lit(f"invalid {what} in row "), F.col("row").cast("string"))
        return F.when(ok, value).otherwise(F.raise_error(said).cast("string"))

    out = rows.withColumn("p", F.when(F.size(parts) == len(fields), parts).otherwise(F.raise_error(F.concat(F.lit("wrong field count in row "), F.col("row").cast("string"))).cast("array<string>")))
    columns = []
    for k, (name, kind) in enumerate(fields):
        raw = F.col("p")[k]
        columns.append(unescape_tsv(raw).alias(name) if kind == "string" else check(raw.rlike(r"^\d{1,18}$"), name, raw).cast(kind).alias(name))
    got = out.select("row", *columns)
    if extra is not None:
        got = got.withColumn(fields[0][0], check(extra, "line range", F.col(fields[0][0])))
    return got.drop("row")


def parts_of(path: str) -> list[str]:
    """A file, or the part files of a folder in the order of their names."""
    if not os.path.isdir(path):
        return [path]
    return [os.path.join(path, n) for n in sorted(os.listdir(path)) if not n.startswith(("_", "."))]


def read(spark: SparkSession, path: str, fields=NODES, range_bytes: int = lines.RANGE) -> DataFrame:
    """Rows of an index; its lines are read and numbered in ranges, so no task sees all of them."""
    rows = lines.read(spark, parts_of(path), "fail", range_bytes, running=True).select(F.col("line_no").alias("row"), F.col("line").alias("value"))
    span = (F.col("line_start") > 0) & (F.col("line_end") >= F.col("line_start")) if fields is NODES else None
    return parse(rows, fields, span)


def write(df: DataFrame, path: str, fields=NODES) -> None:
    """Part files in the order of the rows' fields: one after the other they are the sorted index."""
    names = [n for n, _ in fields]
    render(df.repartitionByRange(*names).sortWithinPartitions(*names), fields).write.mode("overwrite").text(path)


def join_parts(folder: str, target: str) -> None:
    """One file of a folder's parts, copied block by block and put in place at once."""
    stage = f"{target}.{uuid.uuid4().hex}"
    with open(stage, "wb") as out:
        for part in parts_of(folder):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out)
    os.replace(stage, target)
