"""Exact filtered cosine search over stored embeddings.

Filters are pushed below the scores.  A task scores Arrow blocks of vectors as matrices and keeps
the best rows it has seen, as many as asked for; Spark merges what the tasks keep.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

#: Values of a block that are scored at once.
BLOCK = 4 << 20


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """(size, rows) in doubles; a vector of another size raises."""
    lengths = pc.list_value_length(vectors)
    if len(vectors) and not pc.all(pc.equal(lengths, size)).as_py():
        other = next(n for n in lengths.to_pylist() if n != size)
        raise ValueError(f"the store has vectors of {other} dimensions, the query {size}")
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.ascontiguousarray(flat.reshape(len(vectors), size).T)


def scores(vectors: pa.Array, query: np.ndarray) -> np.ndarray:
    """Cosines, summed in the order of dimensions for every row alike; a zero vector scores 0."""
    rows = matrix(vectors, len(query))
    dot, norm, own = np.zeros(rows.shape[1]), np.zeros(rows.shape[1]), 0.0
    for column, x in zip(rows, query.tolist()):
        dot += column * x
        norm += column * column
        own += x * x
    norm = np.sqrt(norm) * own**0.5
    return np.divide(dot, norm, out=np.zeros_like(dot), where=norm != 0)


def best(rows: pa.Table, limit: int, groups: str | None) -> pa.Table:
    """The ``limit`` best rows (of each group): scores descending, then by id."""
    order = [("score", "descending"), ("point_id", "ascending")]
    if groups is None:
        return rows.sort_by(order).slice(0, limit)
    kinds = pc.unique(rows.column(groups)).to_pylist()
    return pa.concat_tables([rows.filter(pc.equal(rows.column(groups), k) if k is not None else pc.is_null(rows.column(groups))).sort_by(order).slice(0, limit) for k in kinds])


def kept(store: DataFrame, query: list[float], limit: int, groups: str | None = None) -> DataFrame:
    """The rows without their vectors and with ``score`` that any task keeps.

    Rows without a vector are left out.
    """
    rest = [c for c in store.columns if c != "embedding"]
    schema = StructType([store.schema[c] for c in rest]).add("score", DoubleType())
    arrow = to_arrow_schema(schema)
    asked = np.array([float(x) for x in query])

    def run(batches):
        held = None
        for batch in batches:
            step = max(1, BLOCK // max(1, len(asked)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = scores(part.column(part.schema.get_field_index("embedding")), asked)
                columns = [part.column(part.schema.get_field_index(c)) for c in rest] + [pa.array(found, pa.float64())]
                rows = pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
                if groups is None and rows.num_rows > limit:  # the texts of the others are never copied
                    worst = np.partition(found, len(found) - limit)[len(found) - limit]
                    rows = rows.filter(pa.array(found >= worst))
                held = best(rows if held is None else pa.concat_tables([held, rows]), limit, groups)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return store.where("embedding IS NOT NULL").select(*rest, "embedding").mapInArrow(run, schema)


def restricted(store: DataFrame, kind: str | None = None, sources: list[str] | None = None, session: str | None = None) -> DataFrame:
    """Optional conjuncts, all pushed below the scoring; session is a substring of its id."""
    if kind is not None:
        store = store.where(F.col("type") == kind)
    if sources:
        store = store.where(F.col("source").isin(*sources))
    if session is not None:
        store = store.where(F.col("session_id").contains(session))
    return store


def session_ids(store: DataFrame, session: str) -> DataFrame:
    return store.where(F.col("session_id").contains(session)).select("session_id").distinct().orderBy("session_id")


def search(store: DataFrame, query: list[float], limit: int = 5, **filters) -> DataFrame:
    """The ``limit`` best points; equal scores go by point_id."""
    rows = kept(restricted(store, **filters), query, max(limit, 1))
    return rows.orderBy(F.desc("score"), "point_id").limit(limit)


def paired(store: DataFrame, query: list[float], limit: int = 5, **filters) -> DataFrame:
    """The best points of each type, in one pass over the store."""
    rows = kept(restricted(store, **filters), query, max(limit, 1), "type")
    order = W.partitionBy("type").orderBy(F.desc("score"), "point_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
