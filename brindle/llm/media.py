"""Media columns: texts stored as lossless WebP images, read back and described.

``store`` turns a text column into image files; ``read_back`` decodes images (of any
lossless WebP writer) to pixel arrays.  Both work row by row, so memory is bounded by one
text and no row depends on another.

Defined results: a null or empty text is one block of 64 zero bytes; very long texts use
wider rows of pixels, and one of more than 2**28 bytes raises; equal texts give equal files and features; repeated rows give
repeated results; an empty table gives an empty table; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import webp
from .common import batches, utf8

BLOCK = 64


def payload_of(data: bytes) -> np.ndarray:
    size = max(BLOCK, -(-len(data) // BLOCK) * BLOCK)
    return np.frombuffer(data.ljust(size, b"\0"), np.uint8)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, media): one lossless WebP file for each text."""

    def rows(it):
        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("media", pa.binary())])

        def fn(c):
            raw = [utf8(t) for t in c["text"]]
            loads = [payload_of(b) for b in raw]
            return {"id": c["id"], "n_bytes": list(map(len, raw)), "payload_bytes": list(map(len, loads)), "media": [webp.encode_samples(p) for p in loads]}

        return batches(it, fn, schema)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(rows, "id long, n_bytes long, payload_bytes long, media binary").withColumnRenamed("id", id_col)


def describe(data: bytes, size: int) -> tuple[bytes, str]:
    """The first ``size`` samples of an image, and its features."""
    width, height, argb = webp.decode(data)
    found = webp.samples(argb)[:size]
    sums = found.reshape(-1, 4).sum(axis=0, dtype=np.int64)
    counts = np.bincount(found, minlength=256)
    feature = f"{width}x{height}:{':'.join(map(str, sums.tolist()))}:{np.count_nonzero(counts)}:{int(counts.argmax())}"
    return found.tobytes(), feature


def read_back(images: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode ``media`` and give digests of what was read.

    ``feature`` is width x height, the sums of every fourth sample, from each of the first four, the
    number of distinct samples and the most frequent one (the smallest among equals).
    """
    out = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def rows(it):
        names = [x.split() for x in out.split(", ")]
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in names])

        def fn(c):
            res = {n: [] for n, _ in names}
            for key, n, size, media in zip(c["id"], c["n_bytes"], c["payload_bytes"], c["media"]):
                payload, feature = describe(media, size)
                values = (key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for column, v in zip(res.values(), values):
                    column.append(v)
            return res

        return batches(it, fn, schema)

    src = images.select(F.col(id_col).alias("id"), "n_bytes", "payload_bytes", "media")
    return src.mapInArrow(rows, out).withColumnRenamed("id", id_col)
