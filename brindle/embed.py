"""Embedding: a protocol, an offline hashing embedder, and the rules of remote ones (see client)."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

RETRY_STATUS = frozenset((408, 429, 500, 502, 503, 504, 524, 529))
ATTEMPTS, BASE_MS, JITTER_MS = 3, 250, 100


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Signed word hashes of unit length: needs no model or network and never changes."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed_query(self, text: str) -> list[float]:
        return self.embed([text])[0]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for word in re.findall(r"[^\W_]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


def in_order(items: list[tuple[int, list[float]]], count: int, size: int) -> list[list[float]]:
    """Vectors by the index that came with them, each index once and each of the right size."""
    if len(items) != count or sorted(i for i, _ in items) != list(range(count)):
        raise ValueError(f"expected embeddings 0 to {count - 1}, got {sorted(i for i, _ in items)}")
    vectors = [v for _, v in sorted(items, key=lambda x: x[0])]
    for v in vectors:
        if len(v) != size:
            raise ValueError(f"expected {size} dimensions, got {len(v)}")
    return vectors


def retry_after(value: str | None, now: datetime | None = None) -> float | None:
    """Seconds of a Retry-After header: a number or a date in the future."""
    if value is None:
        return None
    if value.isdigit():
        return float(value)
    try:
        seconds = (parsedate_to_datetime(value) - (now or datetime.now(timezone.utc))).total_seconds()
    except (TypeError, ValueError):
        return None
    return seconds if seconds >= 0 else None


def backoff(attempt: int, jitter_ms: int | None = None) -> float:
    jitter = time.time_ns() // 1000 % (JITTER_MS + 1) if jitter_ms is None else jitter_ms
    return (BASE_MS * (1 << min(attempt, 8)) + jitter) / 1000


def with_retry(send: Callable[[], tuple[int, dict, object]], sleep=time.sleep):
    """``send`` gives (status, headers, body); transport errors and some states are tried again."""
    for attempt in range(ATTEMPTS):
        last = attempt == ATTEMPTS - 1
        try:
            status, headers, body = send()
        except OSError:
            if last:
                raise
            sleep(backoff(attempt))
            continue
        if status < 400:
            return body
        if last or status not in RETRY_STATUS:
            raise RuntimeError(f"embedding service error {status}: {body}")
        wait = retry_after(headers.get("Retry-After"))
        sleep(backoff(attempt) if wait is None else wait)


def embedded(df: DataFrame, make: Callable[[], Embedder], text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Adds the vectors of a text column, an Arrow batch at a time; one embedder for each task."""
    return df.withColumn(out, F.pandas_udf(_iterate(make), "array<float>")(F.col(text_col)))


def _iterate(make):
    def fn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for texts in batches:
            yield pd.Series(own.embed([t or "" for t in texts]), dtype=object)

    fn.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return fn
