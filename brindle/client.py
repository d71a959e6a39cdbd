"""Embedding services over HTTP, called from the tasks.

A client sends the texts of an Arrow batch in requests of ``batch`` texts, a few at a time, and
gives the vectors back in the order of the texts.  Answers are checked: one vector for each text,
each of the profile's size.
"""

from __future__ import annotations

import http.client
import json
import time
import tomllib
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from .config import Embedding
from .embed import Embedder, HashingEmbedder, in_order, with_retry

# Where the services answer unless a profile says otherwise.
LOCAL_URL, HOSTED_URL = "http://localhost:11434", "https://openrouter.ai/api/v1/embeddings"
TIMEOUT, BATCH, IN_FLIGHT = 60, 10, 4


def send(url: str, body: dict, key: str | None = None) -> tuple[int, dict, bytes]:
    """(status, headers, body) of a POST; whatever breaks on the way is an OSError."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), head)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return answer.status, answer.headers, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers, e.read()
    except http.client.HTTPException as e:  # an answer that ends early
        raise OSError(f"broken answer: {e!r}") from e


def parsed(body: bytes) -> dict:
    try:
        value = json.loads(body)
    except ValueError as e:
        raise ValueError(f"the embedding service's answer is no JSON: {body[:80]!r}") from e
    if not isinstance(value, dict):
        raise ValueError(f"the embedding service's answer is no object: {body[:80]!r}")
    return value


@dataclass
class LocalEmbedder:
    """One request for each text, without a key and without another try."""

    model: str
    size: int
    url: str = LOCAL_URL

    def embed_query(self, text: str) -> list[float]:
        return self.embed([text])[0]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            status, _, body = send(f"{self.url}/api/embeddings", {"model": self.model, "prompt": text})
            if status >= 400:
                raise RuntimeError(f"embedding service error {status}: {body[:200]!r}")
            out += in_order([(0, parsed(body)["embedding"])], 1, self.size)
        return out


@dataclass
class HostedEmbedder:
    """Requests of ``batch`` texts, ``in_flight`` at a time, ``delay`` seconds between them.

    A delay puts one request after the other.  States and transport errors that may pass are
    tried again; the first request that fails for good ends the others.
    """

    model: str
    size: int
    key: str
    url: str = HOSTED_URL
    instruction: str | None = None
    batch: int = BATCH
    in_flight: int = IN_FLIGHT
    delay: float = 0.0
    sleep: Callable[[float], None] = time.sleep

    def embed_query(self, text: str) -> list[float]:
        asked = f"Instruct: {self.instruction}\nQuery:{text}" if self.instruction else text
        return self.request([asked], "search_query")[0]

    def embed(self, texts: list[str]) -> list[list[float]]:
        parts = deque(texts[k : k + self.batch] for k in range(0, len(texts), self.batch))
        out, waiting = [], deque()
        with ThreadPoolExecutor(1 if self.delay else self.in_flight) as pool:
            try:
                while parts or waiting:
                    while parts and len(waiting) < (1 if self.delay else self.in_flight):
                        if self.delay and out:
                            self.sleep(self.delay)
                        waiting.append(pool.submit(self.request, parts.popleft(), "search_document"))
                    out += waiting.popleft().result()
            finally:
                for w in waiting:
                    w.cancel()
        return out

    def request(self, texts: list[str], kind: str) -> list[list[float]]:
        body = {"model": self.model, "input": texts, "dimensions": self.size, "encoding_format": "float", "input_type": kind, "provider": {"zdr": True}}
        answer = parsed(with_retry(lambda: send(self.url, body, self.key), self.sleep))
        return in_order([(x["index"], x["embedding"]) for x in answer["data"]], len(texts), self.size)


def read_key(path: str) -> str:
    """``api_key`` of a TOML file; a missing or blank one raises."""
    with open(path, "rb") as f:
        key = tomllib.load(f).get("api_key")
    if not isinstance(key, str) or not key.strip():
        raise ValueError(f"{path} needs a non-blank api_key")
    return key


def factory(profile: Embedding, key_file: str | None = None, url: str | None = None, batch: int = BATCH, delay: float = 0.0) -> Callable[[], Embedder]:
    """Makes the profile's embedder; the key is read here, on the driver."""
    size = profile.vector_size
    if profile.backend == "hashing":
        return lambda: HashingEmbedder(size)
    if profile.backend == "local":
        return lambda: LocalEmbedder(profile.model, size, url or LOCAL_URL)
    if not key_file:
        raise ValueError("the hosted backend needs a file with an api_key")
    key = read_key(key_file)
    return lambda: HostedEmbedder(profile.model, size, key, url or HOSTED_URL, profile.query_instruction, batch, delay=delay)
