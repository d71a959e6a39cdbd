"""Profiles: built-in values, a TOML file over them, environment variables over both."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, replace

BACKENDS = ("local", "hosted", "hashing")
PREFIX = "BRINDLE_EMBEDDING_"


@dataclass(frozen=True)
class Embedding:
    backend: str = "hashing"
    model: str = "hashing-1"
    vector_size: int = 1024
    collection: str = "history"
    query_instruction: str | None = None

    def format_query(self, query: str) -> str:
        return f"Instruct: {self.query_instruction}\nQuery:{query}" if self.query_instruction else query


@dataclass(frozen=True)
class Config:
    search_enabled: bool = True
    embedding: Embedding | None = None
    embedding_error: str | None = None


def _string(table: dict, key: str, needed: bool = True) -> str | None:
    value = table.get(key)
    if value is None and not needed:
        return None
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"embedding.{key} must be a non-blank string")
    return value


def _size(value, key: str) -> int:
    if isinstance(value, bool) or not str(value).isdigit() or int(value) < 1:
        raise ValueError(f"{key} must be a positive integer")
    return int(value)


def _backend(value: str, key: str) -> str:
    if value not in BACKENDS:
        raise ValueError(f"{key} must be one of {', '.join(BACKENDS)}")
    return value


def parse(raw: str) -> Config:
    """A file that cannot be parsed counts as absent; a bad embedding section fails when it is used."""
    try:
        table = tomllib.loads(raw)
    except tomllib.TOMLDecodeError:
        return Config()
    search = table.get("search")
    enabled = search.get("enabled", True) is True if isinstance(search, dict) else True
    section = table.get("embedding")
    if section is None:
        return Config(enabled)
    try:
        if not isinstance(section, dict):
            raise ValueError("invalid [embedding]: expected a table")
        own = Embedding(_backend(_string(section, "backend"), "embedding.backend"), _string(section, "model"), _size(section.get("vector_size"), "embedding.vector_size"), _string(section, "collection"), _string(section, "query_instruction", False))
        return Config(enabled, own)
    except ValueError as e:
        return Config(enabled, None, str(e))


def load(path: str) -> Config:
    """The profile of a file; a missing or unreadable one counts as absent."""
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except (OSError, UnicodeDecodeError):
        return Config()


def resolve(config: Config, get: Callable[[str], str | None]) -> Embedding:
    """The profile in force; ``get`` reads one environment variable."""
    if config.embedding_error:
        raise ValueError(config.embedding_error)
    out = config.embedding or Embedding()
    for key in ("backend", "model", "vector_size", "collection", "query_instruction"):
        name = PREFIX + key.upper()
        if (value := get(name)) is None:
            continue
        if not value.strip():
            raise ValueError(f"{name} must not be blank")
        out = replace(out, **{key: _size(value, name) if key == "vector_size" else _backend(value, name) if key == "backend" else value})
    return out
