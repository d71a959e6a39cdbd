"""Compose history and notes into one labelled context for a prompt."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import Row, SparkSession

from ..embed import Embedder
from ..operators import present
from . import history_index, kb_index

SOURCES = ["session", "archive"]
PAIR = "point_id string, text string, type string, source string, path string, session_id string, history_hash string, score double, rank int"


def read_prompt(prompt: str | None, hook: TextIO) -> str:
    """The argument, else field ``prompt`` of the hook's JSON; a value that is no string is empty."""
    if prompt is not None:
        return prompt
    value = json.load(hook)
    value = value.get("prompt") if isinstance(value, dict) else None
    return value if isinstance(value, str) else ""


def chunks(spark: SparkSession, store: str, prompt: str, embedder: Embedder, most: int) -> list:
    """Prompts and answers in one pass; if it fails, each group on its own, so that one may be lost alone.

    Failures go to standard error: standard output belongs to the hook.
    """
    try:
        return history_index.paired(spark, store, prompt, embedder, most, SOURCES).collect()
    except Exception as e:  # history is optional here
        print(f"history search failed: {kb_index.first_line(e)}", file=sys.stderr)
    try:
        vector = embedder.embed_query(prompt)
    except Exception as e:
        print(f"embedding failed: {kb_index.first_line(e)}", file=sys.stderr)
        return []
    found = []
    for kind in ("prompt", "answer"):
        try:
            rows = history_index.search_vector(spark, store, vector, most, kind=kind, sources=SOURCES).collect()
            found += [Row(**r.asDict(), rank=k) for k, r in enumerate(rows, 1)]
        except Exception as e:
            print(f"{kind} search failed: {kb_index.first_line(e)}", file=sys.stderr)
    return found


def run(spark: SparkSession, prompt: str, store: str, embedder: Embedder, kb_root: str, kb: str, limit: int = 5, enabled: bool = True) -> str:
    """The hook's output; a section that fails or finds nothing is left out."""
    if not prompt:
        return present.hook_output("")
    sections, most = [], min(limit, present.MOST)
    if enabled and most:
        if pairs := chunks(spark, store, prompt, embedder, most):
            row = present.session_section(spark.createDataFrame(pairs, PAIR)).first()
            sections += [row["section"]] if row else []
    found, warning = kb_index.context(spark, kb_root, kb, prompt, most)
    if warning:
        sections.append(f"## KB PageIndex warning\n{warning}")
    if found:
        section = present.kb_section(spark.createDataFrame(found)).first()
        sections.append(section["section"])
    return present.hook_output("\n\n".join(sections))
