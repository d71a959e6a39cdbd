"""Results as text: listings, NDJSON, and the sections that enrich a prompt."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import preview

SESSION_TITLE = "## Relevant past session chunks (raw prompt/answer history; use session_id to inspect source transcript)"
KB_TITLE = "## Relevant KB notes (KB PageIndex)"
MOST = 3


def ndjson(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct("type", "text", "source", "path", "session_id", "score")).alias("line"))


def history_source(path: Column, source: Column) -> Column:
    """Fixed labels of the tools that write transcripts."""
    return F.when(path.contains(".codex"), "codex").when(source.isin("session", "archive"), "claude").otherwise("unknown")


def session_line() -> Column:
    return F.concat(
        F.lit("\n- ("), F.format_string("%.2f", "score"), F.lit(") source: "), history_source(F.col("path"), F.col("source")), F.lit(" source_type: "), "source",
        F.lit(" session_id: "), "session_id", F.lit("\n  path: "), "path", F.lit("\n  text: "), preview(F.col("text"), 300),
    )


def session_section(pairs: DataFrame) -> DataFrame:
    """One row: prompts and answers (type, rank, …) under their headings; rows without a session go."""
    rows = pairs.where("session_id != ''").select("type", "rank", session_line().alias("line"))

    def group(kind: str, label: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("rank", "line"))))
        lines = F.array_join(F.transform(own, lambda x: x["line"]), "")
        return F.when(F.size(own) > 0, F.concat(F.lit(f"\n### {label}"), lines)).otherwise(F.lit(""))

    return rows.agg(F.concat(F.lit(SESSION_TITLE), group("prompt", "prompts"), group("answer", "answers")).alias("section"), F.count("*").alias("n")).where("n > 0").select("section")


def kb_section(results: DataFrame) -> DataFrame:
    """One row with the notes in rank order."""
    line = F.concat(F.lit("\n- ("), F.col("score").cast("string"), F.lit(") "), "path", F.lit(" > "), "heading", F.lit(" ["), "node_id", F.lit("]: "), preview(F.col("text"), 500))
    key = F.struct((-F.col("score")).alias("s"), "path", "heading", "node_id", line.alias("line"))
    parts = F.array_sort(F.collect_list(key))
    return results.agg(F.concat(F.lit(KB_TITLE), F.array_join(F.transform(parts, lambda x: x["line"]), "")).alias("section"), F.count("*").alias("n")).where("n > 0").select("section")


def hook_output(context: str) -> str:
    if not context:
        return "{}"
    return json.dumps({"hookSpecificOutput": {"additionalContext": context, "hookEventName": "UserPromptSubmit"}}, ensure_ascii=False, separators=(",", ":"))


def results_listing(rows) -> str:
    """Ranked history results with a preview of 200 characters."""
    out = []
    for k, r in enumerate(rows, 1):
        text = r["text"].replace("\n", " ")
        out.append(f"{k}. [{r['source']}] {r['path']} (score: {r['score']:.3f})\n   {text[:200] + '...' if len(text) > 200 else text}\n")
    return "\n".join(out)


def kb_listing(rows) -> str:
    if not rows:
        return "(no KB notes found)"
    return "\n".join(f"{k}. [kb] {r['path']}#{r['node_id']} > {r['heading']} (score: {r['score']})\n   reason: {r['reason']}\n   text: {r['text']}\n" for k, r in enumerate(rows, 1))


def transcript_listing(rows) -> str:
    if not rows:
        return "(no transcript notes found)"
    return "\n".join(f"{k}. [transcript] {r['doc_id']}#{r['node_id']} > {r['title']} (score: {r['score']})\n   source: {r['source_path']}\n   reason: {r['reason']}\n   next: {r['next_content_command']}\n" for k, r in enumerate(rows, 1))
