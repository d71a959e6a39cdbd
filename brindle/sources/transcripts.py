"""Transcript lines of three JSONL dialects as rows.

``typed`` lines carry ``type`` and ``message`` (two dialects share it, one with a session header);
``enveloped`` lines wrap a ``payload``.  Lines are parsed once into VARIANT, since a message's
content is a string or a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import blank, trim
from . import lines

# Opening words of context that tools add to a user's message.
PRELUDES = ("# AGENTS.md instructions", "<environment_context>", "<collaboration_mode>", "<skills_instructions>", "<permissions instructions>")
BLOCKS = "array<variant>"


def read_lines(spark: SparkSession, paths: list[str], errors: str = "skip") -> DataFrame:
    """(path, line_no, line); .zst files are decoded as they are read; lines end at newlines only."""
    return lines.read(spark, paths, errors)


def lines_of(df: DataFrame, *keys: str) -> DataFrame:
    """(keys…, line_no from 1, line): split at newlines, without a final empty line."""
    parts = F.split("text", "\n", -1)
    last = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = df.select(*keys, F.posexplode(last).alias("p", "line"))
    return rows.select(*keys, (F.col("p") + 1).alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def is_kind(v: Column, path: str, kind: str) -> Column:
    """The value at ``path`` is of this JSON kind."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(kind)


def absent_or(v: Column, path: str, kind: str) -> Column:
    got = F.try_variant_get(v, path, "variant")
    return F.coalesce(got.isNull() | F.schema_of_variant(got).startswith(kind) | (F.schema_of_variant(got) == "VOID"), F.lit(True))


def parsed(lines: DataFrame) -> DataFrame:
    """Adds ``v``, dropping lines that are no JSON objects."""
    return lines.withColumn("v", F.try_parse_json("line")).where(F.schema_of_variant("v").startswith("OBJECT"))


def typed(lines: DataFrame) -> DataFrame:
    """Adds role and content of typed lines; a known field of a wrong kind drops the line."""
    v = F.col("v")
    ok = absent_or(v, "$.type", "STRING") & absent_or(v, "$.message", "OBJECT") & absent_or(v, "$.message.role", "STRING") & absent_or(v, "$.message.inputSource", "STRING")
    kind, inner = get(v, "$.type"), get(v, "$.message.role")
    roles = ("user", "assistant")
    role = F.coalesce(F.when(kind.isin(*roles), kind), F.when(inner.isin(*roles), inner))
    out = parsed(lines).where(ok).withColumn("role", role).where("role IS NOT NULL")
    content = F.try_variant_get(v, "$.message.content", "variant")
    return out.withColumn("plain", F.when(is_kind(v, "$.message.content", "STRING"), get(v, "$.message.content"))).withColumn("blocks", F.when(F.schema_of_variant(content).startswith("ARRAY"), F.try_variant_get(v, "$.message.content", BLOCKS))).withColumn("origin", get(v, "$.message.inputSource"))


def block_text(b: Column, *kinds: str) -> Column:
    """Text of a block of one of these kinds; null for any other."""
    right = get(b, "$.type").isin(*kinds) & is_kind(b, "$.type", "STRING") & is_kind(b, "$.text", "STRING")
    return F.when(right, get(b, "$.text"))


def texts_of(blocks: Column, *kinds: str) -> Column:
    return F.filter(F.transform(F.coalesce(blocks, F.array().cast(BLOCKS)), lambda b: block_text(b, *kinds)), lambda t: t.isNotNull() & ~blank(t))


def typed_prompts(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys…, line_no, seq, text): one row for each prompt text, untrimmed."""
    rows = typed(lines).where((F.col("role") == "user") & ~F.col("origin").eqNullSafe(F.lit("extension")))
    plain = F.when(F.col("plain").isNotNull() & ~blank(F.col("plain")), F.array("plain"))
    texts = F.coalesce(plain, texts_of(F.col("blocks"), "text"))
    return rows.select(*keys, "line_no", F.posexplode(texts).alias("seq", "t")).select(*keys, "line_no", "seq", F.concat(F.lit("User: "), "t").alias("text"))


def typed_answers(lines: DataFrame, *keys: str) -> DataFrame:
    """As prompts; answers are in lists of blocks only."""
    rows = typed(lines).where(F.col("role") == "assistant")
    return rows.select(*keys, "line_no", F.posexplode(texts_of(F.col("blocks"), "text")).alias("seq", "t")).select(*keys, "line_no", "seq", F.concat(F.lit("Assistant: "), "t").alias("text"))


def is_prelude(text: Column) -> Column:
    start, out = F.regexp_replace(text, r"(?U)^\s+", ""), F.lit(False)
    for p in PRELUDES:
        out = out | start.startswith(p)
    return out


def enveloped_messages(lines: DataFrame, role: str, *keys: str) -> DataFrame:
    """(keys…, line_no, seq, text): one row for each message, its trimmed blocks joined by newlines."""
    v = F.col("v")
    rows = parsed(lines).where((get(v, "$.type") == "response_item") & (get(v, "$.payload.type") == "message") & (get(v, "$.payload.role") == role))
    blocks = F.transform(texts_of(F.try_variant_get(v, "$.payload.content", BLOCKS), "input_text" if role == "user" else "output_text"), trim)
    label = "User: " if role == "user" else "Assistant: "
    out = rows.withColumn("t", F.array_join(blocks, "\n")).where("t != ''")
    if role == "user":
        out = out.where(~is_prelude(F.col("t")))
    return out.select(*keys, "line_no", F.lit(0).alias("seq"), F.concat(F.lit(label), "t").alias("text"))


def typed_turns(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys…, line_no, role, text, has_tool_use, tool_call_count, turn_index) of kept turns."""
    tools = F.size(F.filter(F.coalesce("blocks", F.array().cast(BLOCKS)), lambda b: F.coalesce(get(b, "$.type").isin("tool_use", "toolCall"), F.lit(False))))
    text = F.coalesce("plain", F.array_join(F.transform(texts_of(F.col("blocks"), "text"), trim), "\n"))
    rows = typed(lines).select(*keys, "line_no", "role", text.alias("text"), tools.cast("int").alias("tool_call_count"))
    return numbered(rows.withColumn("has_tool_use", F.col("tool_call_count") > 0), *keys)


def enveloped_turns(lines: DataFrame, *keys: str) -> DataFrame:
    """Messages and function calls; a call is an assistant's turn without text."""
    v = F.col("v")
    kind, content = get(v, "$.payload.type"), F.try_variant_get(v, "$.payload.content", "variant")
    rows = parsed(lines).where((get(v, "$.type") == "response_item") & kind.isin("message", "function_call"))
    plain = F.when(F.schema_of_variant(content).startswith("STRING"), trim(get(v, "$.payload.content")))
    blocks = F.array_join(F.transform(texts_of(F.try_variant_get(v, "$.payload.content", BLOCKS), "input_text", "output_text"), trim), "\n")
    call = kind == "function_call"
    rows = rows.select(*keys, "line_no", F.when(call, F.lit("assistant")).otherwise(get(v, "$.payload.role")).alias("role"), F.when(call, F.lit("")).otherwise(F.coalesce(plain, blocks)).alias("text"), call.alias("has_tool_use"), call.cast("int").alias("tool_call_count"))
    return numbered(rows.where(F.col("role").isin("user", "assistant")), *keys)


def numbered(turns: DataFrame, *keys: str) -> DataFrame:
    """Turns with text or tool use, with a dense index from 0."""
    from pyspark.sql import Window as W

    kept = turns.where("text != '' OR has_tool_use")
    order = W.partitionBy(*keys).orderBy("line_no")
    return kept.withColumn("turn_index", F.row_number().over(order) - 1)


def sniff(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys…, format): by the first line with a known type; files without one are left out."""
    v = F.col("v")
    kind = F.when(is_kind(v, "$.type", "STRING"), get(v, "$.type"))
    found = parsed(lines).withColumn("kind", kind).where(F.col("kind").isin("response_item", "session", "user", "assistant"))
    first = found.groupBy(*keys).agg(F.min_by("kind", "line_no").alias("kind"))
    return first.select(*keys, F.when(F.col("kind") == "response_item", F.lit("enveloped")).otherwise(F.lit("typed")).alias("format"))


def with_session_header(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys…): files whose first parsable line is a session header."""
    v = F.try_parse_json("line")
    first = lines.withColumn("v", v).where("v IS NOT NULL").groupBy(*keys).agg(F.min_by(F.coalesce(get(F.col("v"), "$.type"), F.lit("")), "line_no").alias("kind"))
    return first.where("kind = 'session'").select(*keys)
