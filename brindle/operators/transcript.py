"""Transcript outline: exchanges, documents, content, substring query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T


def rendered():
    role = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    tool_only = T.blank(F.col("text")) & (F.col("tool_call_count") > 0)
    body = F.when(tool_only, F.concat(F.lit("<"), F.col("tool_call_count").cast("string"), F.lit(" tool call(s)>"))).otherwise(F.col("text"))
    return F.concat(role, F.lit(": "), body)


def joined(order: str = "turn_index"):
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), rendered().alias("r"))))
    return F.array_join(F.transform(parts, lambda p: p["r"]), "\n\n")


def nodes(turns: DataFrame) -> DataFrame:
    """(doc_id, node_id, title, summary, source_locator, start_turn, end_turn, text)

    A node starts at the first turn and at every user turn after it.
    """
    order = W.partitionBy("doc_id").orderBy("turn_index")
    group = F.sum((F.col("role") == "user").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = turns.withColumn("g", group)
    full = ~T.blank(F.col("text"))
    user, other = F.col("role") == "user", F.col("role") != "user"
    cut = rows.groupBy("doc_id", "g").agg(
        F.min("turn_index").alias("start_turn"), F.max("turn_index").alias("end_turn"), T.title(F.min_by("text", "turn_index")).alias("title"),
        F.count_if(user & full).alias("u"), F.count_if(other & full).alias("a"), F.sum(F.when(other, F.col("tool_call_count")).otherwise(0)).alias("t"), joined().alias("text"),
    )
    say = lambda c, what: F.concat(F.col(c).cast("string"), F.lit(what))
    summary = F.concat_ws(", ", say("u", " user text turn(s)"), say("a", " assistant text turn(s)"), F.when(F.col("t") > 0, say("t", " tool call(s)")))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("g"))
    return cut.select("doc_id", F.format_string("%06d", number).alias("node_id"), "title", summary.alias("summary"), F.format_string("turns:%d-%d", "start_turn", "end_turn").alias("source_locator"), "start_turn", "end_turn", "text")


def documents(turns: DataFrame) -> DataFrame:
    """(doc_id, doc_name, doc_description, source_family, source_path, turn_count, text)"""
    by = turns.groupBy("doc_id").agg(F.min("source_path").alias("source_path"), F.count("*").alias("turn_count"), T.title(F.min_by("text", "turn_index")).alias("doc_description"), joined().alias("text"))
    return by.select("doc_id", F.col("doc_id").alias("doc_name"), "doc_description", F.lit("transcript").alias("source_family"), "source_path", "turn_count", "text")


def metadata(docs: DataFrame) -> DataFrame:
    return docs.drop("text")


def structure(node_rows: DataFrame) -> DataFrame:
    """(doc_id, nodes): the nodes of a document in order, without text."""
    parts = F.struct("node_id", "title", "summary", "source_locator", "start_turn", "end_turn")
    return node_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(parts)).alias("nodes"))


def outline(docs: DataFrame, node_rows: DataFrame) -> DataFrame:
    line = F.format_string("%s. %s [%d-%d] — %s", "node_id", "title", "start_turn", "end_turn", "summary")
    lines = node_rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return docs.join(lines, "doc_id").select("doc_id", F.concat("doc_id", F.lit(" — "), "doc_name", F.lit("\n"), "lines").alias("outline"))


def content_of_node(node_rows: DataFrame, node_id: str) -> DataFrame:
    return node_rows.where(F.col("node_id") == node_id).select("doc_id", T.ensure_newline(F.col("text")).alias("content"))


def content_of_turns(docs: DataFrame, first: int, last: int) -> DataFrame:
    """Turns by position in the rendered text, so a blank line inside a turn counts as a border."""
    parts = F.split("text", "\n\n", -1)
    stop = F.least(F.lit(last), F.size(parts) - 1)
    text = F.array_join(F.slice(parts, first + 1, stop - first + 1), "\n\n")
    return docs.where(F.size(parts) > first).select("doc_id", T.ensure_newline(text).alias("content"))


def content(docs: DataFrame, node_rows: DataFrame, doc_id: str, locator: str) -> str:
    """Text of a node, else of an inclusive turn range; anything else raises."""
    own = node_rows.where(F.col("doc_id") == doc_id)
    if got := content_of_node(own, locator).first():
        return got["content"]
    if (span := T.turn_range(locator)) is None:
        raise ValueError(f"locator must be a node id or inclusive turn range like 4-8: {locator}")
    if got := content_of_turns(docs.where(F.col("doc_id") == doc_id), *span).first():
        return got["content"]
    raise ValueError(f"turn range starts after end of transcript: {doc_id}")


def searched():
    """What a query looks for its terms in."""
    return F.lower(F.concat_ws("\n", "doc_id", "title", "summary", "text"))


def query(docs: DataFrame, node_rows: DataFrame, text: str, limit: int = 5, command: str = "brindle transcript content") -> DataFrame:
    """Nodes by ten points for each query term, repeats included, that they hold as a substring."""
    terms = T.query_terms(text)
    asked = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hits = node_rows.withColumn("s", searched()).withColumn("hits", F.filter(asked, lambda t: F.contains(F.col("s"), t))).where(F.size("hits") > 0)
    best = hits.select("doc_id", "node_id", "title", "hits", (F.size("hits") * 10).cast("long").alias("score")).orderBy(F.desc("score"), "doc_id", "node_id").limit(limit if terms else 0)
    # Only the results meet the documents: they are as few as the limit.
    out = docs.select("doc_id", "source_path").join(F.broadcast(best), "doc_id").select("doc_id", "source_path", "node_id", "title", "score", F.concat(F.lit("matched query terms: "), F.array_join("hits", ", ")).alias("reason"), F.concat(F.lit(f"{command} "), "doc_id", F.lit(" "), "node_id").alias("next_content_command"))
    return out.orderBy(F.desc("score"), "doc_id", "node_id")
