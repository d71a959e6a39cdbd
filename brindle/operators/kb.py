"""Markdown sections and their deterministic lexical score."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T


def marked(lines: DataFrame) -> DataFrame:
    """Lines (path, line_no, line) with ``level`` > 0 at headings outside code fences."""
    order = W.partitionBy("path").orderBy("line_no")
    fence = T.is_fence(F.col("line"))
    inside = F.sum(fence.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) % 2 == 1
    head = ~fence & ~inside & T.is_heading(F.col("line"))
    return lines.withColumn("level", F.when(head, T.heading_level(F.col("line"))).otherwise(0))


def sections(lines: DataFrame) -> DataFrame:
    """(path, line_start, line_end, heading_path, text)

    A section runs from its heading to the line before the next one.  Text before the first
    heading is a section from its first line that is not blank, named by the file.  The heading
    path is a stack, cut by its length and not by levels.
    """
    order = W.partitionBy("path").orderBy("line_no")
    so_far = lambda x: F.sum(x.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = marked(lines).withColumns({"k": so_far(F.col("level") > 0), "filled": so_far(~T.blank(F.col("line")))})
    rows = rows.where("k > 0 OR filled > 0")
    body = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(body, lambda x: x["line"]), "\n")
    head = F.min_by(F.struct("level", "line"), "line_no")
    cut = rows.groupBy("path", "k").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_count"), head.alias("h"), text.alias("text"))
    cut = cut.withColumn("title", F.when(F.col("k") > 0, T.heading_title(F.col("h.line"))))
    # The stack is sequential within a file: a fold over its headings, which are few.  A file's
    # sections meet in one row, as its text does; nothing is shuffled or computed again for it.
    file = cut.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "line_start", F.col("h.level").alias("level"), "title", "text"))).alias("s"), F.max("line_count").alias("line_count"))
    empty = F.array().cast("array<string>")
    push = lambda s, h: F.concat(F.slice(s, 1, F.least(F.size(s), h["level"] - 1)), F.array(h["title"]))
    fold = F.aggregate(F.filter("s", lambda x: x["k"] > 0), F.struct(empty.alias("stack"), empty.alias("out")), lambda a, h: F.struct(push(a["stack"], h).alias("stack"), F.concat(a["out"], F.array(F.array_join(push(a["stack"], h), " > "))).alias("out")))
    rows = file.withColumn("names", fold["out"]).select("path", "s", "names", "line_count", F.posexplode("s").alias("n", "x"))
    line_end = F.coalesce(F.get("s", F.col("n") + 1)["line_start"] - 1, F.col("line_count"))
    name = F.when(F.col("x.k") > 0, F.get("names", (F.col("x.k") - 1).cast("int"))).otherwise(T.file_stem(F.col("path")))
    return rows.select("path", F.col("x.line_start").alias("line_start"), line_end.alias("line_end"), name.alias("heading_path"), T.trim_long(F.col("x.text")).alias("text"))


def nodes(lines: DataFrame) -> DataFrame:
    """(path, line_start, line_end, heading_path, normalized_body)"""
    first = F.substring_index("text", "\n", 1)
    rest = F.when(F.locate("\n", "text") > 0, F.substring("text", F.locate("\n", "text") + 1, F.length("text"))).otherwise(F.lit(""))
    body = T.collapse(F.when(T.is_heading(first), rest).otherwise(F.col("text")))
    return sections(lines).select("path", "line_start", "line_end", "heading_path", body.alias("normalized_body"))


def tokenized(node_rows: DataFrame) -> DataFrame:
    """Nodes with their tokens, so that queries do not tokenise again."""
    return node_rows.withColumns({"h_tok": T.tokens(F.col("heading_path")), "a_tok": T.tokens(F.col("path")), "b_tok": T.tokens(F.col("normalized_body"))})


def scored(node_rows: DataFrame, query: str) -> DataFrame:
    """Nodes that match, with ``matched`` and ``score``; tokens are made if they are missing."""
    phrase = T.python_tokens(query)
    terms = list(dict.fromkeys(phrase))
    if not terms:
        return tokenized(node_rows).where("false").withColumns({"matched": F.lit(0).cast("long"), "score": F.lit(0).cast("long")})
    rows = node_rows
    if "b_tok" not in rows.columns:
        # A text without any term as a substring has none as a token.  The generator keeps the
        # tokens from being made once more for each use.
        whole = F.lower(F.concat_ws("\n", "heading_path", "path", "normalized_body"))
        likely = rows.where(reduce(or_, [whole.contains(t) for t in terms]))
        names = ("h_tok", "a_tok", "b_tok")
        made = tokenized(likely)
        rows = made.select(*node_rows.columns, F.struct(*names).alias("_t")).select(*node_rows.columns, F.inline(F.array("_t")))
    h, a, b = F.col("h_tok"), F.col("a_tok"), F.col("b_tok")
    matched = sum(F.greatest(*[F.array_contains(x, t).cast("long") for x in (h, a, b)]) for t in terms)
    structure = sum(T.HEADING_WEIGHT * T.count_capped(h, t) + T.PATH_WEIGHT * T.count_capped(a, t) for t in terms)
    body = sum(T.BODY_WEIGHT * T.count_capped(b, t) for t in terms)
    divisor = F.greatest(F.lit(1), T.integer_sqrt(F.greatest(F.size(b), F.lit(1))))
    bonus = F.when(T.has_phrase(b, phrase), T.PHRASE_BONUS).otherwise(0)
    rows = rows.withColumn("matched", matched).where("matched > 0")
    per_length = F.expr("body_part div divisor")
    score = F.col("matched") * T.stride(len(terms)) + structure * T.SCALE + per_length + bonus
    return rows.withColumn("body_part", body * T.SCALE).withColumn("divisor", divisor).withColumn("score", score.cast("long")).drop("body_part", "divisor")


def ranked(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The fullest matches, archives only if nothing else is as full, one section for each path.

    A score ranks by fullness first, so a path's best section is its fullest, and the top rows
    hold all that may be kept: one pass, and the last filter sees ``limit`` rows.
    """
    shaped = rows.select(
        F.col("path").alias("doc_id"), "path", F.col("heading_path").alias("heading"), F.col("normalized_body").alias("text"), "score",
        F.concat_ws("-", "line_start", "line_end").alias("node_id"), F.element_at(F.split("heading_path", " > "), -1).alias("title"),
        F.concat(F.lit("matched deterministic text index; score "), F.col("score").cast("string")).alias("reason"),
        F.struct("matched", (~T.is_archive(F.col("path"))).alias("live")).alias("tier"),
    )
    one = W.partitionBy("path").orderBy(F.desc("score"), "heading", "node_id")
    shaped = shaped.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    top = shaped.orderBy(F.desc("tier"), F.desc("score"), "path", "heading", "node_id").limit(limit)
    best = top.withColumn("_best", F.max("tier").over(W.partitionBy())).where(F.col("tier") == F.col("_best"))
    return best.drop("tier", "_best").orderBy(F.desc("score"), "path", "heading", "node_id")


def search(node_rows: DataFrame, query: str, limit: int = 5) -> DataFrame:
    return ranked(scored(node_rows, query), limit if T.python_tokens(query) else 0)


def with_source_text(results: DataFrame, lines: DataFrame) -> DataFrame:
    """Results whose text is the exact source lines of their range.

    The results of a search are as few as its limit, so they are broadcast to the lines.
    """
    span = F.split("node_id", "-")
    r = results.drop("text").withColumn("_a", span[0].cast("int")).withColumn("_b", span[1].cast("int"))
    kept = [c for c in r.columns if c not in ("_a", "_b")]
    own = lines.withColumnRenamed("path", "_path").join(F.broadcast(r), (F.col("_path") == F.col("path")) & F.col("line_no").between(F.col("_a"), F.col("_b")))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return own.groupBy(*kept).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of manifests (path, mtime_ns, size) that differ; stale if any row is left."""
    both = old.alias("o").join(new.alias("n"), "path", "full_outer")
    status = F.when(F.col("o.size").isNull(), "added").when(F.col("n.size").isNull(), "removed").when((F.col("o.size") != F.col("n.size")) | (F.col("o.mtime_ns") != F.col("n.mtime_ns")), "changed")
    return both.select("path", status.alias("status")).where("status IS NOT NULL")
