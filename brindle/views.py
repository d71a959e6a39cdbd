"""Derived inputs over the driver's tables: the same rules in Spark here and in SQL in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions import text as T
from .operators import history, kb
from .sources import transcripts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without system rows, with a dense index from 0."""
    rows = table(spark, sf_dir, "conversations").where("role != 'system'")
    doc = F.format_string("conv-%06d", "conv_id")
    order = W.partitionBy("conv_id").orderBy("turn")
    return rows.select(
        "conv_id", doc.alias("doc_id"), F.concat(F.lit("sessions/"), doc, F.lit(".jsonl")).alias("source_path"), "role", "text",
        (F.row_number().over(order) - 1).alias("turn_index"), (F.col("conv_id") % 7 == 3).alias("has_tool_use"),
        F.when((F.col("role") == "assistant") & (F.col("conv_id") % 7 == 3), 2).otherwise(0).alias("tool_call_count"),
    )


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, nodes): each conversation as JSON nodes of three levels: four exchanges, one, a turn."""
    order = W.partitionBy("doc_id").orderBy("turn_index").rowsBetween(W.unboundedPreceding, 0)
    rows = turns(spark, sf_dir).withColumn("g", F.sum((F.col("role") == "user").cast("int")).over(order)).withColumn("p", F.expr("g div 4"))

    def node(name, title, first, last, text, below):
        return F.struct(name.alias("node_id"), title.alias("title"), F.lit("").alias("summary"), F.format_string("turns:%d-%d", first, last).alias("source_locator"), first.cast("long").alias("start_turn"), last.cast("long").alias("end_turn"), text.alias("text"), below.alias("nodes"))

    def gathered(df, *keys):
        lists = F.array_sort(F.collect_list(F.struct("start", "node")))
        return df.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.transform(lists, lambda x: x["node"]).alias("nodes"))

    label = lambda c, x: F.concat(F.lit(x), F.col(c).cast("string"))
    start, end, nodes, none = F.col("start"), F.col("end"), F.col("nodes"), F.array().cast("array<string>")
    rows = rows.withColumn("start", F.col("turn_index")).withColumn("end", F.col("turn_index"))
    rows = rows.withColumn("node", node(label("turn_index", "t"), F.col("role"), start, end, F.col("text"), none))
    rows = gathered(rows, "doc_id", "p", "g").withColumn("node", node(label("g", "e"), F.lit("exchange"), start, end, F.lit(""), nodes))
    rows = gathered(rows, "doc_id", "p").withColumn("node", node(label("p", "p"), F.lit("part"), start, end, F.lit(""), nodes))
    return gathered(rows, "doc_id").select("doc_id", F.to_json("nodes").alias("nodes"))


def jsonl(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """(path, line_no, line): one JSON line for each turn; every eleventh is cut short."""
    t = turns(spark, sf_dir).withColumn("line_no", F.col("turn_index") + 1)
    ext = F.when((F.col("conv_id") % 5 == 1) & (F.col("role") == "user"), F.lit("extension"))
    blocks = F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.when(F.col("has_tool_use"), "tool_use").otherwise("image").alias("type"), F.lit("x").alias("text")))
    if dialect == "typed":
        body = F.when(F.col("turn_index") % 4 == 0, F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content"), ext.alias("inputSource")).alias("message"))))
        body = body.otherwise(F.to_json(F.struct(F.col("role").alias("type"), F.struct(blocks.alias("content"), ext.alias("inputSource")).alias("message"))))
    else:
        kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
        text = F.when((F.col("conv_id") % 6 == 2) & (F.col("turn_index") == 0), F.concat(F.lit("<environment_context>"), "text")).otherwise(F.col("text"))
        content = F.array(F.struct(kind.alias("type"), text.alias("text")))
        body = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", content.alias("content")).alias("payload")))
    cut = F.when(F.col("turn_index") % 11 == 7, F.left(body, F.length(body) - 3)).otherwise(body)
    return t.select(F.col("source_path").alias("path"), "line_no", cut.alias("line"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, source, path, session_id, line_no, seq, text) of prompts and answers."""
    t = turns(spark, sf_dir)
    user = F.col("role") == "user"
    return t.where(~T.blank(F.col("text"))).select(
        F.when(user, "prompt").otherwise("answer").alias("type"), F.when(F.col("conv_id") % 5 == 0, "archive").otherwise("session").alias("source"),
        F.col("source_path").alias("path"), F.col("doc_id").alias("session_id"), F.col("turn_index").alias("line_no"), F.lit(0).alias("seq"),
        F.concat(F.when(user, "User: ").otherwise("Assistant: "), "text").alias("text"),
    )


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.streams(messages(spark, sf_dir), "type", "source", "path", "session_id")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.identified(stream_rows(spark, sf_dir)).withColumnRenamed("chunk", "text")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First chunks, each with an embedding: that of its point id's leading digits, modulo their number.

    The table has fewer embeddings than there are chunks, so they repeat.
    """
    first = history.first_of_each(chunk_rows(spark, sf_dir))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    number = F.conv(F.substring("point_id", 1, 8), 16, 10).cast("long")
    return first.withColumn("vec_id", number % F.greatest(F.lit(1), F.lit(vectors.count()))).join(vectors, "vec_id")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files: some lines become headings or fences by their number."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    path = F.concat(F.when(number % 5 == 0, "archive/").otherwise(""), "source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    lines = transcripts.lines_of(d.select("doc_id", path.alias("path"), "text"), "doc_id", "path")
    n, line = F.col("line_no"), F.col("line")
    level = 1 + (F.col("doc_id") + n) % 3
    head = F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), F.left(line, F.lit(40)))
    made = F.when(n % 7 == 2, head).when(n % 11 == 5, F.lit("```")).otherwise(line)
    return lines.select("path", "line_no", made.alias("line"))


def kb_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.nodes(md_lines(spark, sf_dir))


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old and a new manifest: some paths added, removed, changed."""
    d = table(spark, sf_dir, "documents")
    base = d.select("doc_id", F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (F.col("doc_id") * 1000).alias("mtime_ns"), F.col("n_chars").alias("size"))
    old = base.where("doc_id % 10 != 3").drop("doc_id")
    new = base.where("doc_id % 10 != 4").withColumn("size", F.when(F.col("doc_id") % 10 == 5, F.col("size") + 1).otherwise(F.col("size"))).withColumn("mtime_ns", F.when(F.col("doc_id") % 10 == 6, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns"))).drop("doc_id")
    return old, new
