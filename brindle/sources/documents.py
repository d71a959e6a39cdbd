"""One JSON file for each transcript document, written with a commit and read back.

A task writes its files to a folder of the job; only the commit on the driver moves them to their
names, so a failed or repeated task leaves nothing behind.  Files are indented JSON.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import sanitize
from ..operators import tree

NAME = "brindle_documents"
#: Fields of a document; ``doc_description`` may be null, no other may.
FIELDS = (("doc_id", "string"), ("doc_name", "string"), ("doc_description", "string"), ("source_family", "string"), ("source_path", "string"), ("turn_count", "long"), ("text", "string"))
OPTIONAL = ("doc_description",)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class DocumentWriter(DataSourceWriter):
    """Rows (name, json) as files <name>.json of a local or mounted folder."""

    def __init__(self, path: str):
        self.path = path
        self.stage = os.path.join(path, f".stage-{uuid.uuid4().hex}")

    def write(self, rows) -> Written:
        folder, names = os.path.join(self.stage, uuid.uuid4().hex), []
        os.makedirs(folder)
        for row in rows:
            name = f"{row['name']}.json"
            with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                json.dump(json.loads(row["json"]), f, indent=2, ensure_ascii=False)
            names.append(name)
        return Written(folder, names)

    def commit(self, messages) -> None:
        for m in messages:
            for name in m.names if m else ():
                os.replace(os.path.join(m.folder, name), os.path.join(self.path, name))
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, json string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write(docs: DataFrame, flat: DataFrame, folder: str) -> None:
    """Files of documents (FIELDS) and their nodes (rows of ``tree``).

    Of documents with one sanitised id the last source path stays; files of other documents stay.
    """
    spark = docs.sparkSession
    spark.dataSource.register(DocumentSink)
    names = [n for n, _ in FIELDS]
    last = docs.withColumn("name", sanitize(F.col("doc_id"))).groupBy("name").agg(F.max_by(F.struct(*names), F.struct(F.split("source_path", "/"), "doc_id")).alias("d")).select("name", "d.*")
    trees = tree.nested(flat, tuple(f for f, _ in tree.FIELDS))
    rows = last.join(trees, "doc_id", "left")
    # Null fields stay as nulls; the list of nodes is JSON already.
    head = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    whole = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"nodes":'), F.coalesce("nodes", F.lit("[]")), F.lit("}"))
    os.makedirs(folder, exist_ok=True)
    rows.withColumn("head", head).select("name", whole.alias("json")).write.format(NAME).mode("append").option("path", folder).save()


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rows of ``tree``) of the files *.json right below a folder, in order of their names.

    A missing folder has none; a file that is no JSON, or lacks a field, raises and is named.
    """
    found = sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []
    found = [p for p in found if os.path.isfile(p)]
    listed = spark.createDataFrame([(k, p) for k, p in enumerate(found)], "file_no long, file string")
    if len(found) > 1:
        listed = listed.repartition(min(len(found), 4 * spark.sparkContext.defaultParallelism), "file_no")

    def load(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                with open(batch.column(1)[k].as_py(), "rb") as f:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([f.read()], pa.binary())], names=["file_no", "file", "content"])

    raw = listed.mapInArrow(load, "file_no long, file string, content binary")
    value = F.try_parse_json(F.decode("content", "UTF-8"))
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} in "), F.col("file")))
    docs = raw.withColumn("v", F.coalesce(value, fail("no JSON").cast("variant"))).drop("content")

    def of(name: str, kind: str) -> Column:
        got = F.try_variant_get("v", f"$.{name}", kind)
        return (got if name in OPTIONAL else F.coalesce(got, fail(f"no {name}").cast(kind))).alias(name)

    columns = [of(n, t) for n, t in FIELDS]
    own = F.try_variant_get("v", "$.nodes", "variant")
    nodes = F.when(F.coalesce(F.schema_of_variant(own).startswith("ARRAY"), F.lit(False)), F.to_json(own)).otherwise(fail("no nodes").cast("string")).alias("nodes")
    docs = docs.select("file_no", *columns, nodes)
    return docs.drop("nodes", "file_no"), tree.flatten(docs)
