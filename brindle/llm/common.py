"""What several operators share: the shared folder, cutting lineage, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none (tests, a single machine) a folder of our own is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: later stages start from files that survive a lost executor,
    and later joins get exchanges of their own, which adaptive execution can split.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing that will still run reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of finished steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def give_back() -> None:
    """Return what a Python worker has freed to the system: Spark keeps idle workers."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batches(it, fn, schema: pa.Schema, rows: int = 512, size: int = 16 << 20):
    """Apply ``fn(columns: dict of lists) -> dict of lists`` to slices of Arrow batches.

    A slice has ``rows`` rows and about ``size`` bytes at most.
    """
    for batch in it:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
            yield pa.RecordBatch.from_pydict(out, schema=schema)
    give_back()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def sized_words(col) -> F.Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")
