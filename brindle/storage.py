"""The folder that all machines share, for tables of a job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only where a local session has none, a folder of our own is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_shuffles(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
