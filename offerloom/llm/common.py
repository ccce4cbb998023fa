"""Shared pieces of the corpus operators: the shared folder, written tables, and small column helpers."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where that is unset, on a local master) a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _local()).rstrip("/")


@functools.cache
def _local() -> str:
    """For sessions without a shared folder, which are local ones: a temporary folder, removed when the driver ends."""
    folder = tempfile.mkdtemp(prefix="offerloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/offerloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and an executor's loss costs no more than one stage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean_batches(spark: SparkSession) -> None:
    """Fewer rows of whole texts in each batch that goes to Python, unless the session has set a number of its own.

    The plans are lazy, so this holds for the session from then on; a number set by the user, even the default one, stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc32_text(doc_id: object) -> int:
    """crc32 of an id's decimal text, the fold rule of the labelled operators (null: 0)."""
    return 0 if doc_id is None else zlib.crc32(str(int(doc_id)).encode())


def id_fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts
