"""Written tables in the folder that driver and executors share: where iterative operators cut their lineage."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or, only where that is unset and the master is local, a local folder."""
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
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a Parquet table: the new rows are written beside it, the old table is renamed away, the new one renamed
    in, and the old one deleted last, so that either is whole at any time. A failed rename puts the old table back."""
    spark = df.sparkSession
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    run = uuid.uuid4().hex
    beside, away, here = to(f"{path}.{run}"), to(f"{path}.old-{run}"), to(path)
    df.write.parquet(beside.toString())
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(here)
    if had and not fs.rename(here, away):
        raise OSError(f"{path} cannot be renamed")
    if not fs.rename(beside, here):
        if had:
            fs.rename(away, here)
        raise OSError(f"{beside} cannot be renamed to {path}")
    if had:
        fs.delete(away, True)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replaces only the partitions of key that df has rows of; the others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(key).parquet(path)


def csv_report(df: DataFrame, path: str) -> None:
    """A report for spreadsheets: semicolons, a header, and a byte-order mark before the first column's name."""
    first, *rest = df.columns
    df.select(df[first].alias("﻿" + first), *rest).write.mode("overwrite").option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)
