"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on a local master."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_RECORDS: list[list[str]] = []


def new_folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/quire-{what}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are named meanwhile, in order."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


def spill(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; survives lost executors and keeps columns prunable."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this package, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
