"""What the operators of this subpackage share: tables, cuts of lineage, shipping of the code."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.plans.shared import new_folder as new_folder, shared_dir as shared_dir, spill as spill
from quire.plans.ship import ship as ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the fixtures; one whose files give less work than there are cores, such as a single small file, is dealt anew."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def least(hashed: Column, wanted: int, total: int) -> Column:
    """Whether a row's hash is among the smallest, about 4 * wanted of total distinct ones.

    An order by the hash with limit(wanted) takes the same rows behind this filter as without it, but then the driver
    gets some 4 * wanted rows from all tasks together, not wanted rows from each of them.
    """
    most = -(1 << 63) + ((4 * wanted) << 64) // max(total, 1)
    return hashed <= F.lit(min(most, (1 << 63) - 1))


_HELD: dict[str, Callable[[], object]] = {}


def alone(name: str, let_go: Callable[[], object] | None = None) -> None:
    """Called by a kernel as it begins: what the kernels of other operators keep in this worker goes, and freed memory goes back to the system.

    Workers outlive stages, so else the caches of all operators of a pipeline add up. let_go empties name's own caches when its turn comes.
    """
    others = [_HELD.pop(x) for x in [*_HELD] if x != name]
    for forget in others:
        forget()
    if others:
        gc.collect()
    if let_go:
        _HELD[name] = let_go
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of the GNU library alone
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most most_bytes of text (one row at least), so a worker's memory doesn't follow the batch size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(column)
        total = texts.nbytes
        step = max(1, n * most_bytes // max(total, 1))
        for at in range(0, n, step):
            yield batch.slice(at, min(step, n - at))
