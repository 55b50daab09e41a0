"""A filter of bounded size that says which rows may be in a table, so that all others need no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import alone, ship

FILTER_BITS = 1 << 25  # 4 MB at most, whatever the table's size

ONE = np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Two bits of a filter of size bits for each row, from its two longs."""
    with np.errstate(over="ignore"):
        h = mixed(a.view(np.uint64) + mixed(b.view(np.uint64) * BASE + ONE))
    return np.stack([h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)]).astype(np.int64)


def filter_of(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of rows of two longs (null counts as 0), 16 bits an entry and FILTER_BITS at most, as words of 32 bits.

    Too full a filter lets other rows pass; what comes behind it has to look at whole rows.
    """
    ship(rows.sparkSession)
    size = int(min(FILTER_BITS, 1 << max(16, (16 * rows.count()).bit_length())))

    def run(batches):
        alone("bloom")
        for batch in batches:
            at = np.unique(places(*map(longs, batch.columns), size))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["word", "bit"])

    words = rows.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 5, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def longs(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def in_filter(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row whether it may be in the table; true for all that are."""
    at = places(a, b, len(words) << 5)
    return ((words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)).all(axis=0)


def maybe_in(rows: DataFrame, a: Column, b: Column) -> Column:
    """in_filter(a, b) by the filter of rows, as a column."""
    known = rows.sparkSession.sparkContext.broadcast(filter_of(rows))

    def look(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(in_filter(known.value, longs(x), longs(y)).astype(bool))

    return F.arrow_udf(look, "boolean")(a, b)
