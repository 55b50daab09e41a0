"""Networks over tiles and patches: where they are cut, run in batches of a fixed shape, and put together again.

The networks themselves aren't there (no model files, no way to train them here); small functions of pixels stand in for
them, behind the same interface: a session by name and provider, kept by each worker.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.catalog import register
from quire.operators.grid import tile_starts
from quire.plans.control import provider
from quire.plans.tables import PIXELS_SQL, pixels

BATCH = 32
SIDE = 8
STEPS = 3
SIGMA = [1.0 - i / (STEPS + 1) for i in range(STEPS + 1)]  # noise left before each step, and at the end
ALPHA = [math.sqrt(1.0 - s * s) for s in SIGMA]


class Session:
    """A network and the provider it runs on. run() takes batches of BATCH inputs, the last one filled up, and drops the filling's outputs."""

    def __init__(self, function: Callable[[np.ndarray], np.ndarray], on: str):
        self.function, self.provider = function, on

    def run(self, x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), BATCH):
            part = x[at : at + BATCH]
            filled = np.concatenate([part, np.zeros((BATCH - len(part), *x.shape[1:]))]) if len(part) < BATCH else part
            out.append(self.function(filled)[: len(part)])
        return np.concatenate(out) if out else x


NETWORKS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mask": lambda x: 1 / (1 + np.exp(-(100 - x) / 16)),  # dark cells are marked
    "double": lambda x: np.repeat(np.repeat(x, 2, axis=-1), 2, axis=-2),
    "clean": lambda x: np.clip(0.8 * x, -1, 1),  # the data that a noisy input stands for
}


@cache
def session(name: str, available: tuple[str, ...] = ("CPU",)) -> Session:
    """One a worker and network, on the best provider there is."""
    return Session(NETWORKS[name], provider(available))


def through(rows: DataFrame, column: str, shape: tuple, name: str) -> DataFrame:
    """rows with column (an array for shape) replaced by the network's output, flattened; a batch of rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = session(name).run(np.stack(b[column].to_numpy()).astype(float).reshape(-1, *shape))
                yield b.assign(**{column: list(out.reshape(len(b), -1))})

    schema = ", ".join(f"{f.name} {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, schema)


def tiles(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """images(vec_id, px) -> (vec_id, y0, x0, data): tiles that overlap by tile - stride, row by row."""
    starts = tile_starts(F.lit(SIDE), tile, stride)
    t = images.withColumn("y0", F.explode(starts)).withColumn("x0", F.explode(starts))
    rows = F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda d: F.slice("px", (F.col("y0") + d) * SIDE + F.col("x0") + 1, tile))
    return t.select("vec_id", "y0", "x0", F.flatten(rows).alias("data"))


def added(found: DataFrame, width: int, scale: int = 1) -> DataFrame:
    """Tiles of width cells put together: (vec_id, y, x, v), the mean where they overlap."""
    each = found.select("vec_id", "y0", "x0", F.posexplode("data").alias("k", "v"))
    y, x = F.col("y0") * scale + F.expr(f"k DIV {width}"), F.col("x0") * scale + F.col("k") % width
    return each.groupBy("vec_id", y.alias("y"), x.alias("x")).agg((F.sum("v") / F.greatest(F.count("*"), F.lit(1e-6))).alias("v"))


@register(
    "watermark_boxes",
    f"""WITH {PIXELS_SQL}, c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, px[i + 1] AS p FROM (SELECT vec_id, px, unnest(range(64)) AS i FROM px))
SELECT vec_id, count(*) AS cells, CAST(greatest(min(x) - 1, 0) AS INTEGER) AS x0, CAST(greatest(min(y) - 1, 0) AS INTEGER) AS y0, CAST(least(max(x) + 2, 8) AS INTEGER) AS x1, CAST(least(max(y) + 2, 8) AS INTEGER) AS y1
FROM c WHERE p < 100 GROUP BY 1""",
)
def watermark_boxes(spark, sf_dir, margin: int = 1):
    """Tiles through the mask network, added up; the box of marked cells with a margin, cut at the image's edge."""
    mask = added(through(tiles(pixels(spark, sf_dir).select("vec_id", "px"), 4, 3), "data", (4, 4), "mask"), 4).where("v > 0.5 + 1e-9")
    low = lambda c: F.greatest(F.min(c) - margin, F.lit(0)).cast("int")
    high = lambda c: F.least(F.max(c) + 1 + margin, F.lit(SIDE)).cast("int")
    return mask.groupBy("vec_id").agg(F.count("*").alias("cells"), low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


@register(
    "upscale_tiles",
    f"""WITH {PIXELS_SQL}, c AS (SELECT vec_id, i, px[(i // 16 // 2) * 8 + (i % 16) // 2 + 1] AS p FROM (SELECT vec_id, px, unnest(range(256)) AS i FROM px))
SELECT vec_id, count(*) AS cells, CAST(sum(p * (i + 1)) AS BIGINT) AS checksum FROM c GROUP BY 1""",
)
def upscale_tiles(spark, sf_dir):
    """Tiles through a network that doubles their sides, put together at twice the size (as a checksum by place)."""
    big = added(through(tiles(pixels(spark, sf_dir).select("vec_id", "px"), 6, 2), "data", (6, 6), "double"), 12, 2)
    place = F.col("y") * (2 * SIDE) + F.col("x") + 1
    return big.groupBy("vec_id").agg(F.count("*").alias("cells"), F.sum(F.round(F.col("v") * place).cast("long")).alias("checksum"))


def denoise_sql() -> str:
    x = "(p / 127.5 - 1)"
    for i in range(STEPS):
        keep, new = SIGMA[i + 1] / SIGMA[i], ALPHA[i + 1] - ALPHA[i] * SIGMA[i + 1] / SIGMA[i]
        x = f"({keep!r}::DOUBLE * {x} + {new!r}::DOUBLE * least(greatest(0.8::DOUBLE * {x}, -1), 1))"
    return f"WITH {PIXELS_SQL}, c AS (SELECT vec_id, unnest(px) AS p FROM px) SELECT vec_id, count(*) AS cells, round(sum({x}), 5) AS total FROM c GROUP BY 1"


@register("denoise_patches", denoise_sql())
def denoise_patches(spark, sf_dir, patch: int = 4):
    """Patches of all pages in batches of one shape, through STEPS first-order steps from noise to data, and back to their pages."""
    noisy = tiles(pixels(spark, sf_dir).select("vec_id", "px"), patch, patch)
    noisy = noisy.withColumn("data", F.transform("data", lambda x: x / 127.5 - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["data"].to_numpy()).reshape(-1, patch, patch)
                for s, t in zip(range(STEPS), range(1, STEPS + 1), strict=True):
                    data = session("clean").run(x)
                    x = SIGMA[t] / SIGMA[s] * x + (ALPHA[t] - ALPHA[s] * SIGMA[t] / SIGMA[s]) * data
                yield b.assign(data=list(x.reshape(len(b), -1)))

    done = added(noisy.mapInPandas(run, noisy.schema), patch)
    return done.groupBy("vec_id").agg(F.count("*").alias("cells"), F.round(F.sum("v"), 5).alias("total"))
