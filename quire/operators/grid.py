"""Grids: tiles with overlap, weighted averages, patches, merged rectangles and components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from quire.catalog import register
from quire.plans.tables import PIXELS_SQL, load, pixels


def tile_starts(length: Column, tile: int, stride: int) -> Column:
    """Starts of tiles along an axis; a tile that would stick out is shifted back. Distinct, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), length - 1, F.lit(stride)), lambda y: F.greatest(F.least(y, length - tile), F.lit(0)))))


@register(
    "tile_grid",
    """WITH p AS (SELECT p_partkey, p_size * 20 AS h, CAST(p_partkey % 900 + 100 AS INTEGER) AS w FROM part),
ys AS (SELECT DISTINCT p_partkey, h, greatest(least(CAST(y AS INTEGER), h - 256), 0) AS y0 FROM p, LATERAL (SELECT unnest(range(0, h, 192)) AS y)),
xs AS (SELECT DISTINCT p_partkey, w, greatest(least(CAST(x AS INTEGER), w - 256), 0) AS x0 FROM p, LATERAL (SELECT unnest(range(0, w, 192)) AS x))
SELECT p_partkey, y0, x0, least(y0 + 256, h) AS y1, least(x0 + 256, w) AS x1 FROM ys JOIN xs USING (p_partkey)""",
)
def tile_grid(spark, sf_dir):
    """Rows times columns of every image by two explodes."""
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("h"), (F.col("p_partkey") % 900 + 100).cast("int").alias("w"))
    t = p.withColumn("y0", F.explode(tile_starts(F.col("h"), 256, 192))).withColumn("x0", F.explode(tile_starts(F.col("w"), 256, 192)))
    return t.select("p_partkey", "y0", "x0", F.least(F.col("y0") + 256, F.col("h")).alias("y1"), F.least(F.col("x0") + 256, F.col("w")).alias("x1"))


@register(
    "overlap_add",
    f"""WITH {PIXELS_SQL}, s AS (SELECT unnest([0, 3, 4]) AS o), t AS (SELECT a.o AS y0, b.o AS x0 FROM s a, s b),
c AS (SELECT vec_id, y0 + dy AS y, x0 + dx AS x, px[(y0 + dy) * 8 + x0 + dx + 1] + y0 AS v FROM px, t, range(4) AS q(dy), range(4) AS r(dx))
SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(v) / greatest(count(*), 1e-6), 6) AS value FROM c GROUP BY 1, 2, 3""",
)
def overlap_add(spark, sf_dir, tile: int = 4, stride: int = 3, side: int = 8):
    """Tiles' cells are summed where they overlap and divided by how many there are (a tile's values are shifted by its row to tell tiles apart)."""
    starts = tile_starts(F.lit(side), tile, stride)
    steps = F.sequence(F.lit(0), F.lit(tile - 1))
    t = pixels(spark, sf_dir).withColumn("y0", F.explode(starts)).withColumn("x0", F.explode(starts)).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    y, x = F.col("y0") + F.col("dy"), F.col("x0") + F.col("dx")
    cells = t.select("vec_id", y.alias("y"), x.alias("x"), (F.get("px", y * side + x) + F.col("y0")).alias("v"))
    return cells.groupBy("vec_id", "y", "x").agg(F.round(F.sum("v") / F.greatest(F.count("*"), F.lit(1e-6)), 6).alias("value"))


@register("crop_roundtrip", f"WITH {PIXELS_SQL} SELECT vec_id, array_to_string(px, ',') AS back FROM px")
def crop_roundtrip(spark, sf_dir, side: int = 8, patch: int = 3):
    """Cut in patches, filled up at the edge, and put together again by (patch, cell): the identity."""
    n = -(-side // patch)
    grid = F.sequence(F.lit(0), F.lit(n - 1))
    cell = F.sequence(F.lit(0), F.lit(patch - 1))
    t = pixels(spark, sf_dir).withColumn("i", F.explode(grid)).withColumn("j", F.explode(grid))
    at = lambda a, b: F.when((F.col("i") * patch + a < side) & (F.col("j") * patch + b < side), F.get("px", (F.col("i") * patch + a) * side + F.col("j") * patch + b)).otherwise(255)
    patches = t.select("vec_id", (F.col("i") * n + F.col("j")).alias("patch"), F.flatten(F.transform(cell, lambda a: F.transform(cell, lambda b: at(a, b)))).alias("data"))
    each = patches.select("vec_id", "patch", F.posexplode("data").alias("k", "v"))
    y, x = F.expr(f"patch DIV {n} * {patch} + k DIV {patch}"), F.expr(f"patch % {n} * {patch} + k % {patch}")
    back = each.select("vec_id", y.alias("y"), x.alias("x"), "v").where(f"y < {side} AND x < {side}")
    whole = F.array_sort(F.collect_list(F.struct("y", "x", "v")))  # of one image
    return back.groupBy("vec_id").agg(F.array_join(F.transform(whole, lambda c: c["v"].cast("string")), ",").alias("back"))


@register("reflect_pad", f"WITH {PIXELS_SQL} SELECT vec_id, array_to_string(list_transform(range(11), lambda i: px[CASE WHEN i < 8 THEN i + 1 ELSE 15 - i END]), ',') AS padded FROM px")
def reflect_pad(spark, sf_dir, side: int = 8, more: int = 3):
    at = lambda i: F.when(i < side, i).otherwise(2 * side - 2 - i).cast("int")
    row = F.transform(F.sequence(F.lit(0), F.lit(side + more - 1)), lambda i: F.get("px", at(i)).cast("string"))
    return pixels(spark, sf_dir).select("vec_id", F.array_join(row, ",").alias("padded"))


def merge_cells(modes: np.ndarray) -> list[tuple[int, int, int, int, str]]:
    """Greedy rectangles of equal cells in row order: as wide as the run goes, then down while whole rows match. Cells without a mode are left out."""
    height, width = modes.shape
    free = np.array([[m is not None for m in row] for row in modes])
    out = []
    for r, c in np.argwhere(free):
        if not free[r, c]:
            continue
        same = free & (modes == modes[r, c])
        stop = c
        while stop < width and same[r, stop]:
            stop += 1
        end = r + 1
        while end < height and same[end, c:stop].all():
            end += 1
        free[r:end, c:stop] = False
        out.append((int(r), int(c), int(end), int(stop), modes[r, c]))
    return out


@register("tile_merge")
def tile_merge(spark, sf_dir):
    """Cells of an 8 x 8 grid (dark: MONO, bright: HYBRID, else none) merged into rectangles."""

    @F.pandas_udf("array<struct<r0:int,c0:int,r1:int,c1:int,mode:string>>")
    def merge(px: pd.Series) -> pd.Series:
        def one(x):
            mode = np.array(["MONO" if v < 85 else "HYBRID" if v >= 170 else None for v in x], object).reshape(8, 8)
            return [dict(zip(("r0", "c0", "r1", "c1", "mode"), m, strict=True)) for m in merge_cells(mode)]

        return px.map(one)

    return pixels(spark, sf_dir).select("vec_id", F.inline(merge("px")))


def component_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of the 8-connected components of a boolean mask, by minimum labels that spread until they settle."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        wide = np.pad(np.where(mask, label, big), 1, constant_values=big)
        near = np.min([wide[1 + a : 1 + a + mask.shape[0], 1 + b : 1 + b + mask.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        new = np.where(mask, near, 0)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label[label > 0]):
        y, x = np.nonzero(label == k)
        out.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    return out


@register("bbox_components")
def bbox_components(spark, sf_dir, scale: int = 30, margin: int = 30):
    """Boxes of bright components, a pixel being scale wide: area over 2000, aspect between 0.3 and 3, widened by margin and clipped."""

    @F.pandas_udf("array<struct<x:int,y:int,w:int,h:int>>")
    def boxes(px: pd.Series) -> pd.Series:
        return px.map(lambda v: [dict(zip("xywh", b, strict=True)) for b in component_boxes(np.asarray(v).reshape(8, 8) >= 150)])

    b = pixels(spark, sf_dir).select("vec_id", F.inline(boxes("px"))).selectExpr("vec_id", *(f"{c} * {scale} AS {c}" for c in "xywh"))
    b = b.where("w * h > 2000 AND w / h > 0.3 AND w / h < 3.0")
    side = 8 * scale
    clip = lambda e, low: F.greatest(e, F.lit(0)) if low else F.least(e, F.lit(side))
    return b.select("vec_id", clip(F.col("x") - margin, True).alias("x0"), clip(F.col("y") - margin, True).alias("y0"), clip(F.expr("x + w") + margin, False).alias("x1"), clip(F.expr("y + h") + margin, False).alias("y1"))


@register(
    "sauvola",
    f"""WITH {PIXELS_SQL}, c AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, px[i + 1] AS v FROM px, range(64) AS q(i)),
w AS (SELECT a.vec_id, a.y, a.x, any_value(a.v) AS v, avg(b.v) AS m, stddev_pop(b.v) AS s FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3)
SELECT vec_id, CAST(sum(CASE WHEN v > round(m * (1 + 0.2 * (s / 128 - 1)), 9) THEN 255 ELSE 0 END) AS BIGINT) AS white, CAST(round(sum(0.3 * CASE WHEN v > round(m * (1 + 0.2 * (s / 128 - 1)), 9) THEN 255 ELSE 0 END + 0.7 * v), 4) AS DOUBLE) AS blended FROM w GROUP BY 1""",
)
def sauvola(spark, sf_dir, k: float = 0.2, alpha: float = 0.3):
    """Local threshold from the mean and deviation of a 3 x 3 window, then a blend with the gray value. Windows are made by explode, not by a join."""
    c = pixels(spark, sf_dir).select("vec_id", F.posexplode("px").alias("i", "v")).selectExpr("vec_id", "i DIV 8 AS y", "i % 8 AS x", "v")
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = c.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step)).selectExpr("vec_id", "y + dy AS y", "x + dx AS x", "v", "CASE WHEN dy = 0 AND dx = 0 THEN v END AS own")
    w = spread.groupBy("vec_id", "y", "x").agg(F.max("own").alias("v"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).where("v IS NOT NULL")
    white = F.when(F.col("v") > F.round(F.col("m") * (1 + k * (F.col("s") / 128 - 1)), 9), 255).otherwise(0)
    return w.groupBy("vec_id").agg(F.sum(white).alias("white"), F.round(F.sum(alpha * white + (1 - alpha) * F.col("v")), 4).alias("blended"))
