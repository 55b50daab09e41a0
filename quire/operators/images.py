"""Images: masks, boxes, placement, sharpening, presets, routes of encoding and one-bit files."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.catalog import register
from quire.plans.tables import PIXELS_SQL, load, pixels


@register(
    "soft_mask",
    f"""WITH {PIXELS_SQL}, m AS (SELECT vec_id, px, CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN list_transform(px, lambda x: 255) ELSE px END AS mask, vec_id % 7 = 0 AS hard FROM px)
SELECT vec_id, NOT hard AND (mask IS NULL OR list_min(mask) = 255) AS accepted, CAST(list_sum(px) + CASE WHEN NOT hard AND list_min(mask) = 255 THEN len(mask) ELSE 0 END AS BIGINT) AS old_size FROM m""",
)
def soft_mask(spark, sf_dir):
    """An image with a hard mask goes; a soft mask that is all 255 is removed and its length counts as old size; any other soft mask bars the image."""
    mask = F.when(F.col("vec_id") % 4 == 0, None).when(F.col("vec_id") % 4 == 1, F.transform("px", lambda x: F.lit(255))).otherwise(F.col("px"))
    m = pixels(spark, sf_dir).withColumn("mask", mask).withColumn("hard", F.col("vec_id") % 7 == 0)
    trivial = F.coalesce(F.forall("mask", lambda x: x == 255), F.lit(False))
    size = F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x) + F.when(~F.col("hard") & trivial, F.size("mask")).otherwise(0)
    return m.select("vec_id", (~F.col("hard") & (F.col("mask").isNull() | trivial)).alias("accepted"), size.alias("old_size"))


BOX_SQL = "b AS (SELECT DISTINCT l_orderkey AS page, CAST(l_partkey * 7 % 600 AS INTEGER) AS x, CAST(l_suppkey * 13 % 800 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) * 4 AS w, l_linenumber * 40 AS h FROM lineitem)"


def boxes(spark, sf_dir):
    """(page, x, y, w, h) on pages of 612 by 792, made from lines."""
    return load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "CAST(l_partkey * 7 % 600 AS INT) AS x", "CAST(l_suppkey * 13 % 800 AS INT) AS y", "CAST(l_quantity AS INT) * 4 AS w", "l_linenumber * 40 AS h").distinct()


@register("qr_boxes", f"WITH {BOX_SQL} SELECT * FROM b WHERE w * 1.0 / h > 0.5 AND w * 1.0 / h < 2.0 AND x > 306 AND y > 396 AND w * h > 2000")
def qr_boxes(spark, sf_dir):
    """Nearly square boxes in the lower right quarter."""
    return boxes(spark, sf_dir).where("w / h > 0.5 AND w / h < 2.0 AND x > 306 AND y > 396 AND w * h > 2000")


@register(
    "tile_rects",
    f"WITH {BOX_SQL}, s AS (SELECT *, 400 / 2048.0::DOUBLE AS sx, 500 / 3072.0::DOUBLE AS sy FROM b) SELECT page, x, y, w, h, round(30 + x * sx, 6) AS x0, round(40 + y * sy, 6) AS y0, round(30 + x * sx + w * sx, 6) AS x1, round(40 + y * sy + h * sy, 6) AS y1 FROM s",
)
def tile_rects(spark, sf_dir, left: float = 30, top: float = 40, right: float = 430, bottom: float = 540, width: int = 2048, height: int = 3072):
    """Pixel rectangles of an image of width by height placed in the page's rectangle."""
    sx, sy = (right - left) / width, (bottom - top) / height
    edge = lambda low, at, s: F.round(low + at * s, 6)
    x, y, w, h = map(F.col, "xywh")
    return boxes(spark, sf_dir).select("page", "x", "y", "w", "h", edge(left, x, sx).alias("x0"), edge(top, y, sy).alias("y0"), F.round(left + x * sx + w * sx, 6).alias("x1"), F.round(top + y * sy + h * sy, 6).alias("y1"))


@register("page_range", "SELECT l_orderkey AS page, count(*) AS lines FROM lineitem WHERE l_orderkey BETWEEN 0 AND (SELECT count(*) FROM orders) - 1 GROUP BY 1")
def page_range(spark, sf_dir):
    """Only pages whose number lies in the document."""
    pages = load(spark, sf_dir, "orders").agg(F.count("*").alias("n"))  # one row
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"))
    return lines.join(F.broadcast(pages), F.expr("page >= 0 AND page < n")).groupBy("page").agg(F.count("*").alias("lines"))


@register(
    "protection_blend",
    f"""WITH {PIXELS_SQL}, c AS (SELECT vec_id, px, unnest(range(64)) AS i FROM px),
m AS (SELECT vec_id, px[i + 1] AS v, CASE WHEN i // 8 BETWEEN 2 AND 4 AND i % 8 BETWEEN vec_id % 4 AND vec_id % 4 + 2 THEN 0 ELSE 1 END AS m FROM c)
SELECT vec_id, CAST(sum(m) AS BIGINT) AS open_cells, CAST(sum(m * (255 - v) + (1 - m) * v) AS BIGINT) AS blended FROM m GROUP BY 1""",
)
def protection_blend(spark, sf_dir):
    """A mask that is 0 in protected boxes blends the enhanced image (here the inverse) with the original."""
    c = pixels(spark, sf_dir).select("vec_id", F.posexplode("px").alias("i", "v"))
    m = F.expr("CASE WHEN i DIV 8 BETWEEN 2 AND 4 AND i % 8 BETWEEN vec_id % 4 AND vec_id % 4 + 2 THEN 0 ELSE 1 END")
    mixed = F.col("m") * (255 - F.col("v")) + (1 - F.col("m")) * F.col("v")
    return c.withColumn("m", m).groupBy("vec_id").agg(F.sum("m").alias("open_cells"), F.sum(mixed).alias("blended"))


SIDE, SPREAD = 8, 1.5
REACH = 5  # a kernel of 11 for this spread
KERNEL = [math.exp(-(k * k) / (2 * SPREAD * SPREAD)) for k in range(-REACH, REACH + 1)]
KERNEL = [w / sum(KERNEL) for w in KERNEL]


def mirror(i: int, n: int) -> int:
    """An index beyond an edge, reflected without repeating the edge."""
    i = abs(i) % (2 * n - 2)
    return min(i, 2 * n - 2 - i)


BLUR = [[sum(w for k, w in zip(range(-REACH, REACH + 1), KERNEL, strict=True) if mirror(at + k, SIDE) == to) for to in range(SIDE)] for at in range(SIDE)]


def unsharp(px: list[int], amount: float) -> list[int]:
    """One image, in plain numpy: original + amount * (original - blurred), halves up, cut to 0..255."""
    x, b = np.array(px, float).reshape(SIDE, SIDE), np.array(BLUR)
    blurred = np.floor(np.round(b @ x @ b.T, 6) + 0.5)
    return np.clip(np.floor(np.round(x + amount * (x - blurred), 6) + 0.5), 0, 255).astype(int).ravel().tolist()


BLUR_SQL = ", ".join(f"({y}, {v}, {w!r}::DOUBLE)" for y, row in enumerate(BLUR) for v, w in enumerate(row))


@register(
    "unsharp",
    f"""WITH {PIXELS_SQL}, k(y, v, w) AS (VALUES {BLUR_SQL}), c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, px[i + 1] AS p FROM (SELECT vec_id, px, unnest(range(64)) AS i FROM px)),
h AS (SELECT vec_id, c.y, k.y AS x, sum(p * w) AS s FROM c JOIN k ON k.v = c.x GROUP BY 1, 2, 3), b AS (SELECT vec_id, k.y AS y, x, floor(round(sum(s * w), 6) + 0.5) AS blurred FROM h JOIN k ON k.v = h.y GROUP BY 1, 2, 3)
SELECT vec_id, CAST(sum(least(greatest(floor(round(p + 0.3::DOUBLE * (p - blurred), 6) + 0.5), 0), 255) * (y * 8 + x + 1)) AS BIGINT) AS checksum FROM c JOIN b USING (vec_id, y, x) GROUP BY 1""",
)
def unsharp_mask(spark, sf_dir, amount: float = 0.3):
    """Unsharp masking by a separable Gaussian whose edge reflections are folded into an 8 x 8 matrix; no shuffle, a fold a pixel."""
    ks = F.array(*(F.array(*map(F.lit, row)) for row in BLUR))
    line = F.sequence(F.lit(0), F.lit(SIDE - 1))
    dot = lambda at, value: F.aggregate(line, F.lit(0.0), lambda s, v: s + F.get(F.get(ks, at), v) * value(v))
    p = pixels(spark, sf_dir)
    p = p.withColumn("h", F.flatten(F.transform(line, lambda y: F.transform(line, lambda x: dot(x, lambda v: F.get("px", y * SIDE + v))))))
    p = p.withColumn("b", F.flatten(F.transform(line, lambda y: F.transform(line, lambda x: F.floor(F.round(dot(y, lambda v: F.get("h", v * SIDE + x)), 6) + 0.5)))))
    sharp = F.zip_with("px", "b", lambda x, b: F.least(F.greatest(F.floor(F.round(x + amount * (x - b), 6) + 0.5), F.lit(0)), F.lit(255)))
    sums = F.aggregate(F.transform(sharp, lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return p.select("vec_id", sums.alias("checksum"))


# fixed values: mode, contrast, brightness that the background should have
PRESETS = (("strong", 1.15, 245), ("standard", 1.1, 242), ("mild", 1.05, 240))


@register(
    "enhance_presets",
    f"""WITH {PIXELS_SQL}, s(mode, alpha, target) AS (VALUES {", ".join(f"('{m}', {a!r}::DOUBLE, {t})" for m, a, t in PRESETS)}),
q AS (SELECT vec_id, px, quantile_cont(x, 0.7) AS p70 FROM (SELECT vec_id, px, unnest(px) AS x FROM px) GROUP BY ALL), g AS (SELECT vec_id, px, list_avg(list_filter(px, lambda x: x > p70)) AS background FROM q)
SELECT vec_id, mode, coalesce(background < target, false) AS brighten, CAST(list_sum(list_transform(px, lambda x: least(floor(round(x * alpha, 6) + 0.5), 255))) AS BIGINT) AS total FROM g, s""",
)
def enhance_presets(spark, sf_dir):
    """Every image under every preset: whether its background is too dark, and the sum after the contrast."""
    table = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(a).alias("alpha"), F.lit(t).alias("target")) for m, a, t in PRESETS))
    s = F.array_sort("px")
    at, n = 0.7 * (F.size("px") - 1), F.size("px")
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.least(F.floor(at).cast("int") + 1, n - 1))
    p = pixels(spark, sf_dir).withColumn("p70", low + (at - F.floor(at)) * (high - low))
    p = p.withColumn("bright", F.filter("px", lambda x: x > F.col("p70"))).withColumn("sum", F.aggregate("bright", F.lit(0), lambda a, x: a + x))
    p = p.withColumn("background", F.when(F.size("bright") > 0, F.col("sum") / F.size("bright"))).select("vec_id", "px", "background", F.inline(table))
    scaled = F.transform("px", lambda x: F.least(F.floor(F.round(x * F.col("alpha"), 6) + 0.5), F.lit(255)))
    return p.select("vec_id", "mode", F.coalesce(F.col("background") < F.col("target"), F.lit(False)).alias("brighten"), F.aggregate(scaled, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register(
    "encode_route",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'CMYK' WHEN page_id % 3 = 0 AND strlen(html) < 4096 THEN 'MONO' ELSE 'JP2' END AS route,
page_id % 5 = 0 AND page_id % 2 = 0 AS invert, page_id % 5 != 0 AND NOT (page_id % 3 = 0 AND strlen(html) < 4096) AND page_id % 7 != 0 AS mct FROM pages""",
)
def encode_route(spark, sf_dir):
    """Which encoder an image takes; four inks are inverted only if they come from a DCT stream, and the colour transform is for three channels."""
    ink, mono = F.col("page_id") % 5 == 0, (F.col("page_id") % 3 == 0) & (F.octet_length("html") < 4096)
    route = F.when(ink, "CMYK").when(mono, "MONO").otherwise("JP2")
    gray, dct = F.col("page_id") % 7 == 0, F.col("page_id") % 2 == 0
    return load(spark, sf_dir, "pages").select("page_id", route.alias("route"), (ink & dct).alias("invert"), ((route == "JP2") & ~gray).alias("mct"))


@register(
    "padded_batches",
    """WITH n AS (SELECT count(*) AS n FROM conversations), b AS (SELECT unnest(range((n + 63) // 64)) AS batch, n FROM n)
SELECT batch, least(64, n - 64 * batch) AS real_rows, 64 - least(64, n - 64 * batch) AS padding FROM b""",
)
def padded_batches(spark, sf_dir, size: int = 64):
    """Batches of a fixed shape: how many rows of each are real and how many fill it up."""
    n = load(spark, sf_dir, "conversations").agg(F.count("*").alias("n")).where("n > 0")
    b = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) DIV {size}"))).alias("batch"))
    held = F.least(F.lit(size).cast("long"), F.col("n") - size * F.col("batch"))
    return b.select("batch", held.alias("real_rows"), (size - held).alias("padding"))


def png_bits(bits: np.ndarray) -> bytes:
    """A one-bit gray PNG file; a set bit is white."""
    height, width = bits.shape

    def part(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    rows = np.packbits(bits, axis=1)
    body = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 1, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(body, 9)) + part(b"IEND", b"")


@register("png_encode")
def png_encode(spark, sf_dir):
    """The images binarised and written as one-bit files."""

    @F.pandas_udf("binary")
    def encode(px: pd.Series) -> pd.Series:
        return px.map(lambda v: png_bits(np.asarray(v).reshape(SIDE, SIDE) >= 180))

    return pixels(spark, sf_dir).select("vec_id", encode("px").alias("png"))


@register("deflate_streams")
def deflate_streams(spark, sf_dir, level: int = 9, least: int = 64):
    """Streams deflated anew; the smaller form stays, and those of under least bytes are left alone."""

    @F.pandas_udf("binary")
    def deflate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress(t.encode(), level))

    old = F.octet_length("text")
    d = load(spark, sf_dir, "documents").select("doc_id", old.cast("long").alias("old_size"), F.when(old >= least, deflate(F.coalesce("text", F.lit("")))).alias("packed"))
    better = F.coalesce(F.octet_length("packed") < F.col("old_size"), F.lit(False))
    return d.select("doc_id", "old_size", F.when(better, F.octet_length("packed").cast("long")).otherwise(F.col("old_size")).alias("new_size"), better.alias("improved"))
