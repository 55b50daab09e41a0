"""Rasters: colour tests over grids, the page's colour decision, linear stretch, feathered overlap, conversions, adaptive steps."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from quire.catalog import register
from quire.plans.tables import PIXELS_SQL, load, pixels

SIDE = 8
THRESHOLD = 40.0  # mean standard deviation over channels from which a block is coloured; twice that in the centre

# an image's channels: the values, the values from the end on, and the values half an image further on
CHANNELS_SQL = f"""{PIXELS_SQL}, c3 AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, px[i + 1] AS r, px[64 - i] AS g, px[(i + 32) % 64 + 1] AS b FROM (SELECT vec_id, px, unnest(range(64)) AS i FROM px)),
sd AS (SELECT *, sqrt((r * r + g * g + b * b) / 3.0::DOUBLE - pow((r + g + b) / 3.0::DOUBLE, 2)) AS s FROM c3)"""


def spread(r: Column, g: Column, b: Column) -> Column:
    """The standard deviation over a pixel's channels."""
    return F.sqrt((r * r + g * g + b * b) / F.lit(3.0) - F.pow((r + g + b) / F.lit(3.0), F.lit(2.0)))


def channels(spark: SparkSession, sf_dir: str):
    """(vec_id, y, x, r, g, b), a row a pixel."""
    i = F.col("i")
    px = pixels(spark, sf_dir).select("vec_id", "px", F.posexplode("px").alias("i", "r"))
    return px.select("vec_id", F.expr("i DIV 8").alias("y"), (i % 8).alias("x"), "r", F.get("px", 63 - i).alias("g"), F.get("px", (i + 32) % 64).alias("b"))


def block_start(at: Column, step: int) -> Column:
    """The block that a row or column belongs to; a side that blocks don't divide has one more."""
    return F.floor(at / step).cast("int")


@register(
    "color_grid",
    f"""WITH {CHANNELS_SQL}, k AS (SELECT vec_id, y // 2 AS by_, x // 2 AS bx, avg(s) AS m FROM sd GROUP BY 1, 2, 3), h AS (SELECT vec_id, y // 4 AS by_, x // 4 AS bx, avg(s) AS m FROM sd GROUP BY 1, 2, 3),
c AS (SELECT vec_id, avg(s) AS m FROM sd WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY 1)
SELECT vec_id, round(c.m, 6) AS centre, CAST((SELECT count(*) FROM k WHERE k.vec_id = c.vec_id AND round(k.m, 6) > {THRESHOLD}) AS BIGINT) AS blocks,
  round(c.m, 6) > 2 * {THRESHOLD} OR EXISTS (SELECT 1 FROM k WHERE k.vec_id = c.vec_id AND round(k.m, 6) > {THRESHOLD}) AS colored,
  EXISTS (SELECT 1 FROM h WHERE h.vec_id = c.vec_id AND round(h.m, 6) > {THRESHOLD}) AS tile_colored FROM c""",
)
def color_grid(spark, sf_dir):
    """Whether an image is coloured: in its centre by twice the threshold, or in any block of a fine grid; a tile by a grid of 2."""
    c = channels(spark, sf_dir).withColumn("s", spread(F.col("r"), F.col("g"), F.col("b")))
    centre = F.when(F.expr("y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5"), F.col("s"))
    fine = c.withColumn("by", block_start(F.col("y"), 2)).withColumn("bx", block_start(F.col("x"), 2))
    k = fine.groupBy("vec_id", "by", "bx").agg(F.avg("s").alias("m"), F.sum("s").alias("total"), F.sum(centre).alias("c"), F.count(centre).alias("n"))
    half = k.groupBy("vec_id", block_start(F.col("by"), 2).alias("hy"), block_start(F.col("bx"), 2).alias("hx"))
    half = half.agg(F.sum("total").alias("total"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count_if(F.round("m", 6) > THRESHOLD).alias("blocks"))
    out = half.groupBy("vec_id").agg((F.sum("c") / F.sum("n")).alias("centre"), F.sum("blocks").alias("blocks"), F.bool_or(F.round(F.col("total") / 16, 6) > THRESHOLD).alias("tile_colored"))
    return out.select("vec_id", F.round("centre", 6).alias("centre"), "blocks", ((F.round("centre", 6) > 2 * THRESHOLD) | (F.col("blocks") > 0)).alias("colored"), "tile_colored")


def grid_gray(step: int) -> Column:
    """Whether a block of step x step values has more than 0.15 between 50 and 220."""
    n = SIDE // step
    block = lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda d: F.slice("px", (F.floor(b / n) * step + d) * SIDE + b % n * step + 1, step)))
    share = lambda b: F.size(F.filter(block(b), lambda x: (x > 50) & (x < 220))) / (step * step)
    return F.exists(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda b: share(b) > 0.15)


@register(
    "grid_mode",
    f"""WITH {PIXELS_SQL}, c AS (SELECT vec_id, px, unnest(range(64)) AS i FROM px), v AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, px[i + 1] AS p FROM c),
m AS (SELECT vec_id, avg(CAST(p > 30 AND p < 225 AS INTEGER)) AS middle FROM v GROUP BY 1),
f AS (SELECT vec_id, bool_or(g) AS gray FROM (SELECT vec_id, avg(CAST(p > 50 AND p < 220 AS INTEGER)) > 0.15 AS g FROM v GROUP BY vec_id, y // 2, x // 2) GROUP BY 1),
h AS (SELECT vec_id, bool_or(g) AS gray FROM (SELECT vec_id, avg(CAST(p > 50 AND p < 220 AS INTEGER)) > 0.15 AS g FROM v GROUP BY vec_id, y // 4, x // 4) GROUP BY 1)
SELECT vec_id, CASE WHEN middle < 1.0 - 0.98 OR NOT f.gray THEN 'MONO' ELSE 'HYBRID' END AS image_mode, CASE WHEN middle < 1.0 - 0.98 OR NOT h.gray THEN 'MONO' ELSE 'HYBRID' END AS tile_mode
FROM m JOIN f USING (vec_id) JOIN h USING (vec_id)""",
)
def grid_mode(spark, sf_dir):
    """MONO or HYBRID by a fine grid for images and a coarse one for tiles."""
    middle = F.size(F.filter("px", lambda x: (x > 30) & (x < 225))) / F.size("px") < 1.0 - 0.98
    mode = lambda step: F.when(middle | ~grid_gray(step), "MONO").otherwise("HYBRID")
    return pixels(spark, sf_dir).select("vec_id", mode(2).alias("image_mode"), mode(4).alias("tile_mode"))


@register(
    "page_color_decision",
    f"""WITH {CHANNELS_SQL}, t AS (SELECT vec_id % 50 AS page, CASE WHEN greatest(abs(r - g), abs(g - b), abs(r - b)) <= 60 THEN 'gray' WHEN b > g AND b > r THEN 'blue' WHEN r > g AND r > b THEN 'red' WHEN g > b AND g > r THEN 'green' ELSE 'other' END AS hue FROM c3),
n AS (SELECT page, count(*) AS n, count(*) FILTER (hue = 'gray') AS gray, count(*) FILTER (hue = 'blue') AS blue, count(*) FILTER (hue = 'red') AS red, count(*) FILTER (hue = 'green') AS green, count(*) FILTER (hue = 'other') AS other FROM t GROUP BY 1),
p AS (SELECT page, 100.0::DOUBLE * gray / n AS gray, 100.0::DOUBLE * (n - gray) / n AS color, CASE WHEN n > gray THEN 100.0::DOUBLE * greatest(blue, red, green, other) / (n - gray) ELSE 0 END AS concentration FROM n)
SELECT page, round(gray, 6) AS gray, round(color, 6) AS color, round(concentration, 6) AS concentration, gray > 30 AND color < 70 AND concentration > 35 AS decorative FROM p""",
)
def page_color_decision(spark, sf_dir, gray: float = 30, color: float = 70, concentration: float = 35):
    """A page whose colour is little and mostly of one hue is gray with decoration. The limits are those that the fixture's noise can meet; a scan has 85, 15 and 60."""
    c = channels(spark, sf_dir)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hue = F.when(F.greatest(F.abs(r - g), F.abs(g - b), F.abs(r - b)) <= 60, "gray").when((b > g) & (b > r), "blue").when((r > g) & (r > b), "red").when((g > b) & (g > r), "green").otherwise("other")
    count = lambda name: F.count_if(F.col("hue") == name)
    n = c.select((F.col("vec_id") % 50).alias("page"), hue.alias("hue")).groupBy("page").agg(F.count("*").alias("n"), *(count(h).alias(h) for h in ("gray", "blue", "red", "green", "other")))
    one = F.greatest("blue", "red", "green", "other")
    p = n.select("page", (100.0 * F.col("gray") / F.col("n")).alias("gray"), (100.0 * (F.col("n") - F.col("gray")) / F.col("n")).alias("color"), F.when(F.col("n") > F.col("gray"), 100.0 * one / (F.col("n") - F.col("gray"))).otherwise(0.0).alias("concentration"))
    fine = (F.col("gray") > gray) & (F.col("color") < color) & (F.col("concentration") > concentration)
    return p.select("page", *(F.round(x, 6).alias(x) for x in ("gray", "color", "concentration")), fine.alias("decorative"))


def quantile_of(values: Column, p: float) -> Column:
    """The linear-interpolated quantile of an array."""
    at = (F.size(values) - 1) * F.lit(p)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(F.array_sort(values), low), F.get(F.array_sort(values), high)
    return a + (b - a) * (at - low)


@register(
    "linear_stretch",
    f"""WITH {PIXELS_SQL}, q AS (SELECT vec_id, px, list_aggregate(px, 'quantile_cont', 0.01) AS lo, list_aggregate(px, 'quantile_cont', 0.99) AS hi FROM px)
SELECT vec_id, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(list_sum(list_transform(px, lambda x: CASE WHEN hi - lo >= 20 THEN least(greatest(floor(round((x - lo) * 255 / (hi - lo), 6)), 0), 255) ELSE x END)) AS BIGINT) AS total FROM q""",
)
def linear_stretch(spark, sf_dir):
    """Values from the first to the last percentile are stretched to 0..255, if they are at least 20 apart."""
    q = pixels(spark, sf_dir).select("vec_id", "px", quantile_of(F.col("px"), 0.01).alias("lo"), quantile_of(F.col("px"), 0.99).alias("hi"))
    wide = lambda x: F.least(F.greatest(F.floor(F.round((x - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")), 6)), F.lit(0)), F.lit(255))
    new = F.transform("px", lambda x: F.when(F.col("hi") - F.col("lo") >= 20, wide(x)).otherwise(x.cast("long")))
    return q.select("vec_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register(
    "feather_add",
    f"""WITH {PIXELS_SQL}, t AS (SELECT vec_id, px, unnest([0, 16, 32, 48]) AS s FROM px), c AS (SELECT vec_id, s + d AS place, px[s + d + 1] + s AS v, least(d + 1, 24 - d, 8) / 8.0::DOUBLE AS w FROM t, range(24) AS q(d) WHERE s + d < 64)
SELECT vec_id, CAST(place AS INTEGER) AS place, round(sum(v * w) / greatest(sum(w), 1e-6), 6) AS value FROM c GROUP BY 1, 2""",
)
def feather_add(spark, sf_dir, tile: int = 24, stride: int = 16, ramp: int = 8):
    """Strips overlap, and a strip's weight rises and falls over ramp cells: sums of weighted values over sums of weights (a strip's values are shifted by its place to tell strips apart)."""
    t = pixels(spark, sf_dir).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(63), F.lit(stride)))).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(tile - 1)))).where("at + d < 64")
    weight = F.least(F.col("d") + 1, tile - F.col("d"), F.lit(ramp)) / float(ramp)
    c = t.select("vec_id", (F.col("at") + F.col("d")).alias("place"), (F.get("px", F.col("at") + F.col("d")) + F.col("at")).alias("v"), weight.alias("w"))
    return c.groupBy("vec_id", "place").agg(F.round(F.sum(F.col("v") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6)), 6).alias("value"))


@register(
    "convert_color",
    f"WITH {CHANNELS_SQL} SELECT vec_id, CAST(sum((299 * r + 587 * g + 114 * b) // 1000) AS BIGINT) AS luma, CAST(sum((y * 8 + x + 1) * (b + 256 * g + 65536 * r)) AS BIGINT) AS swapped FROM c3 GROUP BY 1",
)
def convert_color(spark, sf_dir):
    """Colour to gray by whole-number weights, and the order of channels turned around (as a checksum by place)."""
    c = channels(spark, sf_dir)
    return c.groupBy("vec_id").agg(F.sum(F.expr("(299 * r + 587 * g + 114 * b) DIV 1000")).alias("luma"), F.sum(F.expr("CAST((y * 8 + x + 1) AS BIGINT) * (b + 256 * g + 65536 * r)")).alias("swapped"))


START, FIRST, SAFETY, ABSOLUTE, RELATIVE, MOST = -2.0, 0.05, 0.9, 0.0078, 0.05, 60  # the solver's first lambda and step, and its tolerances
END = 1.5


@register(
    "adaptive_steps",
    f"""WITH RECURSIVE e AS (SELECT event_id, value / 100 AS x0, 0.2::DOUBLE + (event_id % 7) / 10.0::DOUBLE AS k FROM events),
r AS (SELECT event_id, k, x0 AS x, x0 AS before, {START}::DOUBLE AS s, {FIRST}::DOUBLE AS h, 0 AS taken, 0 AS tried FROM e
UNION ALL SELECT event_id, k, CASE WHEN err <= 1 THEN high ELSE x END, CASE WHEN err <= 1 THEN low ELSE before END, CASE WHEN err <= 1 THEN s + h ELSE s END,
  least({SAFETY}::DOUBLE * h * pow(greatest(err, 1e-6), -0.5), {END}::DOUBLE - CASE WHEN err <= 1 THEN s + h ELSE s END), taken + CASE WHEN err <= 1 THEN 1 ELSE 0 END, tried + 1
  FROM (SELECT *, abs(high - low) / greatest({ABSOLUTE}::DOUBLE, {RELATIVE}::DOUBLE * greatest(abs(low), abs(before))) AS err FROM
    (SELECT *, x - h * k * x AS low, x - h * k * (x - h / 2 * k * x) AS high FROM r WHERE tried < {MOST} AND s < {END}::DOUBLE - 1e-9)))
SELECT event_id, round(arg_max(x, tried), 6) AS x, max(taken) AS taken, max(tried) AS tried FROM r GROUP BY 1""",
)
def adaptive_steps(spark, sf_dir):
    """Steps of own length: a first- and a second-order step from the same point are compared; a step counts only if they agree
    within tolerance, and either way the next length follows from the error. At most MOST tries, as a fold over them.

    The equation is x' = -k x, in lambda from START to END.
    """
    e = load(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("x0"), (F.lit(0.2) + (F.col("event_id") % 7) / F.lit(10.0)).alias("k"))
    state = F.struct(F.col("x0").alias("x"), F.col("x0").alias("before"), F.lit(START).alias("s"), F.lit(FIRST).alias("h"), F.lit(0).alias("taken"), F.lit(0).alias("tried"))

    def step(a: Column, _: Column) -> Column:
        x, h, k = a["x"], a["h"], F.col("k")
        low, high = x - h * k * x, x - h * k * (x - h / 2 * k * x)
        error = F.abs(high - low) / F.greatest(F.lit(ABSOLUTE), RELATIVE * F.greatest(F.abs(low), F.abs(a["before"])))
        fine = error <= 1
        s = F.when(fine, a["s"] + h).otherwise(a["s"])
        length = F.least(SAFETY * h * F.pow(F.greatest(error, F.lit(1e-6)), F.lit(-0.5)), END - s)
        new = F.struct(
            F.when(fine, high).otherwise(x).alias("x"), F.when(fine, low).otherwise(a["before"]).alias("before"), s.alias("s"), length.alias("h"), (a["taken"] + fine.cast("int")).alias("taken"), (a["tried"] + 1).alias("tried")
        )
        return F.when(a["s"] < END - 1e-9, new).otherwise(a)

    out = e.select("event_id", F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), state, step).alias("a"))
    return out.select("event_id", F.round("a.x", 6).alias("x"), F.col("a.taken").alias("taken"), F.col("a.tried").alias("tried"))
