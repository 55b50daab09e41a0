"""Profiles: colour, gray and character statistics, percentiles, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quire.catalog import register
from quire.plans.tables import PIXELS_SQL, load, pixels


@register(
    "charset_overlap",
    """WITH c AS (SELECT conv_id, turn, trim(text) AS t, list_distinct(regexp_extract_all(text, '(?s).')) AS chars FROM conversations),
p AS (SELECT *, lag(chars) OVER (PARTITION BY conv_id ORDER BY turn, t) AS before FROM c)
SELECT conv_id, turn, round(len(list_intersect(chars, before)) / len(before), 6) AS overlap, round(len(list_intersect(chars, before)) / len(before), 6) < 0.5 AND length(t) > 10 AS corrupt FROM p WHERE len(before) > 0""",
)
def charset_overlap(spark: SparkSession, sf_dir: str):
    """Share of a turn's characters that the next turn keeps; under a half of a text over 10 characters looks corrupt."""
    chars = F.array_distinct(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("t"), chars.alias("chars"))
    c = c.withColumn("before", F.lag("chars").over(W.partitionBy("conv_id").orderBy("turn", "t"))).where(F.size("before") > 0)
    share = F.round(F.size(F.array_intersect("chars", "before")) / F.size("before"), 6)
    return c.select("conv_id", "turn", share.alias("overlap"), ((share < 0.5) & (F.length("t") > 10)).alias("corrupt"))


@register(
    "resource_refs",
    r"""SELECT page_id, CAST(len(n) AS INTEGER) AS n_refs, array_to_string(list_sort(n), ' ') AS names FROM (SELECT page_id, list_distinct(regexp_extract_all(html, '/([^\s/<>\[\]()%"]+)', 1)) AS n FROM pages)""",
)
def resource_refs(spark, sf_dir):
    names = F.array_distinct(F.regexp_extract_all("html", F.lit(r'/([^\s/<>\[\]()%"]+)'), F.lit(1)))
    return load(spark, sf_dir, "pages").select("page_id", names.alias("n")).select("page_id", F.size("n").alias("n_refs"), F.array_join(F.array_sort("n"), " ").alias("names"))


@register(
    "hue_profile",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, event_type AS dominant, round(100.0 * n / total, 6) AS concentration, 100.0 * n / total > 25 AS uniform FROM r WHERE k = 1""",
)
def hue_profile(spark, sf_dir):
    """The most frequent class a user, first seen first among equals, with its share."""
    c = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    top = c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("dominant"), F.max("n").alias("n"), F.sum("n").alias("total"))
    share = 100.0 * F.col("n") / F.col("total")
    return top.select("user_id", "dominant", F.round(share, 6).alias("concentration"), (share > 25).alias("uniform"))


@register(
    "hue_buckets",
    f"""WITH {PIXELS_SQL}, t AS (SELECT vec_id, px[3 * i + 1] AS b, px[3 * i + 2] AS g, px[3 * i + 3] AS r FROM px, range(21) AS q(i))
SELECT vec_id, count(*) FILTER (b > g AND b > r) AS blue, count(*) FILTER (r > g AND r > b) AS red, count(*) FILTER (g > b AND g > r) AS green,
count(*) FILTER (NOT (b > g AND b > r OR r > g AND r > b OR g > b AND g > r)) AS other, round(100.0 * count(*) FILTER (greatest(abs(b - g), abs(g - r), abs(b - r)) <= 10) / count(*), 6) AS gray_share FROM t GROUP BY 1""",
)
def hue_buckets(spark, sf_dir):
    """Pixels by their strictly largest channel, ties in other; and the share of nearly gray ones."""
    px = pixels(spark, sf_dir)
    three = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(F.get("px", 3 * i).alias("b"), F.get("px", 3 * i + 1).alias("g"), F.get("px", 3 * i + 2).alias("r")))
    t = px.select("vec_id", F.inline(three))
    blue, red, green = F.expr("b > g AND b > r"), F.expr("r > g AND r > b"), F.expr("g > b AND g > r")
    near = F.greatest(F.abs(F.col("b") - F.col("g")), F.abs(F.col("g") - F.col("r")), F.abs(F.col("b") - F.col("r"))) <= 10
    return t.groupBy("vec_id").agg(
        F.count_if(blue).alias("blue"), F.count_if(red).alias("red"), F.count_if(green).alias("green"), F.count_if(~(blue | red | green)).alias("other"), F.round(100.0 * F.count_if(near) / F.count("*"), 6).alias("gray_share")
    )


@register(
    "mono_sample_decision",
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT e.user_id, e.event_type, n, row_number() OVER (PARTITION BY e.user_id ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS k FROM events e JOIN n USING (user_id)),
p AS (SELECT user_id, count(*) AS sampled, 100.0 * count(*) FILTER (event_type IN ('view', 'click')) / count(*) AS ratio FROM s WHERE k <= least(n, greatest(15, least(50, n // 10))) GROUP BY 1),
f AS (SELECT user_id, 100.0 * count(*) FILTER (event_type IN ('view', 'click')) / count(*) AS whole FROM events GROUP BY 1)
SELECT user_id, sampled, round(ratio, 6) AS ratio, CASE WHEN ratio > 50 THEN whole > 30 ELSE FALSE END AS decorative FROM p JOIN f USING (user_id)""",
)
def mono_sample_decision(spark, sf_dir):
    """A seeded sample decides whether the whole is looked at; then the whole decides."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").isin("view", "click").alias("mono"))
    n = e.groupBy("user_id").agg(F.count("*").alias("n"), (100.0 * F.count_if("mono") / F.count("*")).alias("whole"))
    turn = F.row_number().over(W.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string")), "event_id"))
    s = e.join(n, "user_id").withColumn("k", turn).where("k <= least(n, greatest(15L, least(50L, n DIV 10)))")
    p = s.groupBy("user_id").agg(F.count("*").alias("sampled"), (100.0 * F.count_if("mono") / F.count("*")).alias("ratio"), F.first("whole").alias("whole"))
    return p.select("user_id", "sampled", F.round("ratio", 6).alias("ratio"), F.when(F.col("ratio") > 50, F.col("whole") > 30).otherwise(False).alias("decorative"))


@register("block_gray", f"WITH {PIXELS_SQL} SELECT vec_id, round(len(list_filter(px, lambda x: x > 50 AND x < 220)) / len(px), 6) AS share, len(list_filter(px, lambda x: x > 50 AND x < 220)) / len(px) > 0.15 AS gray FROM px")
def block_gray(spark, sf_dir):
    share = F.size(F.filter("px", lambda x: (x > 50) & (x < 220))) / F.size("px")
    return pixels(spark, sf_dir).select("vec_id", F.round(share, 6).alias("share"), (share > 0.15).alias("gray"))


@register(
    "mode_classify",
    f"""WITH {PIXELS_SQL} SELECT vec_id, CASE WHEN len(list_filter(px, lambda x: x > 30 AND x < 225)) / len(px) < 1.0 - 0.98 THEN 'MONO'
WHEN len(list_filter(range(4), lambda b: len(list_filter(px[16 * b + 1:16 * b + 16], lambda x: x > 50 AND x < 220)) / 16 > 0.95)) > 0 THEN 'HYBRID' ELSE 'MONO' END AS mode FROM px""",
)
def mode_classify(spark, sf_dir):
    """MONO if hardly any value is in the middle; else HYBRID if some block is mostly gray."""
    middle = F.size(F.filter("px", lambda x: (x > 30) & (x < 225))) / F.size("px")
    gray = lambda b: F.size(F.filter(F.slice("px", 16 * b + 1, 16), lambda x: (x > 50) & (x < 220))) / 16 > 0.95
    some = F.exists(F.sequence(F.lit(0), F.lit(3)), gray)
    return pixels(spark, sf_dir).select("vec_id", F.when(middle < 1.0 - 0.98, "MONO").when(some, "HYBRID").otherwise("MONO").alias("mode"))


@register(
    "color_std",
    f"""WITH {PIXELS_SQL}, t AS (SELECT vec_id, i, unnest([px[3 * i + 1], px[3 * i + 2], px[3 * i + 3]]) AS x FROM px, range(21) AS q(i)),
s AS (SELECT vec_id, i, stddev_pop(x) AS s FROM t GROUP BY 1, 2) SELECT vec_id, round(avg(s), 6) AS mean_std, avg(s) > 15 AS colored FROM s GROUP BY 1""",
)
def color_std(spark, sf_dir):
    three = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice("px", 3 * i + 1, 3))
    t = pixels(spark, sf_dir).select("vec_id", F.posexplode(three).alias("i", "c")).select("vec_id", "i", F.explode("c").alias("x"))
    s = t.groupBy("vec_id", "i").agg(F.stddev_pop("x").alias("s"))
    return s.groupBy("vec_id").agg(F.round(F.avg("s"), 6).alias("mean_std"), (F.avg("s") > 15).alias("colored"))


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], buckets: int = 1024) -> DataFrame:
    """(group, a column a share): exact quantiles with linear interpolation, without a task that holds a whole group.

    Counts of ranges of the value say in which range a rank falls; only that range's distinct values are put in order,
    with their counts, so a value that a third of the rows have is one row.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    ends = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    range_of = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
    placed = rows.join(ends, "g").select("g", "v", "n", range_of.cast("int").alias("range"))
    counts = placed.groupBy("g", "range").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    before = F.sum("k").over(W.partitionBy("g").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("k")
    ask = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for name, p in shares.items()))
    asked = counts.withColumn("before", before).select("g", "range", "k", "before", F.explode(ask).alias("q"))
    asked = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("q.at"), F.ceil("q.at"))))).where("rank >= before AND rank < before + k")
    inside = placed.join(asked.select("g", "range").distinct(), ["g", "range"]).groupBy("g", "range", "v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.partitionBy("g", "range").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = inside.withColumn("upto", upto).join(asked, ["g", "range"]).where("rank - before >= upto - m AND rank - before < upto")
    low, high = F.min(F.struct("rank", "v"))["v"], F.max(F.struct("rank", "v"))["v"]
    each = found.groupBy("g", F.col("q.name").alias("name"), F.col("q.at").alias("at")).agg(low.alias("low"), high.alias("high"))
    each = each.withColumn("value", F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")))
    return each.groupBy(F.col("g").alias(group)).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares))


@register(
    "percentile_stretch",
    """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi, quantile_cont(l_extendedprice, 0.7) AS p70 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p70, 6) AS p70, round(avg(CASE WHEN hi - lo > 20 THEN least(greatest((l_extendedprice - lo) / (hi - lo) * 245 + 5, 5), 250) ELSE l_extendedprice END), 4) AS mean_stretched
FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1, lo, hi, p70""",
)
def percentile_stretch(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    q = quantiles(lines, "l_returnflag", "l_extendedprice", {"lo": 0.02, "hi": 0.98, "p70": 0.7})
    stretched = F.when(F.expr("hi - lo > 20"), F.least(F.greatest(F.expr("(l_extendedprice - lo) / (hi - lo) * 245 + 5"), F.lit(5.0)), F.lit(250.0))).otherwise(F.col("l_extendedprice"))
    out = lines.join(F.broadcast(q), "l_returnflag").groupBy("l_returnflag", "lo", "hi", "p70").agg(F.round(F.avg(stretched), 4).alias("mean_stretched"))  # a row a flag
    return out.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("lo", "hi", "p70")), "mean_stretched")


@register(
    "bright_mean",
    """WITH q AS (SELECT l_linestatus, quantile_cont(l_extendedprice, 0.7) AS p70 FROM lineitem GROUP BY 1)
SELECT l_linestatus, round(avg(l_extendedprice), 4) AS background, count(*) AS n FROM lineitem JOIN q USING (l_linestatus) WHERE l_extendedprice > p70 GROUP BY 1""",
)
def bright_mean(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_linestatus", "l_extendedprice")
    q = quantiles(lines, "l_linestatus", "l_extendedprice", {"p70": 0.7})
    return lines.join(F.broadcast(q), "l_linestatus").where("l_extendedprice > p70").groupBy("l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("background"), F.count("*").alias("n"))


@register("binarize", f"WITH {PIXELS_SQL} SELECT vec_id, array_to_string(list_transform(px, lambda x: CASE WHEN x < 180 THEN 0 ELSE 255 END), ',') AS bits, list_max(px) > 0 AS usable FROM px")
def binarize(spark, sf_dir):
    bits = F.transform("px", lambda x: F.when(x < 180, "0").otherwise("255"))
    return pixels(spark, sf_dir).select("vec_id", F.array_join(bits, ",").alias("bits"), (F.array_max("px") > 0).alias("usable"))


@register("invert_and_gamma", f"WITH {PIXELS_SQL} SELECT vec_id, CAST(list_sum(list_transform(px, lambda x: 255 - x)) AS BIGINT) AS inverted, CAST(list_sum(list_transform(px, lambda x: CAST(floor(round(pow(x / 255, 1 / 0.95) * 255, 6)) AS BIGINT))) AS BIGINT) AS gamma FROM px")
def invert_and_gamma(spark, sf_dir):
    total = lambda f: F.aggregate(F.transform("px", f), F.lit(0).cast("long"), lambda a, x: a + x)
    gamma = lambda x: F.floor(F.round(F.pow(x / 255, F.lit(1 / 0.95)) * 255, 6)).cast("long")
    return pixels(spark, sf_dir).select("vec_id", total(lambda x: (255 - x).cast("long")).alias("inverted"), total(gamma).alias("gamma"))


@register("error_routing", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value, CASE WHEN event_type = 'error' THEN 'detect' END AS error_stage FROM events""")
def error_routing(spark, sf_dir):
    """A failed stage yields its fallback value and names itself; nothing is lost."""
    bad = F.col("event_type") == "error"
    return load(spark, sf_dir, "events").select("event_id", F.when(bad, 0.0).otherwise(F.col("value")).alias("value"), F.when(bad, "detect").alias("error_stage"))


@register("autotune_argmin", """SELECT arg_min(event_type, (m, event_type)) AS best, round(min(m), 6) AS value FROM (SELECT event_type, round(avg(value), 9) AS m FROM events GROUP BY 1)""")
def autotune_argmin(spark, sf_dir):
    m = load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("m"))
    return m.agg(F.min_by("event_type", F.struct("m", "event_type")).alias("best"), F.round(F.min("m"), 6).alias("value"))


@register(
    "page_extent",
    """SELECT max(greatest(abs(p_size), abs(p_retailprice))) AS extent, CAST(greatest(0, round_even(log10(max(greatest(abs(p_size), abs(p_retailprice))) / 612), 0)) AS INTEGER) AS more_digits FROM part WHERE p_size > 0""",
)
def page_extent(spark, sf_dir):
    """The largest side of valid boxes, and the digits that it adds to the precision (rounding half to even)."""
    side = F.max(F.greatest(F.abs(F.col("p_size")).cast("double"), F.abs("p_retailprice"))).alias("extent")
    return load(spark, sf_dir, "part").where("p_size > 0").agg(side).withColumn("more_digits", F.greatest(F.lit(0.0), F.bround(F.log10(F.col("extent") / 612), 0)).cast("int"))


@register(
    "tile_coverage",
    """WITH c AS (SELECT l_orderkey, sum(l_quantity * l_linenumber) / 1000 AS coverage, bool_or(l_returnflag = 'R') AS hybrid FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(coverage, 6) AS coverage, CASE WHEN hybrid THEN coverage > 0.5 ELSE coverage >= 0.5 END AS tiled FROM c""",
)
def tile_coverage(spark, sf_dir):
    """Rectangles' share of the page; the hybrid test is strict, the mono test isn't."""
    c = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_quantity") * F.col("l_linenumber")) / 1000).alias("coverage"), F.bool_or(F.col("l_returnflag") == "R").alias("hybrid"))
    return c.select("l_orderkey", F.round("coverage", 6).alias("coverage"), F.when(F.col("hybrid"), F.col("coverage") > 0.5).otherwise(F.col("coverage") >= 0.5).alias("tiled"))
