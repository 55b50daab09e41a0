"""Noise schedules, solver steps and thresholds as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quire.catalog import register
from quire.plans.tables import load

STEPS = 100


@register(
    "dynamic_threshold",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 8) AS v FROM embeddings),
s AS (SELECT vec_id, v, list_sort(list_transform(v, lambda x: abs(x)))[least(CAST(floor(0.995 * len(v)) AS BIGINT), len(v) - 1) + 1] AS q FROM v)
SELECT vec_id, round(q, 6) AS q, round(list_sum(list_transform(v, lambda x: greatest(least(x, greatest(q, 1)), -greatest(q, 1)) / greatest(q, 1))), 6) AS total FROM s""",
)
def dynamic_threshold(spark: SparkSession, sf_dir: str, p: float = 0.995):
    """Clip at the k-th smallest magnitude, 1 at least, and divide by it."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("v"))
    k = F.least(F.floor(p * F.size("v")).cast("int"), F.size("v") - 1)
    s = v.withColumn("q", F.get(F.array_sort(F.transform("v", lambda x: F.abs(x))), k)).withColumn("s", F.greatest("q", F.lit(1.0)))
    clipped = F.transform("v", lambda x: F.greatest(F.least(x, F.col("s")), -F.col("s")) / F.col("s"))
    return s.select("vec_id", F.round("q", 6).alias("q"), F.round(F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def betas(spark: SparkSession, steps: int = STEPS) -> DataFrame:
    """(kind, i, beta) of the linear, quadratic, sigmoid and cosine schedules."""
    low, high = 1e-6 * 1000 / steps, 0.02 * 1000 / steps
    i, n = F.col("i"), steps - 1
    cosine = lambda k: F.pow(F.cos((k / F.lit(float(steps)) + 0.001) / 1.001 * (math.pi * 0.5)), F.lit(2.0))
    kinds = {
        "linear": low + (high - low) * i / n,
        "quadratic": F.pow(low**0.5 + (high**0.5 - low**0.5) * i / n, F.lit(2.0)),
        "sigmoid": 1.0 / (1.0 + F.exp(-(-6.0 + 12.0 * i / n))) * (high - low) + low,
        "cosine": F.least(F.greatest(1 - cosine(i + 1) / cosine(i), F.lit(0.0001)), F.lit(0.9999)),
    }
    each = F.array(*(F.struct(F.lit(k).alias("kind"), e.alias("beta")) for k, e in kinds.items()))
    return spark.range(steps).select(F.col("id").cast("int").alias("i")).select("i", F.inline(each))


BETAS_SQL = f"""b AS (SELECT kind, CAST(i AS INTEGER) AS i, CASE kind WHEN 'linear' THEN lo + (hi - lo) * i / {STEPS - 1} WHEN 'quadratic' THEN pow(sqrt(lo) + (sqrt(hi) - sqrt(lo)) * i / {STEPS - 1}, 2)
WHEN 'sigmoid' THEN 1 / (1 + exp(-(-6 + 12.0::DOUBLE * i / {STEPS - 1}))) * (hi - lo) + lo
ELSE least(greatest(1 - pow(cos(((i + 1) / {STEPS}.0::DOUBLE + 0.001) / 1.001 * (pi() * 0.5)), 2) / pow(cos((i / {STEPS}.0::DOUBLE + 0.001) / 1.001 * (pi() * 0.5)), 2), 0.0001), 0.9999) END AS beta
FROM (SELECT unnest(range({STEPS})) AS i), (SELECT unnest(['linear', 'quadratic', 'sigmoid', 'cosine']) AS kind), (SELECT CAST(1e-5 AS DOUBLE) AS lo, CAST(0.2 AS DOUBLE) AS hi))"""
SCHEDULE_SQL = f"{BETAS_SQL}, s AS (SELECT kind, i, (i + 1) / {STEPS}.0::DOUBLE AS t, 0.5::DOUBLE * sum(ln(1 - beta)) OVER (PARTITION BY kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS la FROM b)"


@register("beta_schedules", f"WITH {BETAS_SQL} SELECT kind, i, round(beta, 9) AS beta FROM b")
def beta_schedules(spark, sf_dir):
    return betas(spark).select("kind", "i", F.round("beta", 9).alias("beta"))


def schedule(spark: SparkSession) -> DataFrame:
    """(kind, i, t, la): half the running sum of log(1 - beta)."""
    run = W.partitionBy("kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    return betas(spark).select("kind", "i", ((F.col("i") + 1) / float(STEPS)).alias("t"), (0.5 * F.sum(F.log(1 - F.col("beta"))).over(run)).alias("la"))


@register("noise_schedule", f"WITH {SCHEDULE_SQL} SELECT kind, i, round(exp(la), 6) AS alpha, round(sqrt(1 - exp(2 * la)), 6) AS sigma, round(la - 0.5 * ln(1 - exp(2 * la)), 5) AS lambda_ FROM s")
def noise_schedule(spark, sf_dir):
    keep = 1 - F.exp(2 * F.col("la"))
    return schedule(spark).select("kind", "i", F.round(F.exp("la"), 6).alias("alpha"), F.round(F.sqrt(keep), 6).alias("sigma"), F.round(F.col("la") - 0.5 * F.log(keep), 5).alias("lambda_"))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through (xs, ys), xs ascending; beyond the ends the outer pieces go on."""
    k = F.greatest(F.least(F.size(F.filter(xs, lambda a: a < x)), F.size(xs) - 1), F.lit(1))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    return y0 + (x - x0) * (y1 - y0) / (x1 - x0)


@register(
    "schedule_interp",
    f"""WITH {SCHEDULE_SQL}, q AS (SELECT CAST(j AS INTEGER) AS j, j / 64.0::DOUBLE AS x FROM (SELECT unnest(range(70)) AS j)), l AS (SELECT * FROM s WHERE kind = 'linear'),
k AS (SELECT j, x, greatest(least((SELECT count(*) FROM l WHERE t < x), {STEPS - 1}), 1) AS k FROM q)
SELECT j, round(a.la + (x - a.t) * (b.la - a.la) / (b.t - a.t), 6) AS la FROM k JOIN l a ON a.i = k - 1 JOIN l b ON b.i = k""",
)
def schedule_interp(spark, sf_dir):
    line = schedule(spark).where("kind = 'linear'").agg(F.array_sort(F.collect_list(F.struct("t", "la"))).alias("p"))  # STEPS entries
    q = spark.range(70).select(F.col("id").cast("int").alias("j"), (F.col("id") / 64.0).alias("x")).join(F.broadcast(line))
    return q.select("j", F.round(interpolate(F.col("x"), F.col("p.t"), F.col("p.la")), 6).alias("la"))


@register(
    "time_steps",
    """SELECT kind, CAST(i AS INTEGER) AS i, round(CASE kind WHEN 'time_uniform' THEN 1 + (0.001 - 1) * i / 20.0::DOUBLE ELSE pow(1 + (sqrt(0.001) - 1) * i / 20.0::DOUBLE, 2) END, 9) AS t
FROM (SELECT unnest(range(21)) AS i), (SELECT unnest(['time_uniform', 'time_quadratic']) AS kind)""",
)
def time_steps(spark, sf_dir, n: int = 20, last: float = 0.001):
    i = F.col("id") / float(n)
    each = F.array(F.struct(F.lit("time_uniform").alias("kind"), (1 + (last - 1) * i).alias("t")), F.struct(F.lit("time_quadratic").alias("kind"), F.pow(1 + (last**0.5 - 1) * i, F.lit(2.0)).alias("t")))
    return spark.range(n + 1).select(F.col("id").cast("int").alias("i"), F.inline(each)).select("kind", "i", F.round("t", 9).alias("t"))


def first_order(x: Column, x0: Column, sigma_s: float, sigma_t: float, alpha_t: float, h: float) -> Column:
    return F.zip_with(x, x0, lambda a, b: sigma_t / sigma_s * a - alpha_t * math.expm1(-h) * b)


def marginal(lam: float) -> tuple[float, float]:
    """(alpha, sigma) at a log signal-to-noise ratio."""
    alpha = math.sqrt(1 / (1 + math.exp(-2 * lam)))
    return alpha, math.sqrt(1 - alpha * alpha)


A0, S0 = marginal(-1.0)
A1, S1 = marginal(0.5)


@register(
    "ddim_step",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(v, lambda a: {S1!r} / {S0!r} * a - {A1!r} * {math.expm1(-1.5)!r} * (a * 0.5))), 6) AS first_order,
round(list_sum(list_transform(v, lambda a: {S1!r} / {S0!r} * a - {A1!r} * {math.expm1(-1.5)!r} * (a * 0.5) - 0.5 * {A1!r} * {math.expm1(-1.5)!r} * ((a * 0.5 - a * 0.25) / 0.8))), 6) AS second_order FROM v""",
)
def ddim_step(spark, sf_dir):
    """One step of the first-order and of the multistep second-order update, from a data prediction of half the value."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    one = first_order(F.col("v"), F.transform("v", lambda x: x * 0.5), S0, S1, A1, 1.5)
    d1 = F.transform("v", lambda a: (a * 0.5 - a * 0.25) / 0.8)
    two = F.zip_with(one, d1, lambda a, d: a - 0.5 * A1 * math.expm1(-1.5) * d)
    return v.select("vec_id", total(one).alias("first_order"), total(two).alias("second_order"))


@register(
    "adaptive_error",
    """WITH t AS (SELECT vec_id, label, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings),
e AS (SELECT label, vec_id, sqrt(avg(pow((x * 1.1 - x) / greatest(0.0078, 0.05 * abs(x)), 2))) AS e FROM t GROUP BY 1, 2) SELECT label, round(max(e), 6) AS error, max(e) <= 1 AS accepted FROM e GROUP BY 1""",
)
def adaptive_error(spark, sf_dir):
    """The largest of the rows' root mean squares of the scaled difference of two orders."""
    t = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    scaled = F.pow((F.col("x") * 1.1 - F.col("x")) / F.greatest(F.lit(0.0078), 0.05 * F.abs("x")), F.lit(2.0))
    e = t.groupBy("label", "vec_id").agg(F.sqrt(F.avg(scaled)).alias("e"))
    return e.groupBy("label").agg(F.round(F.max("e"), 6).alias("error"), (F.max("e") <= 1).alias("accepted"))
