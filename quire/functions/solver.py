"""Steps of higher order, order plans, parametrisations and whole samplings of the diffusion solver as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.catalog import register
from quire.functions.tensor import marginal
from quire.plans.tables import load

START, END = -1.0, 0.5  # log signal-to-noise ratios of one step


def shape(kind: str, h: float, r: float = 1.0) -> tuple[float, float, float]:
    """The three exponential weights of a step of r * h; kind is data (the model gives x0) or noise."""
    z = -r * h if kind == "data" else r * h
    one = math.expm1(z)
    two = one / z - 1.0
    return one, two, two / z - 0.5


def weights(kind: str, variant: str, order: int, start: float, h: float) -> list[list[float]]:
    """A step of h from the log signal-to-noise ratio start: rows of coefficients (of x, m0, m1, m2) for the points of a singlestep update, the last row being the result.

    m0 is the model at x, m1 and m2 at the points before. Points lie at 1/2, or at 1/3 and 2/3, of the step in log SNR.
    """
    a_s, s_s = marginal(start)
    shares = {1: [], 2: [0.5], 3: [1 / 3, 2 / 3]}[order]
    rows = []
    for i, r in enumerate([*shares, 1.0]):
        alpha, sigma = marginal(start + r * h)
        one, two, three = shape(kind, h, r)
        keep, scale = (sigma / s_s, -alpha) if kind == "data" else (alpha / a_s, -sigma)
        row = [keep, scale * one, 0.0, 0.0]
        lean = [0.0, 0.0, 0.0]  # on m0, m1, m2; they sum to 0
        if order == 2 and r == 1:
            w = (one * 0.5 if variant == "dpmsolver" else two) / shares[0]
            lean = [-w, w, 0.0]
        elif order == 3 and i == 1:
            w = two * r / shares[0]
            lean = [-w, w, 0.0]
        elif order == 3 and r == 1 and variant == "dpmsolver":
            w = two / shares[1]
            lean = [-w, 0.0, w]
        elif order == 3 and r == 1:  # first and second differences of the two slopes
            r1, r2 = shares
            first = (r1 / r2 - r2 / r1, r2 / r1, -r1 / r2)
            second = (2 / r1 - 2 / r2, -2 / r1, 2 / r2)
            lean = [(two * p + three * q) / (r2 - r1) for p, q in zip(first, second, strict=True)]
        row[1:] = [w + scale * e for w, e in zip(row[1:], lean, strict=True)]
        rows.append(row)
    return rows


def plans() -> dict[str, list[list[float]]]:
    found = {}
    for kind in ("data", "noise"):
        for variant in ("dpmsolver", "taylor"):
            for order in (2, 3):
                found[f"{kind}_{variant}_{order}"] = weights(kind, variant, order, START, END - START)
    return found


def model(x: Column) -> Column:
    """Stand-in for the network: bounded, odd, not linear."""
    return x / (F.abs(x) + 1)


def update(x: Column, rows: list[list[float]], f: Callable[[Column], Column] = model) -> Column:
    ms, now = [f(x)], x
    for row in rows:
        now = row[0] * x
        for w, m in zip(row[1:], ms, strict=False):
            now = now + w * m
        ms.append(f(now))
    return now


def update_sql(rows: list[list[float]], name: str) -> str:
    """The same as chained subqueries over a table t(vec_id, x)."""
    m = lambda e: f"{e} / (abs({e}) + 1)"
    sql, have = f"SELECT vec_id, x, {m('x')} AS m0 FROM t", ["m0"]
    for i, row in enumerate(rows):
        total = f"{row[0]!r}::DOUBLE * x" + "".join(f" + ({w!r}::DOUBLE) * {h}" for w, h in zip(row[1:], have, strict=False))
        sql = f"SELECT *, {m(f'y{i}')} AS m{i + 1} FROM (SELECT *, {total} AS y{i} FROM ({sql}))"
        have.append(f"m{i + 1}")
    return f"SELECT vec_id, '{name}' AS solver, round(sum(y{len(rows) - 1}), 5) AS total FROM ({sql}) GROUP BY vec_id"


VALUES_SQL = "t AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@register("singlestep_updates", f"WITH {VALUES_SQL} " + " UNION ALL ".join(update_sql(rows, name) for name, rows in plans().items()))
def singlestep_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of second and third order in both parametrisations and both variants; the sum of each result."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    total = lambda rows: F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + update(x, rows)), 5)
    each = [F.struct(F.lit(n).alias("solver"), total(rows).alias("total")) for n, rows in plans().items()]
    return v.select("vec_id", F.inline(F.array(*each)))


@register(
    "order_plan",
    """WITH s AS (SELECT CAST(a AS INTEGER) AS steps, CAST(b AS INTEGER) AS most FROM range(1, 31) AS q(a), range(1, 4) AS r(b))
SELECT steps, most, rtrim(CASE most WHEN 1 THEN repeat('1 ', steps) WHEN 2 THEN repeat('2 ', steps // 2) || repeat('1 ', steps % 2)
ELSE CASE steps % 3 WHEN 0 THEN repeat('3 ', steps // 3 - 1) || '2 1' WHEN 1 THEN repeat('3 ', steps // 3) || '1' ELSE repeat('3 ', steps // 3) || '2' END END) AS orders FROM s""",
)
def order_plan(spark, sf_dir, steps: int = 30):
    """Orders of the steps that spend exactly so many evaluations of the model."""
    s = spark.range(1, steps + 1).select(F.col("id").cast("int").alias("steps"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("most"))
    left = F.expr("steps % most")
    whole = F.expr("CASE WHEN most = 3 AND steps % 3 = 0 THEN steps DIV 3 - 1 ELSE steps DIV most END").cast("int")
    tail = F.when((F.col("most") == 3) & (left == 0), F.array(F.lit("2"), F.lit("1"))).when(left > 0, F.array(left.cast("string"))).otherwise(F.array().cast("array<string>"))
    return s.select("steps", "most", F.array_join(F.concat(F.array_repeat(F.col("most").cast("string"), whole), tail), " ").alias("orders"))


ALPHA, SIGMA = marginal(START)
SCALE = 2.5  # of the guidance


@register(
    "model_outputs",
    f"""WITH {VALUES_SQL}, o AS (SELECT vec_id, x, x / (abs(x) + 1) AS o, x * 0.25 AS u FROM t)
SELECT vec_id, round(sum((x - {ALPHA!r} * o) / {SIGMA!r}), 5) AS from_start, round(sum({ALPHA!r} * o + {SIGMA!r} * x), 5) AS from_v, round(sum(-{SIGMA!r} * o), 5) AS from_score,
round(sum(u + {SCALE} * (o - u)), 5) AS free_guidance, round(sum(o - {SCALE} * {SIGMA!r} * u), 5) AS classifier_guidance, round(sum({ALPHA!r} * x + {SIGMA!r} * u), 5) AS noised, round(sum((x - {SIGMA!r} * o) / {ALPHA!r}), 5) AS denoised FROM o GROUP BY 1""",
)
def model_outputs(spark, sf_dir):
    """Noise from a model that gives x0, v or the score; guidance with and without a classifier; noise put on and taken off."""
    total = lambda f: F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x, model(x), x * 0.25)), 5)
    kinds = {
        "from_start": lambda x, o, u: (x - ALPHA * o) / SIGMA,
        "from_v": lambda x, o, u: ALPHA * o + SIGMA * x,
        "from_score": lambda x, o, u: -SIGMA * o,
        "free_guidance": lambda x, o, u: u + SCALE * (o - u),
        "classifier_guidance": lambda x, o, u: o - SCALE * SIGMA * u,
        "noised": lambda x, o, u: ALPHA * x + SIGMA * u,
        "denoised": lambda x, o, u: (x - SIGMA * o) / ALPHA,
    }
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", *(total(f).alias(n) for n, f in kinds.items()))


def path(low: float, high: float, steps: int) -> list[tuple[float, float]]:
    """(weight of x, weight of the data prediction) of first-order steps evenly spaced in log SNR; high < low goes backward."""
    h = (high - low) / steps
    points = [marginal(low + i * h) for i in range(steps + 1)]
    return [(t[1] / s[1], -t[0] * math.expm1(-h)) for s, t in zip(points, points[1:], strict=False)]


PATHS = {"sample": path(-2.0, 2.0, 8), "inverse": path(2.0, -2.0, 8)}


def path_sql(name: str) -> str:
    sql = "SELECT vec_id, x AS y FROM t"
    for a, b in PATHS[name]:
        sql = f"SELECT vec_id, {a!r}::DOUBLE * y + ({b!r}::DOUBLE) * y / (abs(y) + 1) AS y FROM ({sql})"
    return f"SELECT vec_id, '{name}' AS direction, round(sum(y), 4) AS total FROM ({sql}) GROUP BY 1"


@register("solver_sample", f"WITH {VALUES_SQL} {path_sql('sample')} UNION ALL {path_sql('inverse')}")
def solver_sample(spark, sf_dir):
    """A whole sampling and its inverse: a fold over the steps' weights for every value."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def run(steps):
        ws = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))
        return lambda s, x: s + F.aggregate(ws, x, lambda y, w: w["a"] * y + w["b"] * model(y))

    each = [F.struct(F.lit(n).alias("direction"), F.round(F.aggregate("v", F.lit(0.0), run(steps)), 4).alias("total")) for n, steps in PATHS.items()]
    return v.select("vec_id", F.inline(F.array(*each)))
