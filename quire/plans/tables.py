"""The fixtures as logical tables. They stand in for files, pages, streams and images; SURVEY 7.2 has the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_images(spark: SparkSession, sf_dir: str, part: str | None = None) -> DataFrame:
    """(page, xref), distinct: an order's parts."""
    lines = load(spark, sf_dir, "lineitem")
    lines = lines.where(part) if part is not None else lines
    return lines.select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("xref")).distinct()


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(xref, size): a part's price in cents."""
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("xref"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size"))


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))


PREV = "l_linenumber <= 4"
CAND = "l_linenumber >= 4"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, px): a vector scaled to whole numbers from 0 to 255; constant vectors are 0."""
    x = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    x = x.select("vec_id", "label", "v", F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))
    scaled = F.transform("v", lambda e: F.when(F.col("hi") > F.col("lo"), F.floor((e - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0).cast("int"))
    return x.select("vec_id", "label", scaled.alias("px"))


# the same tables for the DuckDB twins
PIXELS_SQL = """px AS (SELECT vec_id, label, list_transform(v, lambda e: CASE WHEN hi > lo THEN CAST(floor((e - lo) / (hi - lo) * 255) AS INTEGER) ELSE 0 END) AS px FROM (
  SELECT vec_id, label, v, list_min(v) AS lo, list_max(v) AS hi FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)))"""
IMAGES_SQL = """size AS (SELECT p_partkey AS xref, CAST(round(p_retailprice * 100) AS BIGINT) AS size FROM part),
prev_i AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS xref FROM lineitem WHERE l_linenumber <= 4),
cand_i AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS xref FROM lineitem WHERE l_linenumber >= 4),
prev AS (SELECT o_orderkey AS page, CAST(coalesce(sum(size), 0) AS BIGINT) AS p FROM orders LEFT JOIN prev_i ON page = o_orderkey LEFT JOIN size USING (xref) GROUP BY 1),
cand AS (SELECT o_orderkey AS page, CAST(coalesce(sum(size), 0) AS BIGINT) AS c FROM orders LEFT JOIN cand_i ON page = o_orderkey LEFT JOIN size USING (xref) GROUP BY 1)"""
