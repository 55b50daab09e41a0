"""Sources and sinks: discovery of files, validity, and images as PGM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.catalog import register
from quire.plans.tables import PIXELS_SQL, pixels


def discover(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, length) of files below folder whose base name ends in suffix, whatever its case, and isn't an output or a temporary one. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.lower(F.substring_index("path", "/", -1))
    return files.where(name.endswith(suffix.lower()) & ~name.contains("_opted") & ~name.contains(".tmp"))


def explicit(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "length")


@register("file_discovery")
def file_discovery(spark, sf_dir):
    """Tables' files with their sizes in MB and whether they are large enough to be valid (a size check, no more)."""
    found = discover(spark, sf_dir, ".parquet")
    return found.select(F.substring_index("path", "/", -1).alias("name"), "length", F.round(F.col("length") / 1048576, 6).alias("mb"), (F.col("length") >= 1024).alias("valid"))


@register("pgm_encode", f"WITH {PIXELS_SQL} SELECT vec_id, 'P5 8 8 255 ' || array_to_string(list_transform(px, lambda x: lower(lpad(to_hex(x), 2, '0'))), '') AS image FROM px")
def pgm_encode(spark, sf_dir):
    """An 8 x 8 image as header and bytes (shown in hex)."""
    body = F.array_join(F.transform("px", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return pixels(spark, sf_dir).select("vec_id", F.concat(F.lit("P5 8 8 255 "), body).alias("image"))


def write_pgm(images: DataFrame, path: str) -> None:
    """images(name, width, height, px array<int>) as rows (name, content) of Parquet, content being a binary PGM."""
    head = F.encode(F.concat_ws(" ", F.lit("P5"), F.col("width").cast("string"), F.col("height").cast("string"), F.lit("255\n")), "US-ASCII")
    body = F.unhex(F.array_join(F.transform("px", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    images.select("name", F.concat(head, body).alias("content")).write.mode("overwrite").parquet(path)
