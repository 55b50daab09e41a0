"""Snapshots of pages and images: probes, caches that hold only while counts agree, write-back by key, and sinks by phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.catalog import register
from quire.plans.shared import new_folder, spill
from quire.plans.tables import PIXELS_SQL, load, pixels
from quire.sources.files import discover

BROADCAST_PAGES = 1_000_000  # page numbers, 8 MB; beyond it the predicate's pages are joined by a shuffle
PRIVATE = ("/DecodeParms", "/Decode", "/ICCProfile")  # fixed values: entries that a new encoding makes wrong


def small(df: DataFrame, most: int = BROADCAST_PAGES) -> DataFrame:
    """df, to be broadcast if it has at most so many rows of a few bytes."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@register(
    "page_probe",
    r"""SELECT page_id AS page, regexp_matches(h, '>[^<]*[A-Za-z]') AS has_text, regexp_matches(h, '<(svg|path|canvas|table)') AS has_drawings,
  regexp_matches(h, '>[^<]*[A-Za-z]') OR regexp_matches(h, '<(svg|path|canvas|table)') AS mixed FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)""",
)
def page_probe(spark: SparkSession, sf_dir: str):
    """Whether a page has text, has drawings, either; the second pattern isn't looked for where the first is found."""
    h = F.coalesce("html", F.lit(""))
    text, drawings = h.rlike(">[^<]*[A-Za-z]"), h.rlike("<(svg|path|canvas|table)")
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), text.alias("has_text"), drawings.alias("has_drawings"), (text | drawings).alias("mixed"))


@register(
    "nested_images",
    """WITH direct AS (SELECT o_orderkey AS page, l_partkey AS xref FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'),
form AS (SELECT p_partkey AS form, p_partkey + 1 AS xref FROM part WHERE p_size % 2 = 0),
used AS (SELECT xref FROM direct UNION SELECT form.xref FROM direct JOIN form ON direct.xref = form.form)
SELECT p_partkey AS xref, p_size FROM part WHERE p_partkey IN (SELECT xref FROM used)""",
)
def nested_images(spark, sf_dir):
    """Images that mixed pages use, themselves or through a form one level down."""
    pages = load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("xref"), "p_size")
    direct = load(spark, sf_dir, "lineitem").join(pages, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("xref")).distinct()
    inside = part.where("p_size % 2 = 0").join(direct, "xref", "left_semi").select((F.col("xref") + 1).alias("xref"))
    return part.join(direct.union(inside).distinct(), "xref", "left_semi")


@register(
    "stream_cache",
    """WITH s AS (SELECT conv_id AS file, turn AS place, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations),
kept AS (SELECT file, ordinal, size FROM s WHERE NOT (file % 3 = 0 AND place = 1)),
n AS (SELECT file, count(*) AS now FROM s GROUP BY 1), m AS (SELECT file, count(*) AS before FROM kept GROUP BY 1)
SELECT s.file, s.place, CASE WHEN now = before THEN 'cache' ELSE 'scan' END AS taken_from, CASE WHEN now = before THEN kept.size ELSE s.size END AS size
FROM s JOIN n USING (file) LEFT JOIN m USING (file) LEFT JOIN kept ON kept.file = s.file AND kept.ordinal = s.ordinal AND now = before""",
)
def stream_cache(spark, sf_dir):
    """Streams of a file joined with those of an earlier scan by ordinal; a file whose counts differ is scanned again."""
    return reuse(*cache_sides(spark, sf_dir))


def cache_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("place"), F.octet_length("text").cast("long").alias("size"))
    return c, c.where("NOT (file % 3 = 0 AND place = 1)")


def reuse(now: DataFrame, before: DataFrame) -> DataFrame:
    """now, before: (file, place, size). A file's streams are in order of their place; ordinals are only made within a file."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        # a file's streams are gathered in an array, which numbers them and counts them at once
        rows = df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias(name))
        return rows.withColumn(f"n_{name}", F.size(name))

    both = numbered(now, "now").join(numbered(before, "before"), "file", "left")
    valid = F.col("n_now") == F.coalesce("n_before", F.lit(-1))
    each = both.select("file", valid.alias("valid"), F.when(valid, F.arrays_zip("now.place", "before.size")).otherwise(F.arrays_zip("now.place", "now.size")).alias("s"))
    each = each.select("file", "valid", F.explode("s").alias("s"))
    return each.select("file", F.col("s.place").alias("place"), F.when(F.col("valid"), "cache").otherwise("scan").alias("taken_from"), F.col("s.size").alias("size"))


@register(
    "candidate_pages",
    """SELECT l_orderkey AS page, l_linenumber AS slot, l_partkey AS xref FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus != 'F') AND l_returnflag != 'R'""",
)
def candidate_pages(spark, sf_dir):
    """Slots of the pages that a predicate found before; its pages prune the scan of slots, broadcast while they are few."""
    pages = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus != 'F'").select(F.col("o_orderkey").alias("page"))
    slots = load(spark, sf_dir, "lineitem").where("l_returnflag != 'R'").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("xref"))
    return slots.join(small(pages), "page", "left_semi")


@register(
    "tile_totals",
    """SELECT l_partkey AS image, CAST(sum(CAST(round(l_extendedprice * l_discount) AS BIGINT)) AS BIGINT) AS encoded, CAST(max(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS original
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING sum(CAST(round(l_extendedprice * l_discount) AS BIGINT)) < max(CAST(round(p_retailprice * 100) AS BIGINT))""",
)
def tile_totals(spark, sf_dir):
    """Images whose tiles, encoded one by one, are smaller together than the image was."""
    tiles = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("image")).agg(F.sum(F.round(F.col("l_extendedprice") * F.col("l_discount")).cast("long")).alias("encoded"))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.round(F.col("p_retailprice") * 100).cast("long").alias("original"))
    return tiles.join(part, "image").where("encoded < original")


def write_back(objects: DataFrame, results: DataFrame) -> DataFrame:
    """objects(xref, filter, length, attrs) with results(xref, mode, new_length) where there are any: the new encoding's filter and length, without entries that it makes wrong."""
    new = objects.join(results, "xref", "left")
    mode = F.col("mode")
    name = F.when(mode == "MONO", "/FlateDecode").when(mode.isNotNull(), "/JPXDecode").otherwise(F.col("filter"))
    bare = F.map_filter("attrs", lambda k, _: ~k.isin(*PRIVATE))
    bits = F.when(mode == "MONO", F.map_concat(F.map_filter(bare, lambda k, _: k != "/BitsPerComponent"), F.create_map(F.lit("/BitsPerComponent"), F.lit("1")))).when(mode.isNotNull(), bare)
    return new.select("xref", name.alias("filter"), F.coalesce("new_length", "length").alias("length"), F.coalesce(bits, F.col("attrs")).alias("attrs"))


@register(
    "image_write_back",
    """WITH o AS (SELECT p_partkey AS xref, CASE WHEN p_size % 3 = 0 THEN '/DCTDecode' ELSE '/FlateDecode' END AS filter, CAST(round(p_retailprice * 100) AS BIGINT) AS length, p_size FROM part),
r AS (SELECT xref, CASE WHEN p_size % 4 = 0 THEN 'MONO' ELSE 'JP2' END AS mode, length // 2 AS new_length FROM o WHERE p_size % 2 = 0)
SELECT o.xref, CASE WHEN mode = 'MONO' THEN '/FlateDecode' WHEN mode = 'JP2' THEN '/JPXDecode' ELSE filter END AS filter, coalesce(new_length, length) AS length,
  CASE WHEN mode = 'MONO' THEN '/BitsPerComponent=1 /Width=' || p_size WHEN mode = 'JP2' THEN '/BitsPerComponent=8 /Width=' || p_size ELSE '/BitsPerComponent=8 /DecodeParms=x /Width=' || p_size END AS attrs
FROM o LEFT JOIN r USING (xref)""",
)
def image_write_back(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    length = F.round(F.col("p_retailprice") * 100).cast("long")
    attrs = F.create_map(F.lit("/BitsPerComponent"), F.lit("8"), F.lit("/DecodeParms"), F.lit("x"), F.lit("/Width"), F.col("p_size").cast("string"))
    objects = part.select(F.col("p_partkey").alias("xref"), F.when(F.col("p_size") % 3 == 0, "/DCTDecode").otherwise("/FlateDecode").alias("filter"), length.alias("length"), attrs.alias("attrs"))
    results = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("xref"), F.when(F.col("p_size") % 4 == 0, "MONO").otherwise("JP2").alias("mode"), F.floor(length / 2).alias("new_length"))
    entries = F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return write_back(objects, results).withColumn("attrs", F.array_join(entries, " "))


def write_pages(pages: DataFrame, path: str) -> None:
    """pages(page, ...) in files of ascending, disjoint ranges of page, sorted inside: reading the files by name gives page order."""
    pages.repartitionByRange("page").sortWithinPartitions("page").write.mode("errorifexists").parquet(path)


@register("pages_in_order", "SELECT o_orderkey AS page, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders")
def pages_in_order(spark, sf_dir):
    """Pages written in ascending order and read back."""
    pages = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"))
    path = new_folder(spark, "pages")
    write_pages(pages, path)
    return spark.read.schema(pages.schema).parquet(path)


def target(path: Column, phase: Column) -> Column:
    """Where a file's result goes: in place unless it was made with loss, which goes beside it as _opted."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    suffix = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.when(phase == "lossy", F.concat(stem, F.lit("_opted"), suffix)).otherwise(path)


@register(
    "phase_sink",
    """WITH d AS (SELECT doc_id, 'in/d.' || (doc_id % 5) || '/f' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '.pdf' END AS path, strlen(text) AS n, strlen(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS less FROM documents),
p AS (SELECT *, CASE WHEN n <= 800 THEN 'untouched' WHEN less <= 800 OR less < n THEN 'lossless' ELSE 'lossy' END AS phase FROM d)
SELECT doc_id, phase, CASE WHEN phase != 'lossy' THEN path WHEN doc_id % 7 = 0 THEN path || '_opted' ELSE regexp_replace(path, '\\.pdf$', '_opted.pdf') END AS target, CASE phase WHEN 'untouched' THEN n WHEN 'lossless' THEN less ELSE n // 2 END AS size FROM p""".replace("\\\\", "\\"),
)
def phase_sink(spark, sf_dir, limit: int = 800):
    """Each file's phase, where its result goes and how large it is, written as a snapshot and read back."""
    d = load(spark, sf_dir, "documents")
    path = F.concat(F.lit("in/d."), (F.col("doc_id") % 5).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(".pdf"))
    d = d.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("n"), F.octet_length(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).cast("long").alias("less"))
    d = d.withColumn("phase", F.when(F.col("n") <= limit, "untouched").when((F.col("less") <= limit) | (F.col("less") < F.col("n")), "lossless").otherwise("lossy"))
    size = F.expr("CASE phase WHEN 'untouched' THEN n WHEN 'lossless' THEN less ELSE n DIV 2 END")
    return spill(d.select("doc_id", "phase", target(F.col("path"), F.col("phase")).alias("target"), size.alias("size")), "phase-sink")


@register(
    "region_render",
    f"""WITH {PIXELS_SQL}, r AS (SELECT vec_id, list_filter(list_transform(range(64), lambda i: CASE WHEN i // 8 BETWEEN 1 AND 3 AND i % 8 BETWEEN 2 AND 5 THEN px[i + 1] END), lambda x: x IS NOT NULL) AS part FROM px)
SELECT vec_id, CAST(len(part) AS INTEGER) AS n, CAST(list_sum(part) AS BIGINT) AS total, array_to_string(part, ' ') AS region FROM r""",
)
def region_render(spark, sf_dir, rows: tuple = (1, 3), columns: tuple = (2, 5)):
    """A region of each image, row by row, as the stages' visual check cuts it."""
    inside = F.array(*(F.lit(8 * y + x) for y in range(rows[0], rows[1] + 1) for x in range(columns[0], columns[1] + 1)))
    part = pixels(spark, sf_dir).select("vec_id", F.transform(inside, lambda i: F.get("px", i)).alias("part"))
    total = F.aggregate("part", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return part.select("vec_id", F.size("part").alias("n"), total.alias("total"), F.array_join(F.transform("part", lambda x: x.cast("string")), " ").alias("region"))


@register("explicit_files")
def explicit_files(spark, sf_dir):
    """A list of files, one of which is missing: it counts 0 MB and is passed over."""
    wanted = ["part.parquet", "orders.parquet", "missing.parquet"]
    return file_sizes(spark, sf_dir, wanted)


def file_sizes(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(name, mb, valid) of the names; what isn't there has 0 MB."""
    there = discover(spark, folder, "").select(F.substring_index("path", "/", -1).alias("name"), "length")
    named = spark.createDataFrame([(n,) for n in names], "name string").join(there, "name", "left")
    size = F.coalesce("length", F.lit(0))
    return named.select("name", F.round(size / 1048576, 6).alias("mb"), (size >= 1024).alias("valid"))
