"""Snapshot guards: payloads, comparisons, rollbacks, reference checks and acceptance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quire.catalog import register
from quire.plans.shared import spill
from quire.plans.tables import CAND, IMAGES_SQL, PREV, all_pages, image_sizes, load, page_images


def payload(images: DataFrame, sizes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, n_images, payload): the sum over a page's distinct images; an unknown size counts 0, a page without images 0."""
    sums = images.join(sizes, "xref", "left").groupBy("page").agg(F.count("*").alias("n_images"), F.sum(F.coalesce("size", F.lit(0))).alias("payload"))
    zero = F.lit(0).cast("long")
    return pages.join(sums, "page", "left").select("page", F.coalesce("n_images", zero).alias("n_images"), F.coalesce("payload", zero).alias("payload"))


def worse_pages(prev: DataFrame, cand: DataFrame, tolerance: int = 0) -> DataFrame:
    """Pages whose candidate payload exceeds the previous one by more than tolerance."""
    p = prev.select("page", F.col("payload").alias("prev_payload"))
    c = cand.select("page", F.col("payload").alias("cand_payload"))
    return p.join(c, "page").where(F.col("cand_payload") > F.col("prev_payload") + tolerance)


@register(
    "page_payload",
    """WITH size AS (SELECT p_partkey AS xref, CAST(round(p_retailprice * 100) AS BIGINT) AS size FROM part),
i AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS xref FROM lineitem)
SELECT o_orderkey AS page, count(xref) AS n_images, CAST(coalesce(sum(size), 0) AS BIGINT) AS payload
FROM orders LEFT JOIN i ON page = o_orderkey LEFT JOIN size USING (xref) GROUP BY 1""",
)
def page_payload(spark, sf_dir):
    return payload(page_images(spark, sf_dir), image_sizes(spark, sf_dir), all_pages(spark, sf_dir))


@register("page_payload_guard", f"WITH {IMAGES_SQL} SELECT page, p AS prev_payload, c AS cand_payload FROM prev JOIN cand USING (page) WHERE c > p")
def page_payload_guard(spark, sf_dir):
    """One scan: a page's images have a flag for either snapshot. A page without images is never worse."""
    paid = lambda flag, name: F.coalesce(F.sum(F.when(F.col(flag), F.col("size"))), F.lit(0)).cast("long").alias(name)
    sums = flagged_images(spark, sf_dir).groupBy("page").agg(paid("in_prev", "prev_payload"), paid("in_cand", "cand_payload"))
    return sums.where("cand_payload > prev_payload").join(all_pages(spark, sf_dir), "page", "left_semi")


def flagged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, xref, in_prev, in_cand, size): an image once a page, with the snapshots that it is in."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("xref"), F.expr(PREV).alias("p"), F.expr(CAND).alias("c"))
    each = lines.groupBy("page", "xref").agg(F.bool_or("p").alias("in_prev"), F.bool_or("c").alias("in_cand"))
    return each.join(image_sizes(spark, sf_dir), "xref", "left")


def replace_pages(prev_images: DataFrame, cand_images: DataFrame, bad: DataFrame) -> DataFrame:
    """The candidate's images, with those of the bad pages taken from the previous snapshot."""
    pages = bad.select("page").distinct()
    kept = cand_images.join(pages, "page", "left_anti").withColumn("origin", F.lit("cand"))
    back = prev_images.join(pages, "page", "left_semi").withColumn("origin", F.lit("prev"))
    return kept.unionByName(back)


@register(
    "page_rollback_snapshot",
    f"""WITH {IMAGES_SQL}, bad AS (SELECT page FROM prev JOIN cand USING (page) WHERE c > p)
SELECT page, xref, 'cand' AS origin FROM cand_i WHERE page NOT IN (SELECT page FROM bad)
UNION ALL SELECT page, xref, 'prev' AS origin FROM prev_i WHERE page IN (SELECT page FROM bad)""",
)
def page_rollback_snapshot(spark, sf_dir):
    """The sums over a page stand beside its images, so each image knows from which snapshot its page is taken."""
    paid = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("size"))).over(W.partitionBy("page")), F.lit(0))
    each = flagged_images(spark, sf_dir).withColumn("worse", paid("in_cand") > paid("in_prev"))
    kept = each.where((F.col("worse") & F.col("in_prev")) | (~F.col("worse") & F.col("in_cand")))
    return kept.select("page", "xref", F.when(F.col("worse"), "prev").otherwise("cand").alias("origin"))


def rollback_to_fixpoint(prev_images, cand_images, sizes, pages, tolerance: int = 0, rounds: int = 3, skip: DataFrame | None = None):
    """Roll pages back until none is worse, rounds times at most -> (images, flagged pages). Pages in skip are left alone.

    Pages that are worse are written after each round, so the plan of the next doesn't hold those before twice.
    """
    prev = spill(payload(prev_images, sizes, pages), "payloads")
    flagged = pages.limit(0).select("page")
    now = cand_images
    for _ in range(rounds):
        bad = worse_pages(prev, payload(now, sizes, pages), tolerance).select("page")
        bad = spill(bad.join(skip, "page", "left_anti") if skip is not None else bad, "worse-pages")
        if bad.isEmpty():
            break
        flagged = flagged.union(bad)
        now = replace_pages(prev_images, now, bad).drop("origin")
    return now, flagged.distinct()


@register(
    "rollback_fixpoint",
    f"WITH {IMAGES_SQL} SELECT page, least(p, c) AS payload, c > p AS rolled_back FROM prev JOIN cand USING (page)",
)
def rollback_fixpoint(spark, sf_dir):
    sizes, pages = image_sizes(spark, sf_dir), all_pages(spark, sf_dir)
    images, flagged = rollback_to_fixpoint(page_images(spark, sf_dir, PREV), page_images(spark, sf_dir, CAND), sizes, pages)
    out = payload(images, sizes, pages).join(flagged.withColumn("hit", F.lit(True)), "page", "left")
    return out.select("page", "payload", F.coalesce("hit", F.lit(False)).alias("rolled_back"))


def slots(spark, sf_dir, part) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").where(part).select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("xref"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size")).distinct()
    return lines.withColumn("slot", F.row_number().over(W.partitionBy("page").orderBy("size", "xref")) - 1).select("page", "slot", "size")


@register(
    "stream_slot_guard",
    """WITH s AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS xref, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_linenumber <= 4 AS a, l_linenumber >= 4 AS b FROM lineitem),
p AS (SELECT page, size, row_number() OVER (PARTITION BY page ORDER BY size, xref) - 1 AS slot FROM (SELECT DISTINCT page, xref, size FROM s WHERE a)),
c AS (SELECT page, size, row_number() OVER (PARTITION BY page ORDER BY size, xref) - 1 AS slot FROM (SELECT DISTINCT page, xref, size FROM s WHERE b))
SELECT page, CAST(slot AS INTEGER) AS slot, p.size AS prev_size, c.size AS cand_size FROM p JOIN c USING (page, slot) WHERE c.size > p.size + 64""",
)
def stream_slot_guard(spark, sf_dir):
    """Streams compared by (page, slot); the inner join is the rule of the smaller count."""
    p = slots(spark, sf_dir, PREV).withColumnRenamed("size", "prev_size")
    c = slots(spark, sf_dir, CAND).withColumnRenamed("size", "cand_size")
    return p.join(c, ["page", "slot"]).where("cand_size > prev_size + 64")


@register(
    "arity_guard",
    """SELECT count(DISTINCT l_orderkey) FILTER (l_linenumber <= 4) AS prev_pages, count(DISTINCT l_orderkey) FILTER (l_linenumber >= 4) AS cand_pages,
count(DISTINCT l_orderkey) FILTER (l_linenumber <= 4) = count(DISTINCT l_orderkey) FILTER (l_linenumber >= 4) AS comparable FROM lineitem""",
)
def arity_guard(spark, sf_dir):
    pages = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.expr(PREV)).alias("p"), F.bool_or(F.expr(CAND)).alias("c"))
    return pages.agg(F.count_if("p").alias("prev_pages"), F.count_if("c").alias("cand_pages")).withColumn("comparable", F.expr("prev_pages = cand_pages"))


REFS_SQL = """refs AS (SELECT DISTINCT l_orderkey AS page, '/XObject' AS kind, CAST(l_partkey AS VARCHAR) AS name FROM lineitem WHERE l_linenumber >= 4
  UNION SELECT DISTINCT l_orderkey, '/ExtGState', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_linenumber >= 4),
have AS (SELECT DISTINCT l_orderkey AS page, '/XObject' AS kind, CAST(l_partkey AS VARCHAR) AS name FROM lineitem WHERE l_linenumber <= 4
  UNION SELECT DISTINCT l_orderkey, '/ExtGState', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_linenumber <= 4)"""


def resources(spark, sf_dir, part) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").where(part)
    kinds = F.array(
        F.struct(F.lit("/XObject").alias("kind"), F.col("l_partkey").cast("string").alias("name")),
        F.struct(F.lit("/ExtGState").alias("kind"), F.col("l_suppkey").cast("string").alias("name")),
    )
    return lines.select(F.col("l_orderkey").alias("page"), F.inline(kinds)).distinct()


@register("missing_resources", f"WITH {REFS_SQL} SELECT * FROM refs EXCEPT SELECT * FROM have")
def missing_resources(spark, sf_dir):
    """Names that the candidate's streams refer to and the previous page doesn't have."""
    return resources(spark, sf_dir, CAND).join(resources(spark, sf_dir, PREV), ["page", "kind", "name"], "left_anti")


@register(
    "inject_all_or_nothing",
    """WITH refs AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS slot, l_suppkey FROM lineitem WHERE l_linenumber >= 4),
miss AS (SELECT r.* FROM refs r WHERE NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey = r.page AND h.l_suppkey = r.l_suppkey AND h.l_linenumber <= 3)),
f AS (SELECT page, slot, l_suppkey, s_acctbal IS NOT NULL AS ok FROM miss LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey)
SELECT page, slot, count(*) AS injected FROM f GROUP BY 1, 2 HAVING bool_and(ok)""",
)
def inject_all_or_nothing(spark, sf_dir):
    """Missing entries are copied only for streams of which every missing entry is found: decided before anything is copied."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("slot"), "l_suppkey")
    have = lines.where("slot <= 3").select("page", "l_suppkey").distinct()
    missing = lines.where("slot >= 4").distinct().join(have, ["page", "l_suppkey"], "left_anti")
    source = load(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("ok"))
    found = missing.join(source, "l_suppkey", "left").groupBy("page", "slot").agg(F.count("*").alias("injected"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_ok"))
    return found.where("all_ok").drop("all_ok")


@register(
    "stream_rollback",
    """WITH s AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS xref, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_linenumber <= 4 AS a, l_linenumber >= 4 AS b FROM lineitem),
p AS (SELECT page, xref, size, row_number() OVER (PARTITION BY page ORDER BY size, xref) - 1 AS slot FROM (SELECT DISTINCT page, xref, size FROM s WHERE a)),
c AS (SELECT page, xref, size, row_number() OVER (PARTITION BY page ORDER BY size, xref) - 1 AS slot FROM (SELECT DISTINCT page, xref, size FROM s WHERE b)),
w AS (SELECT page, slot, p.xref IN (SELECT p_partkey FROM part WHERE p_size >= 10) AS safe FROM p JOIN c USING (page, slot) WHERE c.size > p.size + 64)
SELECT page, count(*) FILTER (safe) AS rolled, count(*) FILTER (NOT safe) AS refused FROM w GROUP BY page""",
)
def stream_rollback(spark, sf_dir):
    """Worse streams go back if their resources can be served; per page, how many did and how many were refused."""

    def full(part):
        lines = load(spark, sf_dir, "lineitem").where(part).select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("xref"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size")).distinct()
        return lines.withColumn("slot", F.row_number().over(W.partitionBy("page").orderBy("size", "xref")) - 1)

    p, c = full(PREV), full(CAND).select("page", "slot", F.col("size").alias("cand_size"))
    worse = p.join(c, ["page", "slot"]).where("cand_size > size + 64")
    ok = load(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("xref"), F.lit(True).alias("safe"))
    marked = worse.join(ok, "xref", "left").withColumn("safe", F.coalesce("safe", F.lit(False)))
    return marked.groupBy("page").agg(F.count_if("safe").alias("rolled"), F.count_if(~F.col("safe")).alias("refused"))


@register(
    "inherited_resources",
    """WITH RECURSIVE t AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 2 END AS parent, CASE WHEN n_nationkey % 4 = 0 THEN n_name END AS res FROM nation),
w AS (SELECT node AS leaf, parent, res, 0 AS hops FROM t UNION ALL SELECT w.leaf, t.parent, t.res, w.hops + 1 FROM w JOIN t ON t.node = w.parent WHERE w.res IS NULL AND w.hops < 32)
SELECT leaf AS node, res AS resources, hops FROM w WHERE res IS NOT NULL""",
)
def inherited_resources(spark, sf_dir, hops: int = 32):
    """The first resources on the way up a page tree, at most hops parents away (a tree of nations stands in)."""
    key = F.col("n_nationkey")
    tree = load(spark, sf_dir, "nation").select(key.alias("node"), F.when(key > 0, F.expr("(n_nationkey - 1) DIV 2").cast("int")).alias("parent"), F.when(key % 4 == 0, F.col("n_name")).alias("res")).cache()
    open_ = tree.select("node", "parent", "res")
    done = []
    for n in range(hops + 1):
        done.append(open_.where("res IS NOT NULL").select("node", F.col("res").alias("resources"), F.lit(n).alias("hops")))
        rest = open_.where("res IS NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("up"))
        if rest.isEmpty():
            break
        open_ = rest.join(tree.select(F.col("node").alias("up"), "parent", "res"), "up").select("node", "parent", "res").cache()
    return reduce(DataFrame.union, done)


@register(
    "mixed_pages_semi",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)",
)
def mixed_pages_semi(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    mixed = labels.where("quality = 1").select("doc_id").union(labels.where("toxic = 1").select("doc_id")).distinct()
    return load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(mixed, "doc_id", "left_semi")


@register("pure_pages_anti", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1")
def pure_pages_anti(spark, sf_dir):
    mixed = load(spark, sf_dir, "labels").where("quality = 1 OR toxic = 1").select("doc_id")
    return load(spark, sf_dir, "documents").select("doc_id").subtract(mixed)


@register(
    "stream_candidates",
    r"""SELECT page_id AS xref, strlen(html) AS raw_len FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '/FlateDecode' ELSE '/DCTDecode' END AS filter FROM pages)
WHERE strlen(html) >= 2048 AND (filter IS NULL OR filter = '/FlateDecode') AND NOT regexp_matches(html, '(^|\s)BI(\s|$)') AND NOT contains(url, '/Image') AND NOT contains(url, '/Font')""",
)
def stream_candidates(spark, sf_dir):
    kind = F.expr("CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '/FlateDecode' ELSE '/DCTDecode' END")
    pages = load(spark, sf_dir, "pages").withColumn("filter", kind)
    fine = (F.octet_length("html") >= 2048) & (F.col("filter").isNull() | (F.col("filter") == "/FlateDecode"))
    subtype = F.coalesce("url", F.lit(""))
    fine = fine & ~subtype.contains("/Image") & ~subtype.contains("/Font") & ~F.col("html").rlike(r"(^|\s)BI(\s|$)")
    return pages.where(fine).select(F.col("page_id").alias("xref"), F.octet_length("html").cast("long").alias("raw_len"))


SHORT_SQL = "s AS (SELECT doc_id, strlen(text) AS old_len, strlen(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS new_len FROM documents)"


def shortened(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("old_len"), F.octet_length(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).cast("long").alias("new_len"))


@register("accept_if_smaller", f"WITH {SHORT_SQL} SELECT doc_id, old_len, CASE WHEN new_len < old_len AND old_len >= 64 THEN new_len ELSE old_len END AS kept_len, new_len < old_len AND old_len >= 64 AS improved FROM s")
def accept_if_smaller(spark, sf_dir):
    better = F.expr("new_len < old_len AND old_len >= 64")
    return shortened(spark, sf_dir).select("doc_id", "old_len", F.when(better, F.col("new_len")).otherwise(F.col("old_len")).alias("kept_len"), better.alias("improved"))


@register("improved_summary", f"WITH {SHORT_SQL} SELECT count(*) AS n, CAST(sum(old_len) AS BIGINT) AS total, count(*) FILTER (new_len < old_len) AS improved, CAST(coalesce(sum(old_len - new_len) FILTER (new_len < old_len), 0) AS BIGINT) AS saved FROM s")
def improved_summary(spark, sf_dir):
    return shortened(spark, sf_dir).agg(
        F.count("*").alias("n"), F.sum("old_len").alias("total"), F.count_if(F.expr("new_len < old_len")).alias("improved"), F.coalesce(F.sum(F.expr("CASE WHEN new_len < old_len THEN old_len - new_len END")), F.lit(0).cast("long")).alias("saved")
    )


@register("snapshot_accept", f"WITH {SHORT_SQL}, t AS (SELECT CAST(sum(old_len) AS BIGINT) AS old_bytes, CAST(sum(least(old_len, new_len)) AS BIGINT) AS new_bytes FROM s) SELECT *, new_bytes / 1048576 > 0.01 AND new_bytes < old_bytes AS accepted FROM t")
def snapshot_accept(spark, sf_dir):
    total = shortened(spark, sf_dir).agg(F.sum("old_len").alias("old_bytes"), F.sum(F.least("old_len", "new_len")).alias("new_bytes"))
    return total.withColumn("accepted", (F.col("new_bytes") / 1048576 > 0.01) & (F.col("new_bytes") < F.col("old_bytes")))


@register(
    "prune_attributes",
    "SELECT event_id, list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('ref', 'DecodeParms', 'Decode', 'ICCProfile', 'PieceInfo'))) AS kept FROM events",
)
def prune_attributes(spark, sf_dir):
    """Private entries are dropped from an attribute map."""
    kept = F.filter(F.json_object_keys("props"), lambda k: ~k.isin("ref", "DecodeParms", "Decode", "ICCProfile", "PieceInfo"))
    return load(spark, sf_dir, "events").select("event_id", F.array_sort(kept).alias("kept"))


@register(
    "image_filters",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice) AS BIGINT) <= 2000000
AND l_discount * 100 >= 2 AND l_quantity / (l_linenumber + 1) > 0.3 AND l_quantity / (l_linenumber + 1) < 3.0 AND l_returnflag != 'R' GROUP BY 1, 2""",
)
def image_filters(spark, sf_dir):
    """Pixel-count guard, least size, aspect ratio and mask exclusion over stand-in columns."""
    lines = load(spark, sf_dir, "lineitem")
    aspect = F.col("l_quantity") / (F.col("l_linenumber") + 1)
    fine = (F.col("l_quantity").cast("long") * F.round("l_extendedprice").cast("long") <= 2_000_000) & (F.col("l_discount") * 100 >= 2)
    return lines.where(fine & (aspect > 0.3) & (aspect < 3.0) & (F.col("l_returnflag") != "R")).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
