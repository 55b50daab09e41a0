"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base kinds (assign, access, hex) are found by their patterns. Three weak kinds come on top: identifiers by name
(weak_id), long mixed-case runs with digits (weak_secret) and addresses (endpoint). A weak candidate is reported
only if complementary parts start within SCOPE code points of its own start: an identifier needs a secret, a
secret an identifier, an endpoint both. The link is an interval join on (row, start / SCOPE): per bucket and role
only the first and last start take part, which is all that the test needs, so no bucket makes pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.llm.common import spill

SCOPE = 256
# fixed values: the contract's patterns, letters of the names in either case
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = "(" + NAMES + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
WEAK_ID = "([Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]{4,})"
WEAK_SECRET = "[A-Za-z0-9+/]{32,}"
ENDPOINT = "[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SPAN = "array<struct<start:int,ord:int,end:int,ok:boolean>>"
FOLD = 256  # matches of a text that are folded together
PIECE = 1024  # code points of the pieces from which a masked text is put together
BROADCAST_ROWS, BROADCAST_SPANS = 50_000, 400_000  # masked rows and their spans, some 10 MB; beyond it rows that can hold a secret are joined by a shuffle


def fold(parts: Column, step, out_type: str) -> Column:
    """struct(at int, out) after step(acc, part) has seen all parts in order; step gives (at, array of what to append).

    An array can't grow in place, so parts are folded FOLD at a time and a text's blocks are flattened at the end:
    n parts take n * FOLD + (n / FOLD)^2 copies, not n^2.
    """
    zero = lambda at: F.struct(at.alias("at"), F.array().cast(out_type).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        at, new = step(acc, x)
        return F.struct(at.alias("at"), F.concat(acc["out"], new).alias("out"))

    def block(acc: Column, number: Column) -> Column:
        inner = F.aggregate(F.slice(parts, number * FOLD + 1, F.lit(FOLD)), zero(acc["at"]), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / FOLD).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{out_type}>").alias("out"))
    return F.aggregate(blocks, start, block, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


def spans(text: Column, pattern: str, number: int, ok: Column | None = None, first: str | None = None) -> Column:
    """(start, ord, end, ok) of all leftmost non-overlapping matches, in code points: lengths of the pieces between and of the matches, summed up."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    fine = ok if ok is not None else F.transform(matches, lambda x: F.lit(True))
    parts = F.arrays_zip(
        F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(matches)).alias("gap"),
        F.transform(matches, F.length).alias("len"),
        fine.alias("ok"),
    )

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        one = F.struct(start.alias("start"), F.lit(number).alias("ord"), end.alias("end"), x["ok"].alias("ok"))
        return end, F.array(one)

    found = F.filter(fold(parts, step, SPAN)["out"], lambda x: x["ok"])
    return F.when(text.rlike(first or pattern), found).otherwise(F.array().cast(SPAN))


def digest(found: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    name = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(name, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(found), one))


def base_and_weak(text: Column) -> tuple[Column, Column]:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    base = F.concat(
        spans(text, ASSIGN, 0, F.transform(values, lambda x: F.length(x) >= 6)),
        spans(text, ACCESS, 1),
        spans(text, "(?<![0-9a-f])" + HEX, 2),
    )
    runs = F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9+/])" + WEAK_SECRET), F.lit(0))
    mixed = F.transform(runs, lambda x: x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]"))
    weak = F.concat(
        spans(text, WEAK_ID, 3),
        spans(text, "(?<![A-Za-z0-9+/])" + WEAK_SECRET, 4, mixed),
        spans(text, ENDPOINT, 5),
    )
    return base, weak


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, base and all spans (arrays of start, ord, end, ok) of every row, by id and text.

    A null text is empty and has no spans. Rows with a null id count as rows of their own text; repeated rows
    each come out, with equal spans. Extra columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    base, weak = base_and_weak(F.col("t"))
    found = spill(rows.select("doc_id", F.xxhash64("t").alias("k"), base.alias("base"), weak.alias("weak")), "secret-spans")
    open_ = found.where(F.size("weak") > 0).dropDuplicates(["doc_id", "k"])
    each = open_.select("doc_id", "k", F.explode(F.concat("base", "weak")).alias("x"))
    # the weak runs that overlap a base span or an identifier say nothing new
    strong = F.col("x.ord") < 4
    ahead = W.partitionBy("doc_id", "k").orderBy("x.start", "x.ord").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("doc_id", "k").orderBy(F.desc("x.start"), F.desc("x.ord")).rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("e", F.max(F.when(strong, F.col("x.end"))).over(ahead)).withColumn("s", F.min(F.when(strong, F.col("x.start"))).over(behind))
    each = each.where("x.ord != 4 OR NOT (coalesce(e > x.start, false) OR coalesce(s < x.end, false))").drop("e", "s")
    role = F.when(F.col("x.ord").isin(1, 3), "id").when(F.col("x.ord").isin(0, 2, 4), "secret")
    parts = (
        each.select("doc_id", "k", role.alias("role"), F.col("x.start").alias("start"))
        .where("role IS NOT NULL")
        .groupBy("doc_id", "k", "role", F.floor(F.col("start") / scope).alias("own"))
        .agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
        .select("doc_id", "k", "role", "lo", "hi", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("bucket"))
    )
    ask = each.where("x.ord >= 3").withColumn("bucket", F.floor(F.col("x.start") / scope))
    p, q = parts.alias("p"), ask.alias("q")
    near = (F.abs(F.col("p.lo") - F.col("q.x.start")) <= scope) | (F.abs(F.col("p.hi") - F.col("q.x.start")) <= scope)
    linked = (
        q.join(p, F.col("p.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("p.k") == F.col("q.k")) & (F.col("p.bucket") == F.col("q.bucket")) & near)
        .groupBy("q.doc_id", "q.k", "q.x")
        .agg(F.bool_or(F.col("role") == "id").alias("has_id"), F.bool_or(F.col("role") == "secret").alias("has_secret"))
        .where("(x.ord = 3 AND has_secret) OR (x.ord = 4 AND has_id) OR (x.ord = 5 AND has_id AND has_secret)")
        .groupBy(F.col("doc_id").alias("wid"), F.col("k").alias("wk"))
        .agg(F.array_sort(F.collect_list("x")).alias("more"))  # of one text: bounded by its length
    )
    none = F.array().cast(SPAN)
    return found.join(linked, F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("k") == F.col("wk")), "left").select(
        "doc_id", "k", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans")
    )


def secret_scan(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    n = lambda o: F.size(F.filter("base", lambda x: x["ord"] == o)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


def can_hold(text: Column) -> Column:
    """False only for texts without any span: a linked one needs an identifier and a secret."""
    weak = text.rlike(WEAK_ID) & text.rlike(WEAK_SECRET)
    return F.coalesce(text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | weak, F.lit(False))


def masked(text: Column, gaps: Column, tail: Column, mark: str) -> Column:
    """text's gaps (start, end) with a mark behind each, and what is left from tail on, in time linear in the text and the gaps."""
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))

    def part(pieces: Column, start: Column, end: Column) -> Column:
        low, high = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        whole = F.array_join(F.slice(pieces, low + 2, F.greatest(high - low - 1, F.lit(0))), "")
        across = F.concat(F.substring(at(low), start % PIECE + 1, F.lit(PIECE)), whole, F.substring(at(high), F.lit(1), end % PIECE))
        return F.when(low == high, F.substring(at(low), start % PIECE + 1, end - start)).otherwise(across)

    # a fold over one element binds the pieces, so they are cut once a text
    once = lambda found: F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(part(found, g["start"], g["end"]), F.lit(mark))), ""), part(found, tail, F.length(text)))
    return F.get(F.transform(F.array(pieces), once), F.lit(0))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every base or linked span replaced by mark; overlapping spans become one. Rows without spans stay as they are, null texts too.

    The spans are broadcast while they are few (BROADCAST_ROWS, BROADCAST_SPANS); beyond that only rows that can hold a secret are shuffled.
    """
    spans_of = scan(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "k"])

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        gap = F.struct(acc["at"].alias("start"), x["start"].alias("end"))
        return F.greatest(acc["at"], x["end"]), F.when(x["start"] >= acc["at"], F.array(gap)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    spans_of = spans_of.select(
        F.col("doc_id").alias("__quire_id"), F.col("k").alias("__quire_key"), fold(F.col("spans"), step, "array<struct<start:int,end:int>>").alias("__quire_kept")
    )
    spans_of = spill(spans_of, "masks")
    size = spans_of.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("__quire_kept.out")), F.lit(0)).alias("spans")).first()
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("__quire_id")) & (key == F.col("__quire_key"))
    if size.rows <= BROADCAST_ROWS and size.spans <= BROADCAST_SPANS:
        joined = docs.join(F.broadcast(spans_of), same, "left")
    else:
        gate = can_hold(F.col("text").cast("string"))
        clean = docs.where(~gate)
        for f in spans_of.schema.fields:
            clean = clean.withColumn(f.name, F.lit(None).cast(f.dataType))
        joined = docs.where(gate).join(spans_of, same, "left").unionByName(clean)
    kept = F.col("__quire_kept")
    text = F.when(kept.isNull(), F.col("text")).otherwise(masked(F.col("text").cast("string"), kept["out"], kept["at"], mark))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(kept.isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")))
    return joined.withColumn("text", text).select(*docs.columns)


def oracle() -> str:
    """DuckDB's twin of secret_scan."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    ok = {0: "length(regexp_extract(m[i], " + lit(ASSIGN) + ", 2)) >= 6", 4: "regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[0-9]')"}
    each = "\nUNION ALL\n".join(
        f"""SELECT doc_id, {o} AS ord, s, s + length(m[i]) AS e FROM (
  SELECT doc_id, m, i, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, {lit(x)}) AS m, string_split_regex(t, {lit(x)}) AS p FROM d WHERE regexp_matches(t, {lit(x)}))))
WHERE {ok.get(o, 'true')}"""
        for o, x in enumerate((ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT))
    )
    name = "['" + "','".join(KINDS) + "'][ord + 1]"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), raw AS ({each}),
a AS (SELECT * FROM raw x WHERE NOT (ord = 4 AND EXISTS (SELECT 1 FROM raw y WHERE y.doc_id = x.doc_id AND y.ord IN (0, 1, 2, 3) AND y.s < x.e AND x.s < y.e))),
w AS (SELECT *, EXISTS (SELECT 1 FROM a y WHERE y.doc_id = x.doc_id AND y.ord IN (1, 3) AND abs(y.s - x.s) <= {SCOPE}) AS i,
  EXISTS (SELECT 1 FROM a y WHERE y.doc_id = x.doc_id AND y.ord IN (0, 2, 4) AND abs(y.s - x.s) <= {SCOPE}) AS c FROM a x),
k AS (SELECT doc_id, ord, s, {name} || ':' || s || ':' || e AS z FROM w WHERE ord < 3 OR (ord = 3 AND c) OR (ord = 4 AND i) OR (ord = 5 AND i AND c)),
g AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2,
  string_agg(z, ',' ORDER BY s, ord) FILTER (ord < 3) AS b, string_agg(z, ',' ORDER BY s, ord) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
