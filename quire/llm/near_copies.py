"""Near-copies by SimHash through vantage-point trees, verified by the Jaccard similarity of the sets of five-word shingles: every pair of at least 4/5 is linked.

Each set has a SimHash fingerprint. The trees of simhash.py, one for each of BLOCKS blocks, find fingerprints that differ
in at most WITHIN bits; what they find is verified on whole sets, so a link never rests on bits alone. But no number of
bits is sure to hold all pairs of 4/5, so pairs beyond WITHIN come from a prefix filter, which loses none. All shingles
have one order: those that a share of the texts finds frequent last, the rest by hash. The first common shingle of two sets with
similarity 4/5 or more has nearly all of both sets behind it, so it stands among the first n - ceil(4n/5) + 1 of each,
and sizes and places alone rule most pairs of a bucket out. In a bucket every set is first compared with one centre;
what these links leave in different components is then compared pair by pair within classes of size, so that a large
group of copies costs a star and not a square; two sets meet at the first of a run of open shingles that they share, not
at each. Buckets of crowded shingles are salted, and all of their parts also compared with the best of the centres.

Candidates are verified in two steps. Each set has a bit for every value of a few bits of the hash, set if an odd number
of shingles has that value: two sets differ in at least as many shingles as in such bits. What passes is compared
as whole sets; only those are made again from the texts and shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.bloom import BASE, ONE, filter_of, in_filter, mixed
from quire.llm.common import alone, least, ship, slices, spill
from quire.llm.components import components
from quire.llm.simhash import leaf_pairs, links as tree_links, majority, named_classes, rows_of

WIDTH = 5
BLOCKS = 4  # of the fingerprint, a vantage-point tree each
WITHIN = 7  # bits: in some of 4 blocks such fingerprints differ in at most 1
SAMPLE = 12_000  # texts at least whose shingles say what is frequent
SHARE = 8  # and one text of so many: a shingle of some 24 texts is found out, however large the table is
FREQUENT = 1 << 18  # shingles that go last: 4 MB on the driver and in each worker
SALTS = 64  # over which the bucket of a crowded shingle is dealt
CROWD = 1024  # texts from which a shingle is crowded
MOST_BITS = 1 << 17  # of a set's odd counts
SEEN = 100_000  # sets that a task knows as its own
TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}

BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
OF_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + ONE
PART = 1 << 20  # bytes that are hashed at once


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def run_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of joined[starts[i]:ends[i]]: a difference of prefix sums, moved to the place 0."""
    bytes_ = np.frombuffer(joined, np.uint8)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(bytes_) + 1, np.uint64)
        np.cumsum(OF_BYTE[bytes_] * powers(BASE, len(bytes_)), out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * powers(BACK, len(bytes_) + 1)[starts])


def shingles(data: bytes) -> np.ndarray:
    """The sorted hashes of the text's different shingles; a text of fewer words than WIDTH is one shingle."""
    words = data.lower().split()  # for bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if len(words) <= WIDTH:
        joined = b" ".join(words)
        return run_hashes(joined, np.array([0]), np.array([len(joined)])) if words else np.zeros(0, np.uint64)
    out, at = [], 0
    while at + WIDTH <= len(words):  # a long text goes by in parts that overlap by WIDTH - 1 words
        joined = b" ".join(words[at : at + PART // 8])
        ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
        starts = np.concatenate(([0], ends[:-1] + 1))
        out.append(run_hashes(joined, starts[: len(ends) - WIDTH + 1], ends[WIDTH - 1 :]))
        at += len(ends) - WIDTH + 1
    return np.unique(np.concatenate(out))


def digest(of: np.ndarray) -> int:
    """A signed long for the set, 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(of.tobytes())).astype(np.int64)) if len(of) else 0


def odd_bits(of: np.ndarray) -> bytes:
    """A bit for every value of the hash's last bits, as many values as shingles at least: is its number of shingles odd?"""
    size = min(MOST_BITS, max(64, 1 << (max(len(of), 1) - 1).bit_length()))
    counts = np.bincount((of & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fingerprint(of: np.ndarray) -> int:
    """The set's SimHash as a signed long, 0 for the empty set."""
    return int(np.uint64(majority(of)).astype(np.int64)) if len(of) else 0


def differ_at_least(a: bytes, b: bytes) -> int:
    """A number of shingles that are in one of the sets alone, from their odd_bits."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(np.bitwise_count(x ^ y).sum())


def first(of: np.ndarray, last: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's shingles that two sets of similarity 4/5 can't all miss, and which are frequent; last: sorted frequent shingles, rank: their order."""
    late = np.zeros(len(of), bool)
    if len(last):
        at = np.minimum(np.searchsorted(last, of), len(last) - 1)
        late = last[at] == of
        order = np.argsort(rank[at[late]])
        of, late = np.concatenate([of[~late], of[late][order]]), np.sort(late)
    many = len(of) - (4 * len(of) + 4) // 5 + 1
    return of[:many], late[:many]


def each_set(rows: DataFrame, make, schema: str) -> DataFrame:
    """The rows that make(doc_id, key, set) gives for each row of rows(doc_id long, key long, text binary)."""
    ship(rows.sparkSession)
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)

    def run(batches):
        alone("near_copies")
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for i, k, t in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                out.extend(make(i, k, shingles(t.as_buffer().to_pybytes() if t.is_valid else b"")))
            if out:
                columns = zip(zip(*out, strict=True), types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, t in columns], names=list(names))

    return rows.mapInArrow(run, schema)


def fresh(batches):
    """[(digest, set)] of each slice of batches with a column text, without empty sets and copies: those within a task are told apart here; those of different tasks do no harm."""
    seen: set[int] = set()
    for batch in slices(batches, "text", 1 << 20):
        out = []
        for t in batch.column("text"):
            s = shingles(t.as_buffer().to_pybytes() if t.is_valid else b"")
            fp = digest(s)
            if fp in seen or not len(s):
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(fp)
            out.append((fp, s))
        if out:
            yield out


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of more than two texts of the sample, sorted, their order, and the crowded ones among them, sorted. It decides no result.

    If there are more than FREQUENT, the bound on their number of texts goes up until they aren't.
    """
    total = rows.count()
    wanted = max(SAMPLE, total // SHARE)
    some = rows.where(least(F.col("key"), wanted // 4, total))

    def run(batches):
        alone("near_copies")
        for sets in fresh(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for _, s in sets]).view(np.int64))], names=["token"])

    ship(rows.sparkSession)
    found = spill(some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("texts")).where("texts > 2"), "frequent-shingles")
    sizes = np.array(found.groupBy("texts").count().orderBy(F.desc("texts")).collect(), np.int64).reshape(-1, 2)
    enough = sizes[np.cumsum(sizes[:, 1]) <= FREQUENT, 0]
    got = found.where(F.col("texts") >= int(enough[-1]) if len(enough) else F.lit(False)).toArrow()
    last, texts = got["token"].to_numpy().astype(np.int64).view(np.uint64), got["texts"].to_numpy().astype(np.int64)
    by_token = np.argsort(last)
    last, texts = last[by_token], texts[by_token]
    rank = np.empty(len(last), np.int64)
    rank[np.lexsort((last, texts))] = np.arange(len(last))  # the most frequent one is the very last
    return last, rank, last[texts * (total / min(wanted, max(total, 1))) > CROWD]


def among(of: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the shingles are in known, sorted."""
    return known[np.minimum(np.searchsorted(known, of), len(known) - 1)] == of if len(known) else np.zeros(len(of), bool)


def posts(rows: DataFrame) -> DataFrame:
    """(token, salt, fp, n, behind): every set's first shingles; behind counts the shingles from this one on."""
    spark = rows.sparkSession
    ship(spark)
    order = spark.sparkContext.broadcast(frequent(rows))

    def run(batches):
        alone("near_copies")
        last, rank, crowded = order.value
        for sets in fresh(batches):
            out = []
            for fp, s in sets:
                token, _ = first(s, last, rank)
                salt = np.where(among(token, crowded), 1 + fp % SALTS, 0)
                out.append((token, salt, np.full(len(token), fp), np.full(len(token), len(s)), len(s) - np.arange(len(token))))
            token, salt, fp, n, behind = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(salt.astype(np.int8)), pa.array(fp), pa.array(n.astype(np.int32)), pa.array(behind.astype(np.int32))],
                names=["token", "salt", "fp", "n", "behind"],
            )

    return rows.mapInArrow(run, "token long, salt byte, fp long, n int, behind int")


def reaches(common: Column) -> Column:
    """Whether sets of n and o shingles with so many in common have a similarity of at least 4/5."""
    return 9 * common >= 4 * (F.col("n") + F.col("o"))


def possible(pairs: DataFrame) -> DataFrame:
    """Of pairs(a, n, behind, b, o, behind_b) those whose sets can be similar with this as their first common shingle, once each."""
    return pairs.where(reaches(F.least("behind", "behind_b"))).select("a", "b", "n", "o").distinct()


def verified(pairs: DataFrame, rows: DataFrame, each: DataFrame) -> DataFrame:
    """(a, b) of pairs(a, b, n, o) that have a similarity of at least 4/5; each(fp, rep, rep_key, bits)."""
    spark = rows.sparkSession
    ship(spark)
    x = each.select(F.col("fp").alias("a"), F.col("bits").alias("x"))
    y = each.select(F.col("fp").alias("b"), F.col("bits").alias("y"))

    def close(batches):
        alone("near_copies")
        for batch in batches:
            n, o = (batch.column(c).to_numpy() for c in ("n", "o"))
            d = np.array([differ_at_least(p.as_buffer(), q.as_buffer()) for p, q in zip(batch.column("x"), batch.column("y"), strict=True)], np.int64)
            kept = batch.filter(pa.array(9 * d <= n.astype(np.int64) + o))
            yield kept.select(["a", "b", "n", "o"])

    pairs = spill(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "o", "x", "y").mapInArrow(close, "a long, b long, n int, o int"), "close-pairs")
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(each, "fp").select("fp", "rep_key")
    known = spark.sparkContext.broadcast(filter_of(ends))

    def whole(i, k, s):
        fp = digest(s)
        return [(fp, s.view(np.int64))] if in_filter(known.value, *np.array([[fp], [k]], np.int64)).all() else []

    sets = spill(each_set(rows, whole, "fp long, shingles array<long>").groupBy("fp").agg(F.first("shingles").alias("s")), "sets")
    left, right = sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), sets.select(F.col("fp").alias("b"), F.col("s").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(reaches(F.size(F.array_intersect("x", "y")))).select("a", "b")


def found_by_trees(each: DataFrame) -> DataFrame:
    """Candidates (a, b, n, o) among each(fp, size, sim): sets whose fingerprints are equal, or differ in at most WITHIN bits by the trees.

    Equal fingerprints are paired with one centre, and of the others each with the smallest and the nearest that a leaf
    holds, so a large group of near-copies costs a few pairs a member.
    """
    some = each.where("size > 0").select("sim", F.struct("fp", "size").alias("x"))
    centres = spill(some.groupBy("sim").agg(F.min("x").alias("centre"), F.count("*").alias("members")), "centres")
    equal = some.join(centres.where("members > 1"), "sim").where("x != centre").select("centre", "x")
    near = tree_links(centres.select(F.col("sim").alias("fp")), WITHIN, blocks=BLOCKS, of_leaf=leaf_pairs)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = near.join(centres.selectExpr("sim AS a", "centre"), "a").join(centres.selectExpr("sim AS b", "centre AS x"), "b").select("centre", "x")
    return equal.union(near).selectExpr("centre.fp AS a", "x.fp AS b", "centre.size AS n", "x.size AS o")


def links(rows: DataFrame, each: DataFrame) -> DataFrame:
    """rows(doc_id, key, text), each(fp, rep_key, bits, size, sim): one row of each set -> links (a, b) that connect all pairs of similarity 4/5 or more."""
    near = spill(found_by_trees(each), "tree-pairs")
    each = each.drop("size", "sim")
    bucket = "OVER (PARTITION BY token, salt)"
    centre = "struct(n - behind AS at, fp, n, behind)"  # with the fewest shingles of its own before this one it is the likest to all
    shared = posts(rows).selectExpr("*", f"min({centre}) {bucket} AS low", f"min(fp) {bucket} AS least", f"max(fp) {bucket} AS most")
    shared = spill(shared.where("salt > 0 OR least != most").drop("least", "most"), "shared-shingles")
    ends = "{0}.fp AS a, {0}.n AS n, {0}.behind AS behind, {1}fp AS b, {1}n AS o, {1}behind AS behind_b"
    star = shared.where("fp != low.fp").selectExpr(*ends.format("low", "").split(", "))
    # all parts of a salted bucket also meet the best of their centres, so that a group of copies isn't left in SALTS pieces
    roots = shared.where("salt > 0").select("token", "low").distinct().groupBy("token").agg(F.min("low").alias("root"))
    salted = shared.where("salt > 0").join(F.broadcast(roots), "token")  # FREQUENT rows at most, 6 MB
    star = star.union(salted.where("fp != root.fp").selectExpr(*ends.format("root", "").split(", ")))
    one_way = [f"IF(a < b, {x}, {y}) AS {x}" for x, y in ("ab", "ba", "no", "on")]
    near = near.where(reaches(F.least("n", "o"))).union(possible(star)).selectExpr(*one_way).distinct()
    near = spill(verified(spill(near, "star-pairs"), rows, each), "star-links")
    labels = components(near).withColumnRenamed("v", "fp")
    named = shared.select("token", "fp", "n", "behind").distinct().join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    open_ = named.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h").select("token")
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.26)))  # similar sizes are in one class or in two neighbours
    before = F.lag("token").over(Window.partitionBy("fp").orderBy(F.desc("behind")))
    named = spill(named.join(open_, "token").withColumns({"size": size, "before": before}), "open-shingles")
    x = named.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1))).toDF("token", "a", "n", "behind", "l", "size", "before")
    y = named.toDF("token", "b", "o", "behind_b", "h", "size", "before_b")
    # two sets that have the same open shingle before this one meet there, with more behind them
    rest = possible(x.join(y, ["token", "size"]).where("l != h AND (n < o OR (n = o AND a < b)) AND coalesce(before != before_b, true)"))
    rest = spill(rest, "rest-pairs")
    return near.union(verified(rest, rows, each)) if rest.limit(1).count() else near


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, label, component_id) for every row of docs, as simhash.classes has them; fp stands for the set of shingles."""
    rows = rows_of(docs)
    made = "doc_id long, key long, fp long, size int, sim long, bits binary"
    fps = spill(each_set(rows, lambda i, k, s: [(i, k, digest(s), len(s), fingerprint(s), odd_bits(s))], made), "fps")
    of_set = [F.first(c).alias(c) for c in ("bits", "size", "sim")]
    each = spill(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("key").alias("rep_key"), F.count("*").alias("n"), *of_set), "distinct-fps")
    linked = spill(links(rows, each.select("fp", "rep_key", "bits", "size", "sim")), "links")
    return named_classes(fps.select("doc_id", "key", "fp"), each.select("fp", "rep", "n"), linked)
