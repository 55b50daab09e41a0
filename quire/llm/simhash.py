"""SimHash near-duplicates through vantage-point trees.

Whole 64-bit fingerprints lie about 32 bits from any vantage point, give or take 4, so a tree over the whole
distance with radius 4 would send most queries to both sides of every node. The fingerprint is therefore cut
into three blocks: two fingerprints that differ in at most 4 bits differ in at most 1 bit in some block. One
vantage-point tree is grown for each block from a bounded sample of fingerprints; its leaves are the shards.
A fingerprint lives in one leaf of each tree and is a query in every leaf that the triangle bounds leave open
(radius 1 in the block). In a leaf, two more vantage points prune cells before whole fingerprints are compared,
so every linked pair is found and verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.bloom import maybe_in
from quire.llm.common import least, ship, slices, spill
from quire.llm.components import components

BITS = 64
SEED = 42
SAMPLE = 65536  # fingerprints from which the trees are grown: 512 KB on the driver
LEAF = 4096  # fingerprints wanted in a leaf
MOST_LEAVES = 8192
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def word_hashes(data: bytes, width: int) -> list[int]:
    """The hashes of all runs of width words, of the whole if there are fewer; none without words."""
    words = data.lower().split()  # for bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)]


def fingerprint(data: bytes, width: int = 4) -> int:
    hashes = word_hashes(data, width)
    if not hashes:
        return 0
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    by_value = np.stack([np.bincount(x, minlength=256) for x in h.view(np.uint8).reshape(-1, 8).T])
    counts = (by_value @ BITS_OF_BYTE).ravel()
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, text binary) of every row; key is a hash of the text, by which rows that share an id are told apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("key"), text.cast("binary").alias("text"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, key, fp): fp is the fingerprint's 64 bits as a signed long; null and wordless texts have 0."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, "text"):
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "key", "fp"]
            )

    return rows_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, key long, fp long")


def block_masks(within: int, blocks: int = 3) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def grow(sample: np.ndarray, mask: int, leaves: int, share: float, seed: int) -> list[tuple]:
    """A vantage-point tree over the block given by mask, as nodes (vantage, inner radius, inner child, outer child); leaves are (-1, salts, leaf number, 0).

    share: fingerprints that one sampled fingerprint stands for. A leaf that can't be split and holds more than
    twice LEAF gets that many salts, over which its residents and its probes are dealt.
    """
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    found = 0

    def build(part: np.ndarray, room: int) -> int:
        nonlocal found
        at = len(nodes)
        nodes.append(())
        if room > 1 and len(part) > 1:
            best = None
            for v in rng.choice(part, min(4, len(part)), replace=False):
                d = np.bitwise_count((part ^ v) & np.uint64(mask))
                for radius in {int(np.median(d)), int(np.median(d)) - 1}:
                    inner = d <= radius
                    overlap = np.mean((d == radius) | (d == radius + 1))
                    cost = max(inner.mean(), 1 - inner.mean()) + 0.25 * overlap
                    if 0 < inner.sum() < len(part) and (best is None or cost < best[0]):
                        best = (cost, int(v), radius, inner)
            if best:
                _, v, radius, inner = best
                low = build(part[inner], room // 2)
                nodes[at] = (v, radius, low, build(part[~inner], room - room // 2))
                return at
        nodes[at] = (-1, max(1, int(len(part) * share / (2 * LEAF))), found, 0)
        found += 1
        return at

    build(sample, leaves)
    return nodes


def route(fps: np.ndarray, nodes: list[tuple], mask: int, radius: int):
    """(row, leaf number, salts, resident?) for every leaf that the triangle bounds leave open to each fingerprint."""
    todo = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        at, rows, home = todo.pop()
        v, cut_at, low, high = nodes[at]
        if v < 0:
            yield rows, low, cut_at, home
            continue
        d = np.bitwise_count((fps[rows] ^ np.uint64(v)) & np.uint64(mask)).astype(np.int16)
        for child, inside, near in ((low, d <= cut_at, d - radius <= cut_at), (high, d > cut_at, d + radius > cut_at)):
            if near.any():
                todo.append((child, rows[near], (home & inside)[near]))


class Forest:
    """Labels of local vertices; union of many links at once."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r, s = self.up[a], self.up[b]
            apart = r != s
            a, b, r, s = a[apart], b[apart], r[apart], s[apart]
            if not len(a):
                return
            np.minimum.at(self.up, np.maximum(r, s), np.minimum(r, s))
            while not np.array_equal(up := self.up[self.up], self.up):
                self.up = up


def leaf_hits(home: np.ndarray, probes: np.ndarray, mask: int, radius: int, within: int, matrix: int = 1 << 21):
    """(probe, home, bits) of the pairs of different fingerprints that differ in at most within bits, a probe's all together and by home."""
    home, probes = np.unique(home), np.unique(probes)
    if len(home) and len(probes):
        m = np.uint64(mask)
        v1 = home[0]
        v2 = home[np.argmax(np.bitwise_count((home ^ v1) & m))]
        cell = lambda x: np.stack([np.bitwise_count((x ^ v) & m).astype(np.int64) for v in (v1, v2)], axis=1)
        hc, pc = cell(home), cell(probes)
        key = pc[:, 0] * 128 + pc[:, 1]
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=False):
            rows = order[a:b]
            c = pc[rows[0]]
            near = home[(np.abs(hc - c) <= radius).all(axis=1)]
            if not len(near):
                continue
            step = max(1, matrix // len(near))
            for at in range(0, len(rows), step):
                part = probes[rows[at : at + step]]
                bits = np.bitwise_count(part[:, None] ^ near[None, :])
                i, j = np.nonzero(bits - np.uint8(1) < within)  # 0 becomes 255
                yield part[i], near[j], bits[i, j]


def leaf_links(home: np.ndarray, probes: np.ndarray, mask: int, radius: int, within: int):
    """A spanning forest, as links (a, b), of the pairs between home and probes that differ in at most within bits."""
    every = np.unique(np.concatenate([home, probes]))
    forest = Forest(len(every))
    for x, y, _ in leaf_hits(home, probes, mask, radius, within):
        forest.union(np.searchsorted(every, x), np.searchsorted(every, y))
    child = np.flatnonzero(forest.up != np.arange(len(every)))
    return every[child], every[forest.up[child]]


def leaf_pairs(home: np.ndarray, probes: np.ndarray, mask: int, radius: int, within: int):
    """Of the pairs between home and probes that differ in at most within bits, each probe's with the smallest and with the nearest of home."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for x, y, bits in leaf_hits(home, probes, mask, radius, within):
        for order in (slice(None), np.lexsort((bits, x))):
            at = np.flatnonzero(np.diff(x[order], prepend=~x[order][:1]))
            out.append((x[order][at], y[order][at]))
    a, b = (np.concatenate(z) for z in zip(*out, strict=True))
    return a, b


def links(fps: DataFrame, within: int = 4, sample: int = SAMPLE, leaf: int = LEAF, blocks: int = 3, of_leaf=leaf_links) -> DataFrame:
    """fps(fp long), distinct -> links (a, b), those that of_leaf takes of each leaf: a spanning forest of all pairs that differ in at most within bits."""
    spark = fps.sparkSession
    ship(spark)
    total = fps.count()
    taken = [r.fp for r in fps.where(least(F.xxhash64("fp"), sample // 4, total)).collect()]  # about sample of them, whatever the number of tasks
    picked = np.sort(np.array(taken, np.int64).view(np.uint64))
    masks = block_masks(within, blocks)
    radius = within // len(masks)
    leaves = int(min(MOST_LEAVES, max(1, len(picked) // 8), 2 ** max(0, int(np.ceil(np.log2(max(total, 1) / leaf))))))
    trees = [grow(picked, m, leaves, total / max(len(picked), 1), 7 + i) for i, m in enumerate(masks)]
    offsets = np.cumsum([0] + [len(t) for t in trees]).tolist()

    def probe(batches):
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 8192):
                part = x[at : at + 8192]
                salt_of = xx_salt(part)
                for m, nodes, base in zip(masks, trees, offsets, strict=False):
                    for rows, number, salts, home in route(part, nodes, m, radius):
                        if salts == 1:
                            yield leaf_rows(part[rows], home, base + number, 0)
                            continue
                        # a crowded leaf is a square of groups: residents are dealt over its rows, probes over its columns
                        own = (salt_of[rows] % np.uint64(salts)).astype(np.int64)
                        for s in range(salts):
                            probes, residents = part[rows[own == s]], part[rows[home & (own == s)]]
                            for t in range(salts):
                                yield leaf_rows(probes, np.zeros(len(probes), bool), base + number, t * salts + s)
                                yield leaf_rows(residents, np.ones(len(residents), bool), base + number, s * salts + t)

    def check(group):
        number = group.column("leaf")[0].as_py()
        tree = max(i for i, base in enumerate(offsets[:-1]) if base <= number)
        x = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy(zero_copy_only=False)
        a, b = of_leaf(x[home], x, masks[tree], radius, within)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    probes = fps.mapInArrow(probe, "leaf int, salt int, fp long, home boolean")
    return probes.groupBy("leaf", "salt").applyInArrow(check, "a long, b long")


def leaf_rows(fps: np.ndarray, home: np.ndarray, leaf: int, salt: int) -> pa.RecordBatch:
    numbers = [pa.array(np.full(len(fps), x, np.int32)) for x in (leaf, salt)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array(fps.view(np.int64)), pa.array(home)], names=["leaf", "salt", "fp", "home"])


def xx_salt(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def classes(docs: DataFrame, within: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp, label, component_id) for every row of docs, repeated rows included.

    component_id is the smallest doc_id that is reachable over links, the row's own included; rows with a null
    doc_id take part in links, and have the component's smallest id, null only if no member has one. Null and
    wordless texts share fingerprint 0. label is one fingerprint of the component; key tells texts apart (rows_of).
    An empty table gives an empty result; other columns are not looked at.
    """
    fps = spill(with_fingerprints(docs, id_col, text_col, width), "fps")
    each = spill(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fps")
    return named_classes(fps, each, spill(links(each.select("fp"), within), "links"))


def named_classes(fps: DataFrame, each: DataFrame, linked: DataFrame) -> DataFrame:
    """fps(doc_id, key, fp) with label and component_id; each(fp, rep, n) has the smallest doc_id and the rows of each fp, linked(a, b) its links."""
    found = components(linked)
    known = each.join(found.withColumnRenamed("v", "fp"), "fp", "left").where("n > 1 OR label IS NOT NULL")
    known = known.select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    smallest = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_fp = known.join(smallest, "label").select("fp", "label", "component_id")
    named = fps.join(of_fp, "fp", "left")
    return named.select("doc_id", "key", "fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "doc_id").alias("component_id"))


def simhash_near_dedup(docs: DataFrame, within: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    found = classes(docs, within, width)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, within: int = 4, width: int = 4, found: DataFrame | None = None) -> DataFrame:
    """docs without near-copies: of each component one row stays, that with the smallest doc_id (nulls last), then the smallest hash of its text.

    The components are those of found(doc_id, key, label), by default those of classes(). A row is named by its doc_id
    and text together, so of rows that share an id each is judged by its own component. Of rows that share both
    one stays, by a hash of all columns. A filter of bounded size tells the rows that may go or occur more than once
    from all others, which are neither joined nor shuffled.
    """
    found = classes(docs, within, width) if found is None else found
    found = spill(found.select("label", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key").alias("row")), "rows-of-components")
    best = found.groupBy("label").agg(F.min("row").alias("best"), F.max("row").alias("worst")).where("best != worst").select("label", "best")
    named = lambda df: df.select(F.col("row.doc_id").alias("__quire_id"), F.col("row.key").alias("__quire_key"))
    go = spill(named(found.join(best, "label").where("row != best").select("row").distinct()), "copies")
    again = spill(named(found.groupBy("row").count().where("count > 1")), "again")
    row_id, row_key = F.col("doc_id").cast("long"), text_key(F.col("text").cast("string"))
    same = row_id.eqNullSafe(F.col("__quire_id")) & (row_key == F.col("__quire_key"))
    doubt = maybe_in(go.union(again), row_id, row_key)
    kept = docs.where(doubt).join(go, same, "left_anti")
    if again.limit(1).count():
        twice = kept.join(again, same).withColumn("__quire_row", F.struct(*docs.columns))
        each = twice.groupBy("__quire_id", "__quire_key").agg(F.min_by("__quire_row", F.xxhash64("__quire_row")).alias("x"))
        kept = kept.join(again, same, "left_anti").unionByName(each.select("x.*"))
    return docs.where(~doubt).unionByName(kept)
