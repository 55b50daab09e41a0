"""What the vector searches share: clean rows, shards of bounded size, blocks of queries, and the merge of their best.

Rows go to shards and queries to blocks by hashes of their ids, so equal vectors, however many, are dealt evenly. In
a shard equal vectors are one class of which the k + 1 smallest ids count: k, besides the query's own, fill any answer.
A shard and BLOCKS blocks are one group of bounded size; answers meet in a ranking whose partial form drops all
but k rows a query before the shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quire.llm.common import ship, spill

SHARD = 8192
BLOCK = 2048
BLOCKS = 32  # of queries that meet a shard's index in one task: it is shuffled and loaded once for them


def usable(table: DataFrame, zeros: bool) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: no null id, no null or non-finite component, the usual length (that of most rows, of two the larger), and zero vectors only if asked for."""
    rows = table.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    if not zeros:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual.n if usual else 0))


def matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """ids, ascending, and their vectors; of rows that share an id, the smallest vector's."""
    ids = group.column("vec_id").to_numpy()
    flat = group.column("v").combine_chunks()
    x = np.asarray(flat.values if isinstance(flat, pa.ListArray) else flat.chunk(0).values).reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    return ids[first], np.ascontiguousarray(x[first])


def classes(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of x as classes in order of their smallest ids: vectors, the keep smallest ids of each in a row, their bounds."""
    x = x + 0.0  # -0 is 0
    _, first, inverse = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    turn = np.argsort(first)  # ids ascend, so the first place has the smallest id
    rank = np.empty(len(first), np.int64)
    rank[turn] = np.arange(len(first))
    of = rank[inverse.ravel()]
    order = np.argsort(of, kind="stable")
    place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    kept = order[place < keep]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(of[kept], minlength=len(first)))))
    return x[first[turn]], ids[kept], bounds


def dump(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def best_ids(query_ids: np.ndarray, found: np.ndarray, scores: np.ndarray, members: np.ndarray, bounds: np.ndarray, k: int):
    """(query_id, vec_id, score) rows: for each query the k best ids of the classes found ([queries, classes], -1 for none), its own left out."""
    out_q, out_i, out_s = [], [], []
    for q, cs, ss in zip(query_ids.tolist(), found, scores, strict=True):
        ok = cs >= 0
        cs, ss = cs[ok], ss[ok]
        n = bounds[cs + 1] - bounds[cs]
        ids = np.concatenate([members[bounds[c] : bounds[c + 1]] for c in cs]) if len(cs) else np.zeros(0, np.int64)
        s = np.repeat(ss, n)
        other = ids != q
        ids, s = ids[other], s[other]
        order = np.lexsort((ids, -s))[:k]
        out_q += [q] * len(order)
        out_i.append(ids[order])
        out_s.append(s[order])
    return out_q, (np.concatenate(out_i) if out_i else np.zeros(0, np.int64)), (np.concatenate(out_s) if out_s else np.zeros(0))


def search(rows: DataFrame, every: int, k: int, build: Callable, answer: Callable, kind: str) -> DataFrame:
    """Queries (ids divisible by every) against all rows -> query_id, rank, vec_id, score.

    build(ids, vectors) makes a shard's index as bytes; answer(index, query_ids, queries) gives (query_id, vec_id, score).
    """
    spark = rows.sparkSession
    ship(spark)
    rows = spill(rows, "vectors")
    queries = rows.where(F.col("vec_id") % every == 0)
    shards = max(1, -(-rows.count() // SHARD))
    blocks = max(1, -(-queries.count() // BLOCK))

    def index(key, group):
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([build(*matrix(group))], pa.binary())})

    def pack(key, group):
        ids, x = matrix(group)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([dump(ids=ids, x=x)], pa.binary())})

    def meet(key, left, right):
        parts = []
        for data in right.column("data") if len(left) else []:
            q = load(data.as_py())
            parts.append(answer(left.column("data")[0].as_py(), q["ids"], q["x"]))
        got = [[x for part in parts for x in part[i]] for i in range(3)]
        numbers = pa.int64() if kind == "long" else pa.float64()
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], numbers)})

    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    indexes = spill(rows.withColumn("shard", deal(shards, 1)).groupBy("shard").applyInArrow(index, "shard int, data binary"), "indexes")
    packs = spill(queries.withColumn("block", deal(blocks, 2)).groupBy("block").applyInArrow(pack, "block int, data binary"), "query-blocks")
    left = indexes.select("shard", "data", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS))).alias("slot"))
    right = packs.select(F.floor(F.col("block") / BLOCKS).cast("int").alias("slot"), "data", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = left.groupBy("shard", "slot").cogroup(right.groupBy("shard", "slot")).applyInArrow(meet, f"query_id long, vec_id long, score {kind}")
    turn = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
