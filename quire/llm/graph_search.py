"""Approximate nearest neighbours by a robust-pruned directed graph a shard.

Points enter in batches of doubling size. A greedy search over the graph so far proposes a point's neighbours; of
these, nearest first, one is kept unless a kept one is nearer to it by the factor ALPHA. Kept edges get their
reverse, and lists that overflow are pruned by the same rule.

For the largest inner product a shard's points are cut into bands of similar length (within RATIO), each with a graph
of its own, in which points get one more coordinate that makes their lengths equal: nearest by distance is largest by
product, and within a band that coordinate is small, so it doesn't hide the others. Bands of few points are compared
whole. Queries take the bands from the longest on and leave out those whose length can't reach their k-th product. All
queries of a block walk a graph together, a beam each; products are then taken anew in double precision.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from quire.llm.vectors import best_ids, classes, dump, load, search, usable

EVERY, K = 20, 20
DEGREE = 32
ALPHA = 1.2
BEAM_BUILD = 64
BEAM = 128
STEP = 4  # nodes of a beam that are opened together
BATCH = 512
POOL = 96  # candidates that pruning looks at
RATIO = 1.15  # of the longest to the shortest vector of a band
SMALL = 512  # points up to which a band is compared whole


def walk(graph: np.ndarray, x: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids of its beam, nearest first (-1: none), and its inner products negated."""
    n = len(queries)
    ids = np.full((n, beam), -1, np.int32)
    cost = np.full((n, beam), np.inf, np.float32)
    opened = np.ones((n, beam), bool)
    ids[:, 0], opened[:, 0] = start, False
    cost[:, 0] = -(queries @ x[start])
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    live = np.arange(n)
    while len(live):
        shut = ~opened[live]
        live = live[shut.any(1)]
        if not len(live):
            break
        shut = ~opened[live]
        turn = np.cumsum(shut, axis=1)
        pick = shut & (turn <= STEP)
        r, c = np.nonzero(pick)
        opened[live[r], c] = True
        near = np.full((len(live), STEP, graph.shape[1]), -1, np.int32)
        near[r, turn[r, c] - 1] = graph[ids[live[r], c]]
        near = near.reshape(len(live), -1)
        row, col = np.nonzero(near >= 0)
        to = near[row, col]
        new = ~seen[live[row], to]
        row, col, to = row[new], col[new], to[new]
        key = np.unique(row.astype(np.int64) * len(x) + to, return_index=True)[1]
        row, col, to = row[key], col[key], to[key]
        seen[live[row], to] = True
        more = np.full(near.shape, np.inf, np.float32)
        more[row, col] = -np.einsum("ij,ij->i", queries[live[row]], x[to])
        all_cost = np.hstack([cost[live], more])
        all_ids = np.hstack([ids[live], np.where(np.isfinite(more), near, -1)])
        all_open = np.hstack([opened[live], ~np.isfinite(more)])
        best = np.argsort(all_cost, axis=1, kind="stable")[:, :beam]
        cost[live] = np.take_along_axis(all_cost, best, 1)
        ids[live] = np.take_along_axis(all_ids, best, 1)
        opened[live] = np.take_along_axis(all_open, best, 1)
    return ids, cost


def prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """For each point DEGREE of the candidates in its row of pool (-1: none), by the relaxed distance rule; -1 fills up."""
    out = np.full((len(points), DEGREE), -1, np.int32)
    for at in range(0, len(points), 256):
        p, c = points[at : at + 256], pool[at : at + 256]
        ok = (c >= 0) & (c != p[:, None])
        d = ((x[c] - x[p][:, None]) ** 2).sum(2)
        d[~ok] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :POOL]
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        v = x[c]
        size = (v**2).sum(2)
        apart = np.maximum(size[:, :, None] + size[:, None, :] - 2 * v @ v.transpose(0, 2, 1), 0)
        alive = np.isfinite(d)
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]  # equal candidates are neighbours in the order
        rows = np.arange(len(p))
        for k in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            out[at : at + len(p)][some, k] = c[rows, first][some]
            alive &= ALPHA**2 * apart[rows, first] > d
            alive[rows, first] = False
    return out


def grow(x: np.ndarray, seed: int = 1) -> tuple[np.ndarray, int]:
    """The graph of x, float32 rows of equal length, and the node where searches start."""
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int32)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        points = order[at : at + size]
        found, _ = walk(graph, x, start, x[points], BEAM_BUILD)
        graph[points] = prune(x, points, found)
        tail = np.repeat(points, DEGREE)
        head = graph[points].ravel()
        tail, head = tail[head >= 0], head[head >= 0]
        turn = np.argsort(head, kind="stable")
        head, tail = head[turn], tail[turn]
        to, first, many = np.unique(head, return_index=True, return_counts=True)
        have = (graph[to] >= 0).sum(1)
        place = np.arange(len(head)) - np.repeat(first, many)
        room = np.repeat(have + many <= DEGREE, many)
        graph[head[room], np.repeat(have, many)[room] + place[room]] = tail[room]
        full = np.flatnonzero(have + many > DEGREE)
        for part in np.array_split(full, max(1, len(full) // 256)):
            if not len(part):
                continue
            pool = np.full((len(part), DEGREE + many[part].max()), -1, np.int32)
            pool[:, :DEGREE] = graph[to[part]]
            for i, j in enumerate(part):
                pool[i, DEGREE : DEGREE + many[j]] = tail[first[j] : first[j] + many[j]]
            graph[to[part]] = prune(x, to[part], pool)
        at += len(points)
        size = min(BATCH, size * 2)
    return graph, start


def bands(norm: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of norm, which falls, whose values are within RATIO of their first."""
    out, at = [], 0
    while at < len(norm):
        end = int(np.searchsorted(-norm, -norm[at] / RATIO, side="right"))
        out.append((at, max(end, at + 1)))
        at = out[-1][1]
    return out


def build(ids: np.ndarray, x: np.ndarray, k: int = K) -> bytes:
    """The classes of equal vectors, longest first, and a graph for each band of more than SMALL; its nodes count from the band's start."""
    v, members, bounds = classes(ids, x, k + 1)
    norm = length(v)
    turn = np.argsort(-norm, kind="stable")
    place = np.diff(bounds)[turn]
    members = np.concatenate([members[bounds[c] : bounds[c + 1]] for c in turn]) if len(turn) else members
    v, norm, bounds = v[turn], norm[turn], np.concatenate(([0], np.cumsum(place)))
    graph, starts, edges = np.full((len(v), DEGREE), -1, np.int32), [], []
    for low, high in bands(norm):
        edges.append((low, high))
        starts.append(-1)
        if high - low > SMALL:
            part = v[low:high] / norm[low]
            flat = np.hstack([part, np.sqrt(np.maximum(1 - (part**2).sum(1), 0))[:, None]]).astype(np.float32)
            graph[low:high], starts[-1] = grow(flat)
    return dump(v=v, norm=norm, members=members, bounds=bounds, graph=graph, starts=np.array(starts), edges=np.array(edges).reshape(-1, 2))


def length(x: np.ndarray) -> np.ndarray:
    """Of each row, without overflow on the way."""
    most = np.abs(x).max(1, initial=0)
    safe = np.where(most > 0, most, 1)
    return most * np.sqrt(((x / safe[:, None]) ** 2).sum(1))


def answer(data: bytes, query_ids: np.ndarray, queries: np.ndarray, k: int = K, beam: int = BEAM):
    index = load(data)
    v, norm = index["v"], index["norm"]
    out = ([], [], [])
    for at in range(0, len(queries), BATCH):
        q = queries[at : at + BATCH]
        own = length(q)
        unit = (q / own[:, None]).astype(np.float32)
        ids, scores = np.full((len(q), 0), -1, np.int64), np.zeros((len(q), 0))
        reached = np.full(len(q), -np.inf)  # the k-th best product so far, the query's own row aside
        for (low, high), start in zip(index["edges"].tolist(), index["starts"].tolist(), strict=True):
            live = np.flatnonzero(own * norm[low] * (1 + 1e-9) >= reached)
            if not len(live):
                continue
            if start < 0:
                s = q[live] @ v[low:high].T
                some = np.argpartition(-s, min(k, high - low - 1), axis=1)[:, : k + 1]
                # equal scores at the edge are left to the smaller ids by taking all that reach it
                edge = np.take_along_axis(s, some, 1).min(1, keepdims=True)
                wide = int((s >= edge - 1e-9 * np.abs(edge)).sum(1).max())
                found = low + np.argsort(-s, axis=1, kind="stable")[:, :wide]
            else:
                part = np.hstack([v[low:high] / norm[low], np.zeros((high - low, 1))]).astype(np.float32)
                flat = np.hstack([unit[live], np.zeros((len(live), 1), np.float32)])
                found, _ = walk(index["graph"][low:high], part, start, flat, max(beam, 2 * k))
                found = np.where(found >= 0, found + low, -1)
            new_ids, new_scores = np.full((len(q), found.shape[1]), -1, np.int64), np.full((len(q), found.shape[1]), -np.inf)
            new_ids[live] = found
            new_scores[live] = np.where(found >= 0, np.einsum("ij,ikj->ik", q[live], v[found]), -np.inf)
            ids, scores = np.hstack([ids, new_ids]), np.hstack([scores, new_scores])
            if scores.shape[1] > 4 * beam:  # what can't be among the best goes
                best = np.argsort(-scores, axis=1, kind="stable")[:, : 2 * beam]
                ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
            if scores.shape[1] > k + 1:
                reached = -np.partition(-scores, k, axis=1)[:, k]
        got = best_ids(query_ids[at : at + BATCH], ids, scores, index["members"], index["bounds"], k)
        for a, b in zip(out, got, strict=True):
            a.extend(b if isinstance(b, list) else b.tolist())
    return out


def nearest(embeddings: DataFrame, every: int = EVERY, k: int = K, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k found with the largest inner products for each query, ties to the smaller vec_id.

    Null, zero and non-finite vectors, those with an unusual number of components and rows without an id take no part. Rows that share an
    id are one row with the smallest of their vectors. Fewer than k candidates are all found; an empty table gives an
    empty result. Columns besides vec_id and embedding aren't looked at.
    """
    return search(usable(embeddings, zeros=False), every, k, partial(build, k=k), partial(answer, k=k, beam=beam), "double")
