"""Exact top-k by inner product over quantised vectors, with a dual-tree search of cover trees.

Trees have levels: a node of level l covers its points within BASE^l of its centre. Its children, one level down
(levels at which a node would be its own only child are left out), keep three rules: the node's centre is a child's too
(nesting), every point is within BASE^(l-1) of its child's centre (covering), and the children's centres are more
than that apart (separation). Nodes of at most LEAF points aren't split. Queries of a block and points of a
shard both have a tree. A pair of nodes goes if the bound on any product between them, from the centres' product and
the covering radii, is below the worst (k + 1)-th score so far of the queries in the group; equal scores stay, as the
smaller id wins. Leaves that remain are compared by matrix products, best bounds first.

All values are integers. While products stay below 2^53 doubles hold them exactly; beyond that doubles with a bound on
their error say which pairs can matter, and those are taken again in integers of any length.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quire.llm.vectors import best_ids, classes, dump, load, search, usable

EVERY, K = 50, 5
SCALE = 256
BASE, LEAF = 1.15, 64
GROUP = 1024  # points compared in one product
MOST = 2**63 - 1  # larger scores, of either sign, are this one
LARGEST = 1e300  # components from here on count as non-finite: 256 times them may be


class Tree:
    """Nodes as arrays: centre (row of x), level, covering radius, first child and number of them, and the range of points in perm."""

    FIELDS = ("centre", "level", "radius", "child", "children", "low", "high")

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre, self.level, self.radius, self.child, self.children, self.low, self.high = [], [], [], [], [], [], []
        self.perm = np.arange(len(x))
        self.add(0, len(x), int(((x - x.mean(0)) ** 2).sum(1).argmin()), None)
        at = 0
        while at < len(self.centre):  # breadth first: the children of a node stand together
            self.split(at)
            at += 1
        for name in self.FIELDS:
            setattr(self, name, np.array(getattr(self, name)))
        self.norm = np.sqrt((x[self.centre] ** 2).sum(1))

    def add(self, low: int, high: int, centre: int, level: int | None) -> None:
        radius = float(np.sqrt(((self.x[self.perm[low:high]] - self.x[centre]) ** 2).sum(1).max()))
        level = level_over(radius) if level is None else level
        for name, value in zip(self.FIELDS, (centre, level, radius, -1, 0, low, high), strict=True):
            getattr(self, name).append(value)

    def split(self, at: int) -> None:
        low, high = self.low[at], self.high[at]
        if high - low <= LEAF or self.radius[at] == 0:
            return
        points = self.perm[low:high]
        v = self.x[points]
        level = min(self.level[at], level_over(self.radius[at])) - 1
        apart = BASE**level
        near = np.sqrt(((v - self.x[self.centre[at]]) ** 2).sum(1))
        of, centres = np.zeros(len(points), int), [self.centre[at]]
        while near.max() > apart:
            far = int(near.argmax())
            d = np.sqrt(((v - v[far]) ** 2).sum(1))
            closer = d < near
            of[closer], near = len(centres), np.minimum(near, d)
            centres.append(int(points[far]))
        order = np.argsort(of, kind="stable")
        self.perm[low:high] = points[order]
        self.child[at] = len(self.centre)
        for c, n in zip(centres, np.bincount(of, minlength=len(centres)).tolist(), strict=True):
            self.add(low, low + n, c, level)
            self.children[at] += 1
            low += n


def level_over(radius: float) -> int:
    """The lowest level that covers radius."""
    if radius == 0:
        return -(1 << 30)
    level = int(np.ceil(np.log(radius) / np.log(BASE)))
    while BASE**level < radius:
        level += 1
    while BASE ** (level - 1) >= radius:
        level -= 1
    return level


def dual(data: Tree, queries: Tree, k: int, exact=None, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k best rows of data by (score, smaller row), as ids and scores; -1 fills up.

    exact(query, rows) gives the scores as integers where products of doubles aren't exact; 2^-shift of them is what
    the trees' products come near to.
    """
    n = len(queries.x)
    size = [np.sqrt((t.x**2).sum(1)) for t in (queries, data)]
    whole: list[dict[int, int]] = [{} for _ in range(n)]
    cap = float(np.ldexp(float(MOST), -shift)) if exact is not None else np.inf  # scores don't go beyond
    best = np.full((n, k), -np.inf)
    rows = np.full((n, k), -1, np.int64)

    def take(q: np.ndarray, d: np.ndarray) -> None:
        """Merge rows d, met by the queries q for the first time, in the lists of their best."""
        s = queries.x[q] @ data.x[d].T
        if exact is not None:
            error = 1e-13 * len(data.x[0]) * size[0][q][:, None] * size[1][d]
            merge_exact(q, d, np.maximum(s + error, -cap), np.minimum(s - error, cap))
            return
        least = best[q, -1:]
        if len(d) > k:
            least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1 : k])
        who, col = np.nonzero(s >= least)
        if len(who):
            who_all = np.concatenate([np.repeat(np.arange(len(q)), k), who])
            score = np.concatenate([best[q].ravel(), s[who, col]])
            row = np.concatenate([rows[q].ravel(), d[col]])
            order = np.lexsort((row, -score, who_all))
            of = who_all[order]
            keep = order[np.arange(len(of)) - np.searchsorted(of, of) < k]
            best[q], rows[q] = score[keep].reshape(-1, k), row[keep].reshape(-1, k)

    def merge_exact(q: np.ndarray, d: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        """Pairs whose score may reach the k-th get their integer; best has lower bounds of the integers as doubles."""
        for i, who in enumerate(q.tolist()):
            least = best[who, -1]
            if len(d) > k:
                least = max(least, -np.partition(-low[i], k - 1)[k - 1])
            some = np.flatnonzero(high[i] >= least)
            found = whole[who] | dict(zip(d[some].tolist(), exact(who, d[some]), strict=True))
            whole[who] = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])
            for j, (row, score) in enumerate(whole[who].items()):
                rows[who, j], best[who, j] = row, below(score >> shift)

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        product = np.einsum("ij,ij->i", queries.x[queries.centre[a]], data.x[data.centre[b]])
        top = product + queries.radius[a] * data.norm[b] + data.radius[b] * queries.norm[a] + queries.radius[a] * data.radius[b]
        return np.maximum(top + 1e-9 * (np.abs(top) + 1), -cap)

    first: dict[int, int] = {}

    def worst(node: int) -> float:
        return best[queries.perm[queries.low[node] : queries.high[node]], -1].min()

    def points(leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([data.perm[data.low[b] : data.high[b]] for b in leaves])

    def compare(a: int, leaves: np.ndarray, top: np.ndarray) -> None:
        """A query leaf against data leaves, best bounds first, GROUP points at a time; the threshold rises in between."""
        order = np.argsort(-top, kind="stable")
        leaves, top = leaves[order], top[order]
        q = queries.perm[queries.low[a] : queries.high[a]]
        ends = np.cumsum(data.high[leaves] - data.low[leaves])
        at = 0
        while at < len(leaves):
            stop = min(int(np.searchsorted(-top, -worst(a), side="right")), max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, side="right"))))
            if stop <= at:
                break
            take(q, points(leaves[at:stop]))
            at = stop

    # a first threshold: each query leaf meets the leaf that greedy descent finds
    for a in np.flatnonzero(queries.children == 0):
        b = 0
        while data.children[b]:
            options = np.arange(data.child[b], data.child[b] + data.children[b])
            b = int(options[bound(np.full(len(options), a), options).argmax()])
        first[int(a)] = b
        take(queries.perm[queries.low[a] : queries.high[a]], points(np.array([b])))
    pairs = np.zeros((1, 2), np.int64)
    while len(pairs):
        top = bound(pairs[:, 0], pairs[:, 1])
        least = np.array([worst(a) for a in np.unique(pairs[:, 0])])
        open_ = top >= least[np.searchsorted(np.unique(pairs[:, 0]), pairs[:, 0])]
        pairs, top = pairs[open_], top[open_]
        leaf = (queries.children[pairs[:, 0]] == 0) & (data.children[pairs[:, 1]] == 0)
        a, b = pairs[leaf].T
        for node in np.unique(a).tolist():
            mine = (a == node) & (b != first[node])
            compare(node, b[mine], top[leaf][mine])
        a, b = pairs[~leaf].T
        wide = (data.children[b] > 0) & ((data.radius[b] >= queries.radius[a]) | (queries.children[a] == 0))
        down = np.where(wide, data.child[b], queries.child[a])
        many = np.where(wide, data.children[b], queries.children[a])
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        child, side = np.repeat(down, many) + step, np.repeat(wide, many)
        pairs = np.stack([np.where(side, np.repeat(a, many), child), np.where(side, child, np.repeat(b, many))], axis=1)
    if exact is not None:
        best = np.zeros((n, k), np.int64)
        for i, found in enumerate(whole):
            best[i, : len(found)] = list(found.values())
    return rows, np.where(rows >= 0, best, 0).astype(np.int64)


def below(score: int) -> float:
    """A double that is not above the integer."""
    return float(score) - abs(float(score)) * 2**-50


def quantised(x: np.ndarray) -> np.ndarray:
    """Integers as doubles."""
    return np.floor(SCALE * x)


def product(a: np.ndarray, b: np.ndarray) -> int:
    """Of integers held by doubles, exactly; a long holds the result or the long nearest to it."""
    exact = sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    return max(-MOST, min(MOST, exact))


def build(ids: np.ndarray, x: np.ndarray, k: int = K) -> bytes:
    v, members, bounds = classes(ids, quantised(x), k + 1)
    return dump(v=v, members=members, bounds=bounds)


def answer(data: bytes, query_ids: np.ndarray, queries: np.ndarray, k: int = K):
    index = load(data)
    v, q = index["v"], quantised(queries)
    most = max(np.abs(v).max(initial=0), np.abs(q).max(initial=0))
    if most < 2**27 and most**2 * v.shape[1] < 2**53:
        rows, best = dual(Tree(v), Tree(q), k + 1)
    else:
        down = max(0, int(np.frexp(most)[1]) - 400)  # squares must not overflow
        exact = lambda i, some: [product(q[i], v[j]) for j in some.tolist()]
        rows, best = dual(Tree(np.ldexp(v, -down)), Tree(np.ldexp(q, -down)), k + 1, exact, 2 * down)
    return best_ids(query_ids, rows, best, index["members"], index["bounds"], k)


def exact_topk(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k largest integer products, ties to the smaller vec_id.

    Null and non-finite vectors (LARGEST), those with an unusual number of components and rows without an id take no
    part; zero vectors do. Rows that share an id are one row with the smallest of their vectors. Products that a long
    can't hold are the nearest long (MOST). An empty table gives an empty result.
    """
    rows = usable(embeddings, zeros=True).where(F.forall("v", lambda x: F.abs(x) < LARGEST))
    return search(rows, every, k, partial(build, k=k), partial(answer, k=k), "long").select(
        "query_id", "rank", "vec_id", F.col("score").cast("long").alias("score")
    )


ORACLE = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
