"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel compares words: it counts common subsequences of 3 characters within SPAN, each weighted by DECAY to the power of
the stretch it spans, so an insult with gaps or inserted characters still shares most of its weight with the plain
one. Values are normalised and raised to SHARPEN (both keep it a kernel). A text is the mean of its words' images in
the space that the landmarks span; a linear machine on such means weighs each word by one number, so a text's
score is the mean of its words' weights (SHRINK more words of weight 0 keep short texts near the middle), which workers keep in a cache.

Landmarks are word beginnings and words whose rates differ most between labelled texts, and common words. Machine,
landmarks and calibration are fitted on a bounded sample of labelled rows (SAMPLE of each class, the first by a
hash of the id, of at most SAMPLE_CHARS characters); scoring reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import alone, ship, slices

SAMPLE = 1500
SAMPLE_CHARS = 20_000
MARKED, COMMON = 64, 16  # landmarks of either sort
DECAY = 0.6
SPAN = 6  # longer stretches weigh next to nothing and are left out
SHARPEN = 4
SHRINK = 30  # words that every text has besides its own, of weight 0
CLIP = 0.03  # the rate beyond which a beginning marks a text no more strongly
LONGEST = 16
CACHE = 200_000  # words of either half of a worker's cache
LONG = 48  # longer words aren't kept there
SURE = 4.0  # standard errors between the classes' rates that make a landmark
COST = 1.0
RIDGE = 0.001
CUT = 0.7
SPELT = re.compile(r"(?<!\S)\w(?:[ ._*-]\w){2,}(?!\S)")
GAPS = re.compile(r"[\W_]+")


def symbols() -> dict[int, int]:
    """Letters have a symbol each (accented ones share by code point), digits one; 62 begins a word and 63 ends it."""
    table = {c: 1 + c - 97 for c in range(97, 123)} | dict.fromkeys(range(48, 58), 27)
    return table | {c: 28 + c % 34 for c in range(0xC0, 0x250) if chr(c).isalpha()}


SYMBOLS = np.array([symbols().get(c, 28 + c % 34) for c in range(0x250)], np.int32)
SYMBOLS[[ord("^"), ord("$")]] = 62, 63


def split(text: str) -> list[str]:
    """Words as the kernel sees them before clean(): runs without white space; letters spelt one by one are one word."""
    if SPELT.search(text):
        text = SPELT.sub(lambda m: GAPS.sub("", m[0]), text)
    return text.split()


def clean(word: str) -> str:
    return GAPS.sub("", word.lower())


def chunks(word: str) -> list[str]:
    """The word with its ends marked, or windows of LONGEST characters that half overlap."""
    marked = f"^{word}$"
    if len(marked) <= LONGEST:
        return [marked]
    return [marked[at : at + LONGEST] for at in range(0, len(marked) - LONGEST // 2, LONGEST // 2)]


def coded(words: list[str]) -> np.ndarray:
    """Words of one length as rows of symbols."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    return np.where(points < len(SYMBOLS), SYMBOLS[np.minimum(points, len(SYMBOLS) - 1)], 28 + (points % 34).astype(np.int32))


@cache
def places(n: int) -> np.ndarray:
    """Increasing triples below n that span at most SPAN characters."""
    return np.array([x for x in combinations(range(n), 3) if x[2] - x[0] < SPAN], np.int32).reshape(-1, 3)


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all subsequences of 3 of every row, and the weights of their places."""
    at = places(rows.shape[1])
    codes = rows[:, at[:, 0]] * 4096 + rows[:, at[:, 1]] * 64 + rows[:, at[:, 2]]
    return codes, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def norm(weights: np.ndarray) -> float:
    """By what a word's values are divided: the length of its image if no subsequence came twice. It depends on the word's length alone, and any such divisor keeps the kernel a kernel."""
    return float(np.sqrt((weights**2).sum())) or 1.0


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        rows: dict[int, dict[int, float]] = {}
        for j, w in enumerate(words):
            codes, weights = subsequences(coded([w]))
            for c, x in zip(codes[0].tolist(), (weights / norm(weights)).tolist(), strict=True):
                row = rows.setdefault(c, {})
                row[j] = row.get(j, 0.0) + x
        # a subsequence is in few landmarks: (landmark, value) of each, one after the other
        self.place = np.zeros(1 << 18, np.int32)
        self.place[list(rows)] = np.arange(1, len(rows) + 1)
        self.many = np.array([0, *map(len, rows.values())])
        self.first = np.cumsum(self.many) - self.many
        self.landmark = np.array([j for row in rows.values() for j in row], np.int64)
        self.value = np.array([x for row in rows.values() for x in row.values()])

    def kernel(self, words: list[str]) -> np.ndarray:
        """[words, landmarks] of the sharpened, normalised kernel; words: marked chunks of any length."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, group in by_length.items():
            if length < 3:
                continue
            for at in range(0, len(group), 1024):
                part = np.array(group[at : at + 1024])
                codes, weights = subsequences(coded([words[i] for i in part]))
                place = self.place[codes]
                r, c = np.nonzero(place)
                p = place[r, c]
                n = self.many[p]
                at = np.arange(n.sum()) + np.repeat(self.first[p] - (np.cumsum(n) - n), n)
                got = np.bincount(np.repeat(r, n) * len(self.words) + self.landmark[at], self.value[at] * np.repeat(weights[c], n), len(part) * len(self.words))
                out[part] = (got.reshape(len(part), -1) / norm(weights)) ** SHARPEN
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Cleaned words; of a long word's chunks, the largest value for each landmark."""
        cut = [chunks(w) for w in words]
        k = self.kernel([c for cs in cut for c in cs])
        if len(k) == len(words):
            return k
        many = np.array([len(cs) for cs in cut])
        first = np.cumsum(many) - many
        out = k[first]
        long_ = np.flatnonzero(many > 1)
        rows = np.concatenate([np.arange(first[i], first[i] + many[i]) for i in long_])
        out[long_] = np.maximum.reduceat(k[rows], np.cumsum(many[long_]) - many[long_], axis=0)
        return out


def choose(counts: list[Counter], labels: np.ndarray) -> list[str]:
    """Landmarks: beginnings and whole words with the largest differences in rate, no two with the same first 5 characters; then common words."""
    texts_with: Counter = Counter()
    for words in counts:
        texts_with.update({m[:size] for w in words for m in (f"^{w}$",) for size in range(5, min(len(m), 9) + 1)})
    rate = {s: (array("i"), array("d")) for s, n in texts_with.items() if n >= 5}  # texts and rates; as tuples they took most of the driver's memory
    del texts_with
    for i, words in enumerate(counts):
        n = sum(words.values()) + SHRINK
        mine: Counter = Counter()
        for w, k in words.items():
            marked = f"^{w}$"
            for size in range(5, min(len(marked), 9) + 1):
                if marked[:size] in rate:
                    mine[marked[:size]] += k
        for s, k in mine.items():
            rate[s][0].append(i)
            rate[s][1].append(min(k / n, CLIP))
    n1, n0 = max(1, labels.sum()), max(1, (1 - labels).sum())
    scored = []
    for s, (texts, rates) in rate.items():
        rows, x = np.array(texts), np.array(rates)
        y = labels[rows] == 1
        m1, m0 = x[y].sum() / n1, x[~y].sum() / n0
        v1, v0 = (x[y] ** 2).sum() / n1 - m1**2, (x[~y] ** 2).sum() / n0 - m0**2
        scored.append((abs(m1 - m0) / np.sqrt(v1 / n1 + v0 / n0 + 1e-12), s))
    picked: list[str] = []
    heads: set[str] = set()
    for score, s in sorted(scored, key=lambda x: (-round(x[0], 6), -len(x[1]), x[1])):
        if score < SURE:
            break
        if s[:5] not in heads:
            heads.add(s[:5])
            picked.append(s)
        if len(picked) == MARKED:
            break
    total: Counter = Counter()
    for words in counts:
        total.update(words.keys())
    common = [f"^{w}$"[:LONGEST] for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 4]
    picked += [w for w in common if w not in picked][:COMMON]
    return picked or ["^none$"]


def train_svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 60, seed: int = 3) -> np.ndarray:
    """Linear machine with hinge loss by dual coordinate descent; c: the bound of each row's dual variable. The last weight is the bias."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    sign = np.where(y == 1, 1.0, -1.0)
    w, alpha, size = np.zeros(x.shape[1]), np.zeros(len(x)), (x**2).sum(1)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = sign[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - g / size[i], 0.0), c[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def platt(f: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a f + b))) by Newton's method on smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([f, np.ones_like(f)], 1)
    t = np.zeros(2)
    loss = lambda t: np.logaddexp(0, z @ t).sum() - target @ (z @ t) + 1e-6 * t @ t
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -500, 500)))
        g = z.T @ (p - target) + 2e-6 * t
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-6 and loss(t - scale * step) > loss(t):
            scale /= 2
        t = t - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(t[0]), float(t[1])


class Model:
    """What the workers get: landmarks, one weight a landmark, bias and calibration; some 100 KB."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, a: float, b: float):
        self.landmarks, self.weights, self.bias, self.a, self.b = landmarks, weights, bias, a, b

    def key(self) -> tuple:
        return (hash(tuple(self.landmarks)), hash(self.weights.tobytes()), self.bias, self.a, self.b)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.landmarks, self.known, self.old = model, Landmarks(model.landmarks), {}, {}

    def learn(self, new: list[str]) -> None:
        bare = [clean(w) for w in new]
        kernel = self.landmarks.of_words(list(dict.fromkeys(bare)))
        value = dict(zip(dict.fromkeys(bare), (kernel @ self.model.weights).tolist(), strict=True))
        self.known.update((w, value[b]) for w, b in zip(new, bare, strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        cut = [split(t) for t in texts]
        every = set().union(*cut)
        new = {w for w in every if w not in self.known}
        if len(self.known) + len(new) > CACHE:  # the older half goes, but for what is still in use
            self.old, self.known, new = self.known, {}, every
        kept = {w: self.old[w] for w in new if w in self.old}
        self.known.update(kept)
        new = list(new - kept.keys())
        for at in range(0, len(new), 8192):
            self.learn(new[at : at + 8192])
        m = self.model
        f = [sum(map(self.known.__getitem__, ws)) / (len(ws) + SHRINK) + m.bias for ws in cut]
        for w in new:
            if len(w) > LONG:
                del self.known[w]
        return (1 / (1 + np.exp(-np.clip(m.a * np.array(f) + m.b, -500, 500)))).tolist()


def fit(texts: list[str], labels: list[int]) -> Model:
    """Texts and labels -> model; the same for the same rows in the same order. With one class only, a constant score."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)
        return Model(["^none$"], np.zeros(1), 0.0, 0.0, float(np.log(p / (1 - p))))
    one: dict[str, str] = {}  # equal words of all texts are one object
    counts = [Counter(one.setdefault(w, w) for w in map(clean, split(t))) for t in texts]
    del one
    marks = choose(counts, y)
    landmarks = Landmarks(marks)
    value, vector = np.linalg.eigh(landmarks.kernel(marks).astype(np.float64))
    value = np.maximum(value, 1e-3)
    root = vector / np.sqrt(value)  # the Nystroem map: kernel to the landmarks times this
    every = list(dict.fromkeys(w for c in counts for w in c))
    place = {w: i for i, w in enumerate(every)}
    k = np.empty((len(every), len(marks)), np.float32)
    for at in range(0, len(every), 8192):
        k[at : at + 8192] = landmarks.of_words(every[at : at + 8192])
    mean = np.zeros((len(counts), len(marks)))
    for i, c in enumerate(counts):
        if c:
            n = np.fromiter(c.values(), np.float64)
            mean[i] = n @ k[[place[w] for w in c]] / (n.sum() + SHRINK)
    x = mean @ root
    shift = x.mean(0)
    # directions in which clean texts vary little weigh as much as those in which they vary a lot
    size = np.array([sum(c.values()) for c in counts])
    plain = x[(y == 0) & (size >= SHRINK)] if ((y == 0) & (size >= SHRINK)).sum() > len(marks) else x
    value, vector = np.linalg.eigh(np.cov(plain.T).reshape(len(marks), -1))
    spread = vector / np.sqrt(np.maximum(value, 0) + RIDGE * value.mean() + 1e-12)
    z = (x - shift) @ spread
    scale = 1 / (np.sqrt((z**2).sum(1).mean()) + 1e-12)
    z *= scale
    c = np.where(y == 1, COST * len(y) / (2 * y.sum()), COST * len(y) / (2 * (1 - y).sum()))
    turn = np.arange(len(y)) % 4  # calibration on scores of rows that the machine hasn't seen
    held = np.zeros(len(y))
    for t in range(4):
        w = train_svm(z[turn != t], y[turn != t], c[turn != t])
        held[turn == t] = z[turn == t] @ w[:-1] + w[-1]
    a, b = platt(held, y)
    w = train_svm(z, y, c)
    along = spread @ w[:-1] * scale
    return Model(marks, root @ along, float(w[-1] - shift @ along), a, b)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where("crc32(cast(doc_id as string)) % 3 != 1")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample ids of each class, of the rows that aren't held out.

    An id labelled twice counts by its largest label, one that several rows share by the smallest of their texts.
    """
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = f"text IS NOT NULL AND length(text) <= {SAMPLE_CHARS}"
    there = learnable(docs.where(short).select("doc_id")).join(learnable(labels), "doc_id")  # ids only are shuffled
    ids = [
        (r.doc_id, value)
        for value in (1, 0)
        for r in there.where(F.col("toxic") == value).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    ]
    if not ids:
        return fit([], [])
    columns = [pa.array(c, t) for c, t in zip(zip(*ids, strict=True), (pa.int64(), pa.int32()), strict=True)]
    # two samples at most; from an Arrow table, since rows would go through Python workers of another kind, kept beside those of the kernels
    picked = docs.sparkSession.createDataFrame(pa.table(columns, names=["doc_id", "toxic"]))
    rows = docs.where(short).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    rows = sorted(rows, key=lambda r: (-r.toxic, zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    texts, y = [r.text for r in rows], [r.toxic for r in rows]
    return fit(texts, y)


_OF_WORKER: dict = {}


def scorer(model: Model) -> Scorer:
    key = model.key()
    if key not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[key] = Scorer(model)
    return _OF_WORKER[key]


def score_batches(batches, model, whole_rows: bool):
    alone("toxicity", _OF_WORKER.clear)
    s = scorer(model.value)
    for batch in slices(batches, "text", 2 << 20):
        scores = np.array(s.scores([t or "" for t in batch.column("text").to_pylist()]))
        if whole_rows:
            keep = pa.array(scores < CUT)
            yield batch.filter(keep)
        else:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by its whole text.

    A null text is scored as an empty one; a long run without white space is one word, of which each landmark counts where
    it fits best; repeated rows each come out. A null doc_id is never trained on, and is not
    held out. Columns besides doc_id and text aren't looked at. Without labels of both classes the score is constant.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, sample))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"),
    )
    return rows.mapInArrow(partial(score_batches, model=model, whole_rows=False), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that score CUT or more; all columns and other rows stay as they are."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, sample))
    return docs.mapInArrow(partial(score_batches, model=model, whole_rows=True), docs.schema)
