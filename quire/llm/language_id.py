"""Language identification by a byte convolutional network.

A window of WINDOW bytes is embedded byte by byte; filters of widths 2, 3 and 4 slide over it, each filter keeps its
maximum (after a rectifier), and a softmax on the maxima gives the language. The network is trained in numpy, by
Adam, on windows of a bounded sample of labelled texts; every value of lang is a class, however long its texts. A text's prediction is the mean of its windows' softmaxes,
over all its windows. For inference embedding and filters are folded into tables: one over byte pairs gives, at
once, what a pair adds to every filter at either place, so a window costs lookups, sums and maxima alone.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import ship, slices

WINDOW = 256
SAMPLE = 400  # labelled texts of each language, the first by a hash of id and text
MOST_SAMPLES = 12_000  # of all languages together; with more than 30 languages each has fewer than SAMPLE, and one at least
BROADCAST_LANGUAGES = 50_000  # under 5 MB
WINDOWS = 8  # of each sampled text, spread over the whole of it
EMBED, FILTERS, WIDTHS = 8, 12, (2, 3, 4)
UNKNOWN = "und"


def windows(data: bytes) -> np.ndarray:
    """The whole text in windows of WINDOW bytes; the last one is filled with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        self.p["embed"][0] = 0
        for k in WIDTHS:
            self.p[f"w{k}"] = rng.normal(0, (2 / (k * EMBED)) ** 0.5, (k, EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{k}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.p["bias"] = np.zeros(len(classes), np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for windows x and classes y."""
        p, n = self.p, len(x)
        e = p["embed"][x]
        kept, h = [], []
        for k in WIDTHS:
            length = x.shape[1] - k + 1
            a = sum(e[:, j : j + length] @ p[f"w{k}"][j] for j in range(k)) + p[f"b{k}"]
            at = a.argmax(axis=1)
            kept.append(at)
            h.append(np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0], 0))
        hidden = np.hstack(h)
        z = hidden @ p["out"] + p["bias"]
        z -= z.max(1, keepdims=True)
        soft = np.exp(z)
        soft /= soft.sum(1, keepdims=True)
        loss = -np.log(soft[np.arange(n), y] + 1e-12).mean()
        d = soft
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": hidden.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
        dh = (d @ p["out"].T) * (hidden > 0)
        rows = np.arange(n)[:, None]
        for i, k in enumerate(WIDTHS):
            dk = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{k}"] = dk.sum(0)
            gw = np.zeros_like(p[f"w{k}"])
            for j in range(k):
                place = kept[i] + j  # [n, FILTERS]
                gw[j] = np.einsum("nfe,nf->ef", e[rows, place], dk)
                np.add.at(g["embed"], x[rows, place], dk[:, :, None] * p[f"w{k}"][j].T[None])
            g[f"w{k}"] = gw
        g["embed"][0] = 0  # the filling stays neutral
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int, batch: int = 128, rate: float = 4e-3, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for turn in range(rounds):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                _, g = self.step(x[at], y[at])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] -= rate * (1 - turn / rounds) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)


class Folded:
    """The trained network as tables. pair: [65536, 4 F] for width 2, the first two and the last two bytes of width 4, the first two of width 3; single: the last byte of width 3."""

    def __init__(self, classes: list[str], p: dict):
        one = {(k, j): p["embed"] @ p[f"w{k}"][j] for k in WIDTHS for j in range(k)}
        both = lambda a, b: (one[a][:, None, :] + one[b][None, :, :]).reshape(65536, FILTERS)
        self.pair = np.hstack([both((2, 0), (2, 1)), both((4, 0), (4, 1)), both((3, 0), (3, 1)), both((4, 2), (4, 3))]).astype(np.float32)
        self.single = one[3, 2].astype(np.float32)
        self.bias = np.concatenate([p["b2"], p["b3"], p["b4"]])
        self.out, self.end, self.classes = p["out"], p["bias"], classes

    def softmax(self, x: np.ndarray) -> np.ndarray:
        """[windows, classes], 64 windows at a time."""
        out = []
        f = FILTERS
        for at in range(0, len(x), 64):
            w = x[at : at + 64].astype(np.int32)
            g = self.pair.take((w[:, :-1] << 8) | w[:, 1:], axis=0)  # [n, WINDOW - 1, 4 F]
            top2 = g[:, :, :f].max(1)
            top3 = (g[:, :-1, 2 * f : 3 * f] + self.single.take(w[:, 2:], axis=0)).max(1)
            top4 = (g[:, :-2, f : 2 * f] + g[:, 2:, 3 * f :]).max(1)
            h = np.maximum(np.hstack([top2, top3, top4]) + self.bias, 0)
            z = h @ self.out + self.end
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def sampled(docs: DataFrame, sample: int) -> list[tuple[str, bytes]]:
    """(lang, windows) of at most sample different texts of each value of lang, of the rows that aren't held out, in a fixed order.

    Rows are told apart by a hash of id and text. Each language has a threshold on it, from the number of its different
    rows, so one pass takes the samples of all languages and the driver gets the windows of some 3/2 samples,
    not texts, whatever the number of rows, tasks and repetitions.
    """
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND octet_length(text) > 0 AND crc32(cast(doc_id as string)) % 3 != 1")
    known = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"))
    many = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not many:
        return []
    each = max(1, min(sample, MOST_SAMPLES // len(many)))
    least = [(lang, min((1 << 63) - 1, -(1 << 63) + (3 * (each + 8) << 63) // max(n, 1))) for lang, n in many.items()]
    table = docs.sparkSession.createDataFrame(least, "lang string, most long")
    chosen = known.join(F.broadcast(table) if len(least) <= BROADCAST_LANGUAGES else table, "lang").where("h <= most")

    def pick(batches):
        for batch in slices(batches, "text", 1 << 20):
            cut = [windows(t.encode()) for t in batch.column("text").to_pylist()]
            some = [w[np.unique(np.linspace(0, len(w) - 1, WINDOWS).astype(int))].tobytes() for w in cut]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(some, pa.binary())], names=["lang", "h", "windows"])

    rows = chosen.select("lang", "h", "text").mapInArrow(pick, "lang string, h long, windows binary").dropDuplicates(["lang", "h"]).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= each:
            out.append((r.lang, bytes(r.windows)))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Folded | None:
    """Fit on the sample of every language; None if no row can be learnt from."""
    found = sampled(docs, sample)
    if not found:
        return None
    classes = sorted({lang for lang, _ in found})
    x, y = [], []
    for lang, raw in found:
        i = classes.index(lang)
        for row in np.frombuffer(raw, np.uint8).reshape(-1, WINDOW):
            x.append(row)
            y.append(i)
            if np.count_nonzero(row) > 48:  # short texts are to be known as well
                short = np.zeros(WINDOW, np.uint8)
                size = 12 + zlib.crc32(row.tobytes()) % 36
                short[:size] = row[:size]
                x.append(short)
                y.append(i)
    net = Network(classes)
    x, y = np.array(x), np.array(y)
    net.train(x, y, rounds=max(3, min(40, 30_000 // len(x))) if len(classes) > 1 else 1)
    return Folded(classes, net.p)


def predict_batches(batches, model):
    net: Folded = model.value
    for batch in slices(batches, "text", 1 << 20):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        some = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if some:
            cut = [windows(texts[i].encode()) for i in some]
            soft = net.softmax(np.concatenate(cut))
            weight = np.concatenate([np.count_nonzero(w, axis=1) for w in cut])[:, None]  # a filled window counts by its bytes
            first = np.cumsum([0, *map(len, cut[:-1])])
            mean = np.add.reduceat(soft * weight, first) / np.maximum(np.add.reduceat(weight, first), 1)
            for i, best, value in zip(some, mean.argmax(1).tolist(), mean.max(1).tolist(), strict=True):
                lang[i], score[i] = net.classes[best], min(1.0, value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by its whole text.

    A text that is null or has no letter is "und" with score 0, and so is every text if no row is labelled. A null
    doc_id is never trained on, and is not held out. Repeated rows each come out and are learnt from once; ties go to the
    first language by name. Columns besides doc_id, text and lang aren't looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, sample))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"),
    )
    return rows.mapInArrow(partial(predict_batches, model=model), "doc_id long, held_out boolean, lang_pred string, score double")
