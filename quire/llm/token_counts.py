"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths, in tokens, of frequent words: the TABLE most frequent words of a
bounded sample of texts, packed in one byte string with offsets (under MOST_BYTES), broadcast, and unpacked once a
worker. Tier two is the worker's own cache of the words that the table misses, each encoded by the library once
and kept up to CACHE words. Words are never shuffled, and neither the sample nor the caches can change a count.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import alone, least, ship, slices
from quire.llm.pieces import MODEL, vocabulary, words

SAMPLE = 2000  # different texts, the first by a hash of the text
SAMPLE_CHARS = 20_000  # longer texts are no part of the sample
TABLE = 1 << 16
MOST_BYTES = 4 << 20
CACHE = 400_000
LONG = 48  # words longer than this aren't kept
LIMIT = 4096


class Lengths(dict):
    """word -> tokens; what is missing is encoded, and kept while there is room."""

    def __init__(self, name: str, known: dict):
        super().__init__(known)
        self.known, self.encode = known, vocabulary(name).processor.encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word[1:])) if len(word) > 1 else 1
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.known)
            self[word] = n
        return n


def pack(known: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    raw = [w.encode() for w in known]
    return b"".join(raw), np.cumsum([0, *map(len, raw)]).astype(np.uint32).tobytes(), np.array(list(known.values()), np.uint16).tobytes()


def unpack(packed: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    blob, ends, n = packed[0], np.frombuffer(packed[1], np.uint32).tolist(), np.frombuffer(packed[2], np.uint16).tolist()
    return {blob[a:b].decode(): x for a, b, x in zip(ends[:-1], ends[1:], n, strict=True)}


def frequent(docs: DataFrame, name: str, sample: int = SAMPLE, size: int = TABLE) -> tuple[bytes, bytes, bytes]:
    """The packed table of the most frequent words of a bounded sample of different texts.

    Copies are merged on the map side, so a text that many rows share is sent on once a task.
    """
    hashed = F.xxhash64("text")
    some = docs.where(f"length(text) <= {SAMPLE_CHARS}").where(least(hashed, sample, docs.count()))
    some = some.select("text").distinct().orderBy(hashed, "text").limit(sample)
    counts: Counter = Counter()
    for row in some.collect():
        counts.update(w for w in words(row.text) if len(w) <= LONG)
    lengths = Lengths(name, {})
    kept: dict[str, int] = {}
    room = MOST_BYTES
    for w, _ in counts.most_common(size):
        room -= len(w.encode()) + 6
        if room < 0:
            break
        kept[w] = min(lengths[w], 65535)
    return pack(kept)


_OF_WORKER: dict = {}


def of_worker(name: str, packed) -> Lengths:
    """This worker's lookup; it stays for the tasks to come with the same table."""
    key = (name, hash(packed.value[0]), len(packed.value[0]))
    if key not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[key] = Lengths(name, unpack(packed.value))
    return _OF_WORKER[key]


def count_batches(batches, name: str, packed, limit: int):
    alone("token_counts", _OF_WORKER.clear)
    lengths = of_worker(name, packed)
    for batch in slices(batches, "text"):
        n_bytes, n_tokens = [], []
        for t in batch.column("text"):
            text = t.as_py() or ""
            n_bytes.append(len(text.encode()))
            n_tokens.append(sum(map(lengths.__getitem__, words(text))))
        counted = pa.array(n_tokens, pa.int64())
        over = pa.array([n > limit for n in n_tokens], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), counted, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, name: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, as the library counts without begin, end or added specials.

    A null text is empty; an empty text has 0 tokens. Repeated rows each come out; other columns aren't looked at.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = docs.sparkSession.sparkContext.broadcast(frequent(rows, name))
    return rows.mapInArrow(partial(count_batches, name=name, packed=packed, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
