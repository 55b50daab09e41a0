"""SentencePiece encoding and decoding of words behind a worker's cache, by batched Viterbi in numpy.

Words of equal length advance together, position by position: hashes of all their substrings that end there probe the
sorted hashes of the pieces, and one maximum over the substrings' starts gives the best score and the backpointer
for all words at once. A character that no piece covers becomes its UTF-8 bytes' pieces.

What is maximised follows the model's type. For unigram models it is the sum of the pieces' scores; a character
without a piece costs the lowest score less 10, and of equal scores the longest last piece wins. The scores of a BPE model
are ranks of merges. Its encoding is the one sequence in which merges leave every two neighbours apart, and every
prefix has one, too: so a prefix's best score is the number of pieces in its only valid sequence, and the last piece of a
longer one must be a neighbour that merges leave apart (class Merges). The ids are the library's.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm.common import alone, ship, slices
from quire.llm.pieces import MODEL, SPACE, vocabulary, words

BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE = 150_000  # words of either half of a worker's cache
LONG = 48
CELLS = 1 << 18  # characters of words that advance together


def mix(x: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value for a code point (splitmix64)."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Encoder:
    def __init__(self, name: str):
        v = self.v = vocabulary(name)
        keys = [np.uint64(0)] * len(v.ids)
        with np.errstate(over="ignore"):
            for k, i in enumerate(v.ids.tolist()):
                h = np.uint64(0)
                for m in mix(code_points(v.pieces[i])):
                    h = h * BASE + m
                keys[k] = h
        order = np.argsort(keys)
        self.keys = np.array(keys, np.uint64)[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces share a hash")
        self.ids = v.ids[order].astype(np.int32)
        self.scores = v.scores[self.ids]
        self.longest = max(len(v.pieces[i]) for i in v.ids.tolist())
        # a first probe: most substrings' hashes are no piece's, and a table of 2^20 bits says so; the others' bits tell where to look
        slot = (self.keys >> np.uint64(44)).astype(np.int64)
        many = np.bincount(slot, minlength=1 << 20)
        self.bits = many > 0
        self.start = (np.cumsum(many) - many).astype(np.int32)
        self.most = int(many.max(initial=0))
        self.unknown = float(v.scores[v.ids].min()) - 10
        self.byte_ids, self.chars = v.byte_ids.tolist(), {}

    def probe(self, h: np.ndarray) -> np.ndarray:
        """The pieces' places among the sorted keys, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe, at = self.hits(h)
        out[maybe] = at
        return out

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces', in order, and the pieces' places among the sorted keys."""
        slot = (h >> np.uint64(44)).view(np.int64)
        maybe = np.flatnonzero(self.bits[slot])
        at = self.start[slot[maybe]]
        asked = h[maybe]
        hit = self.keys[at] == asked
        for _ in range(self.most - 1):  # keys that share a slot stand one after the other
            miss = np.flatnonzero(~hit)
            at[miss] = np.minimum(at[miss] + 1, len(self.keys) - 1)
            hit[miss] = self.keys[at[miss]] == asked[miss]
        return maybe[hit], at[hit]

    def gains(self, found: np.ndarray, before: np.ndarray) -> np.ndarray:
        """[words, starts] what the pieces found (-1: none) add behind the pieces before (-1: none, -2: the start); -inf where they can't stand."""
        score = np.where(found >= 0, self.scores[found], -np.inf)
        score[found[:, -1] < 0, -1] = self.unknown
        return score

    def equal_lengths(self, chars: np.ndarray) -> list[bytes]:
        """chars: n words of one length as code points -> for each the ids as little-endian int32 bytes."""
        n, length = chars.shape
        mixed = mix(chars)
        most = min(self.longest, length)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), np.int32)
        piece = np.full((n, length + 1), -1, np.int32)
        piece[:, 0] = -2
        ends = np.zeros((n, most + 1), np.uint64)  # of the substring of each size that ends here
        rows = np.arange(n)
        with np.errstate(over="ignore"):
            for end in range(1, length + 1):
                sizes = min(end, most)
                ends[:, 1 : sizes + 1] = ends[:, :sizes] * BASE + mixed[:, end - 1 : end]
                found = self.probe(ends[:, sizes:0:-1].ravel()).reshape(n, sizes)  # longest first
                score = self.gains(found, piece[:, end - sizes : end]) + best[:, end - sizes : end]
                pick = score.argmax(axis=1)
                best[:, end] = score[rows, pick]
                back[:, end] = end - sizes + pick
                place = found[rows, pick]
                piece[:, end] = np.where(place >= 0, self.ids[place], -1)
        return self.followed(chars, back, piece)

    def followed(self, chars: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """The pieces along the backpointers, from the ends of all words at once."""
        n, length = chars.shape
        rows, at = np.arange(n), np.full(n, length)
        steps = []
        while at.any():
            steps.append(np.where(at > 0, piece[rows, at], -2))
            at = back[rows, at]  # the start points to itself
        ids = np.stack(steps[::-1], axis=1)
        ends = np.cumsum((ids != -2).sum(1)) * 4
        raw = ids[ids != -2].astype("<i4").tobytes()
        out = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for r in np.flatnonzero((ids == -1).any(1)).tolist():
            out[r] = self.with_bytes(chars[r], ids[r][ids[r] != -2])
        return out

    def with_bytes(self, chars: np.ndarray, ids: np.ndarray) -> bytes:
        """ids with the pieces of a character's UTF-8 bytes, or the unknown piece, for each -1."""
        out: list[int] = []
        at = 0
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
                at += len(self.v.pieces[i])
                continue
            out.extend(self.of_char(int(chars[at])))
            at += 1
        return np.array(out, "<i4").tobytes()

    def of_char(self, point: int) -> list[int]:
        """The ids of a character that no piece covers."""
        found = self.chars.get(point)
        if found is None:
            of_bytes = [self.byte_ids[b] for b in chr(point).encode("utf-8", "surrogatepass")]
            found = self.chars[point] = of_bytes if min(of_bytes) >= 0 else [self.v.unknown]
        return found

    def words(self, new: list[str]) -> dict[str, bytes]:
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        out: dict[str, bytes] = {}
        for length, group in by_length.items():
            step = max(1, CELLS // (length * min(self.longest, length)))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                chars = code_points("".join(part).replace(" ", SPACE)).reshape(len(part), length)
                out.update(zip(part, self.equal_lengths(chars), strict=True))
        return out


class Merges(Encoder):
    """The encoder of BPE models.

    Merging alone, a piece passes through states; its outermost symbol on either side (its edge) grows step by step. The
    mark of a step is the least priority of all merges up to it: with others beside it, the piece gets to that step
    when no merge above the mark is left anywhere. So edge x of one piece and y of the next are there together while the
    priority under way is within the marks of both, and the two pieces are pulled together if x + y is a piece of such
    a priority. Of equal priorities the left merge comes first. Two pieces that no pair of edges pulls together stay
    apart, and a sequence of which all neighbours stay apart is what merging the whole text gives.
    """

    TABLE = 1 << 19  # pairs of neighbours whose answer a worker keeps: 5 MB

    def __init__(self, name: str):
        super().__init__(name)
        v = self.v
        texts = {v.pieces[i]: i for i in v.ids.tolist()}
        made = {t: float(v.scores[i]) for t, i in texts.items() if len(t) > 1}
        if any(c not in texts for t in made for c in t):
            raise ValueError("a piece has a character that is no piece")
        size = self.size = len(v.pieces)
        self.whole = np.zeros(size, bool)  # merging the piece's text alone gives the piece
        edges: list[list[tuple]] = [[], []]  # of the right side, of the left side: (piece, symbol, mark when it comes, mark when it goes)
        for text, i in texts.items():
            symbols, mark = list(text), np.inf
            shown = [[symbols[-1], mark], [symbols[0], mark]]
            while len(symbols) > 1:
                options = [made.get(a + b, -np.inf) for a, b in zip(symbols, symbols[1:], strict=False)]
                top = max(options)
                if top == -np.inf:
                    break
                k = options.index(top)
                mark = min(mark, top)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                for side, symbol in enumerate((symbols[-1], symbols[0])):
                    if symbol != shown[side][0]:
                        edges[side].append((i, texts[shown[side][0]], shown[side][1], mark))
                        shown[side] = [symbol, mark]
            if len(symbols) == 1:
                self.whole[i] = True
                for side in (0, 1):
                    edges[side].append((i, i, shown[side][1], -np.inf))
        self.edges = []
        for found in edges:
            found.sort(key=lambda x: x[0])
            of, symbol, come, go = (np.array(c) for c in zip(*found, strict=True))
            self.edges.append((np.searchsorted(of, np.arange(size + 1)), symbol, come, go))
        pairs = {texts[t[:k]] * size + texts[t[k:]]: p for t, p in made.items() for k in range(1, len(t)) if t[:k] in texts and t[k:] in texts}
        self.pair = np.array(sorted(pairs), np.int64)
        self.priority = np.array([pairs[k] for k in self.pair.tolist()])
        self.asked, self.said = np.full(self.TABLE, -1, np.int64), np.zeros(self.TABLE, bool)

    def decide(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merges leave the pieces apart, by all pairs of their edges."""
        (at_l, symbol_l, come_l, go_l), (at_r, symbol_r, come_r, go_r) = self.edges
        n_l, n_r = at_l[left + 1] - at_l[left], at_r[right + 1] - at_r[right]
        many = n_l * n_r
        who = np.repeat(np.arange(len(left)), many)
        k = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        x, y = at_l[left][who] + k // n_r[who], at_r[right][who] + k % n_r[who]
        key = symbol_l[x] * self.size + symbol_r[y]
        place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        p = np.where(self.pair[place] == key, self.priority[place], np.nan)
        pulled = (go_l[x] < p) & (p <= come_l[x]) & (go_r[y] <= p) & (p <= come_r[y])
        out = self.whole[left] & self.whole[right]
        out[who[pulled]] = False
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """decide() behind a table of pairs asked before."""
        key = left.astype(np.int64) * self.size + right
        with np.errstate(over="ignore"):
            slot = (mix(key.view(np.uint64)) & np.uint64(self.TABLE - 1)).astype(np.int64)
        new = np.flatnonzero(self.asked[slot] != key)
        out = self.said[slot]
        if len(new):
            distinct, inverse = np.unique(key[new], return_inverse=True)
            said = np.concatenate([self.decide(part // self.size, part % self.size) for part in np.array_split(distinct, len(distinct) // 65536 + 1)])
            out[new] = said[inverse]
            self.asked[slot[new]], self.said[slot[new]] = key[new], out[new]
        return out

    def gains(self, found: np.ndarray, before: np.ndarray) -> np.ndarray:
        """1 for the one piece that can end here."""
        out = np.full(found.shape, -np.inf)
        row, col = np.nonzero(found >= 0)
        piece, last = self.ids[found[row, col]], before[row, col]
        fine = np.where(last == -2, self.whole[piece], True)
        pair = np.flatnonzero(last >= 0)
        fine[pair] = self.apart(last[pair], piece[pair])
        out[row[fine], col[fine]] = 1
        out[found[:, -1] < 0, -1] = 1
        return out


    def equal_lengths(self, chars: np.ndarray) -> list[bytes]:
        """As Encoder's: of each prefix only the pieces found are looked at, and of those the one that can end it is taken without a maximum."""
        n, length = chars.shape
        mixed = mix(chars).T
        most = min(self.longest, length)
        back = np.zeros((length + 1, n), np.int32)  # by place, so that a step works on rows that lie together
        piece = np.full((length + 1, n), -1, np.int32)
        piece[0] = -2
        ends = np.zeros((most + 1, n), np.uint64)
        with np.errstate(over="ignore"):
            for end in range(1, length + 1):
                sizes = min(end, most)
                ends[1 : sizes + 1] = ends[:sizes] * BASE + mixed[end - 1]
                found, at = self.hits(ends[1 : sizes + 1].ravel())
                less, row = np.divmod(found, n)
                this, last = self.ids[at], piece[end - 1 - less, row]
                fine = np.where(last == -2, self.whole[this], True)
                pair = np.flatnonzero(last >= 0)
                fine[pair] = self.apart(last[pair], this[pair])
                bare = np.ones(n, bool)  # the character itself is no piece
                bare[row[less == 0]] = False
                bare = np.flatnonzero(bare)
                row, less, this = row[fine], less[fine], this[fine]
                if len(row) + len(bare) != n or (np.bincount(row, minlength=n).max(initial=0) > 1):
                    return super().equal_lengths(chars)  # not one way for each prefix: by the maximum
                back[end, row], piece[end, row] = end - 1 - less, this
                back[end, bare] = end - 1
        return self.followed(chars, back.T, piece.T)


class Codec:
    """An encoder, that of unigram models if none is given, with a cache of words; one a process."""

    def __init__(self, name: str, encoder: Encoder | None = None):
        self.encoder, self.known, self.old = encoder or Encoder(name), {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [words(t) for t in texts]
        every = set().union(*cut)
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHE:  # the older half goes, but for what is still in use
            self.old, self.known, new = self.known, {}, every
        fresh = list(new.difference(self.old))
        self.known.update((w, self.old[w]) for w in new.difference(fresh))
        self.known.update(self.encoder.words(fresh) if fresh else {})
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in cut]
        for w in fresh:
            if len(w) > LONG:
                del self.known[w]
        return out

    def decode(self, ids: bytes) -> str:
        raw = self.encoder.v.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def codec(name: str = MODEL) -> Codec:
    return Codec(name, Merges(name) if vocabulary(name).is_bpe else None)


def forget() -> None:
    codec.cache_clear()
    vocabulary.cache_clear()


def encode_batches(batches, name: str):
    alone("sentencepieces", forget)
    c = codec(name)
    for batch in slices(batches, "text", 2 << 20):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = c.encode(texts)
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, f in enumerate(batch.schema.names)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*batch.schema.names, "piece_ids"])


def digest_batches(batches, name: str):
    alone("sentencepieces", forget)
    c = codec(name)
    for batch in slices(batches, "text", 2 << 20):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = c.encode(texts)
        same = [c.decode(x) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
        digest = [f"{xxhash.xxh64_intdigest(x):016x}" for x in ids]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digest), pa.array(same)],
            names=["doc_id", "n_pieces", "ids_digest", "round_trip"],
        )


def encode(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """docs with piece_ids array<int> added (in place of a column of that name); a null or empty text has none. All other columns pass through."""
    ship(docs.sparkSession)
    docs = docs.drop("piece_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(partial(encode_batches, name=name), schema)


def decode(frame: DataFrame, name: str = MODEL) -> DataFrame:
    """frame(piece_ids) with text replaced by what the ids stand for; spaces stand for U+2581, null ids for an empty text."""
    ship(frame.sparkSession)

    @F.pandas_udf("string")
    def run(ids):
        c = codec(name)
        return ids.map(lambda x: c.decode(np.asarray(x if x is not None else [], "<i4").tobytes()))

    return frame.withColumn("text", run("piece_ids"))


def encode_digests(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_digest (XXH64 of the ids as little-endian int32, 16 hex digits), round_trip of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(digest_batches, name=name), "doc_id long, n_pieces long, ids_digest string, round_trip boolean")
