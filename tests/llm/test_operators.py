"""Each operator against brute force on small tables: nulls, empty and long texts, repeated rows, ties, empty tables, clashing names."""

import base64
import gzip
import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bloom, cover_tree, graph_search, language_id, mixing, near_copies, secrets, sentencepieces, simhash, token_counts, toxicity, warc
from quire.llm.common import least
from quire.llm.pieces import MODEL, SPACE, model_type, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, copies long, fp long, piece_ids string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strong potions in the old tower near the river"


def docs(spark, texts, **more):
    rows = [(more.get("ids", range(len(texts)))[i], t, "en", f"src{i % 3}", len(t) if t is not None else None, "x", 7, 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", "   \n\t ", "word", "Ärger über é", PROSE, PROSE, PROSE.upper(), PROSE + " again", "x" * 5000, "ab " * 4000, "token = abcdef1234 and\x00nul", "😀 " * 9, "▁odd▁ text", "   spaces   run "]


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, within):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= within:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_near_dedup(docs(spark, EDGE)).collect()}
    fps = [brute_fingerprint(t) for t in EDGE]
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, brute_components(fps, 4), strict=True))}


def test_simhash_empty_and_repeated(spark):
    assert simhash.simhash_near_dedup(docs(spark, [])).count() == 0
    some = docs(spark, [PROSE, PROSE, "other words entirely", None], ids=[5, 5, None, 9])
    assert sorted(r.component_id for r in simhash.simhash_near_dedup(some).collect() if r.doc_id == 5) == [5, 5]
    kept = simhash.keep_one(some)
    assert kept.columns == some.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 5, 9]


def test_pipeline_drops_all_near_copies(spark):
    rng = np.random.default_rng(3)
    texts = [*EDGE, "one two", "ONE  two", "one two three"]
    for n in (30, 80, 200):
        base = [f"w{x}" for x in rng.integers(0, 400, n)]
        for edits in (0, 1, 1, 1, 2, 3, n // 10):
            copy = list(base)
            for at in rng.integers(0, n, edits):
                copy[at] = f"new{rng.integers(0, 1000)}"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))
    wide = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            wide += (brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[j])).bit_count() > 4
            up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    assert wide > 5
    kept = corpus_pipeline.near_dedup(spark, docs(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(up))
    assert corpus_pipeline.near_dedup(spark, docs(spark, []), "").count() == 0


def test_near_dedup_links_by_fingerprints_and_trees(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 400, 300)]
    texts = [" ".join(base), " ".join(base).upper(), "an unrelated text that has nothing like it", None]
    for edits in (1, 2, 3, 6, 12):
        copy = list(base)
        for at in rng.integers(0, 300, edits):
            copy[at] = f"new{at}"
        texts.append(" ".join(copy))
    texts.append(" ".join(base[:260]))
    sets = [near_copies.shingles((t or "").encode().lower()) for t in texts]
    sims = [near_copies.fingerprint(s) for s in sets]
    assert sims == [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s.tolist()) > len(s)) - ((sum(x >> 63 for x in s.tolist()) * 2 > len(s)) << 64) for s in sets]
    assert near_copies.WITHIN // near_copies.BLOCKS == 1
    up = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if ((sims[i] ^ sims[j]) & (2**64 - 1)).bit_count() <= 7 and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    assert len(set(up)) < len(up) - 2
    schema = "token long, salt byte, fp long, n int, behind int"
    monkeypatch.setattr(near_copies, "posts", lambda rows: spark.createDataFrame([], schema))  # the trees alone
    got = {r.doc_id: r.component_id for r in near_copies.classes(docs(spark, texts)).collect()}
    assert got == dict(enumerate(up))


def test_leaves_pair_each_probe_with_the_smallest_and_the_nearest():
    home, probes = np.array([8, 9, 31, 1 << 40], np.uint64), np.array([8, 11, 1 << 41], np.uint64)
    a, b = simhash.leaf_pairs(home, probes, (1 << 64) - 1, 3, 3)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(8, 9), (11, 8), (11, 9), (1 << 41, 8)}  # 2 bits to 8 and to 1 << 40


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    pool = np.sort(rng.integers(0, 2**63, 40, np.uint64))
    last = pool[::2]
    for _ in range(3000):
        x = rng.random(40) < 0.7
        x[0] = True
        y = x ^ (rng.random(40) < 0.1)
        a, b = pool[x], pool[y]
        if 5 * (x & y).sum() >= 4 * (x | y).sum():
            (p, _), (q, _) = (near_copies.first(s, last, np.arange(20)) for s in (a, b))
            common = [t for t in p.tolist() if t in q.tolist()]
            at, bt = p.tolist().index(common[0]), q.tolist().index(common[0])
            assert 9 * min(len(a) - at, len(b) - bt) >= 4 * (len(a) + len(b))


def test_shingles_and_odd_bits():
    rng = np.random.default_rng(5)
    seen = {}
    for n in (0, 1, 4, 5, 6, 300, 2000):
        words = [str(x) for x in rng.integers(0, 50, n)]
        for text in (" ".join(words), "  \t" + "\n ".join(words) + " "):
            got = near_copies.shingles(text.upper().encode())
            want = {" ".join(words[i : i + 5]) for i in range(max(1, n - 4))} if n else set()
            assert len(got) == len(want) and (np.diff(got.view(np.uint64)) > 0).all()
        seen |= dict.fromkeys(got.tolist())
    assert set(near_copies.shingles(b"a b c d e f").tolist()) == set(near_copies.shingles(b"a b c d e").tolist()) | set(near_copies.shingles(b"b c d e f").tolist())
    old, near_copies.PART = near_copies.PART, 800  # parts of 100 words
    cut = near_copies.shingles(" ".join(words).encode())
    near_copies.PART = old
    assert (cut == got).all()
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 3000, rng.integers(1, 900), np.uint64)) for _ in range(2))
        x, y = near_copies.mixed(x), near_copies.mixed(y)
        assert near_copies.differ_at_least(near_copies.odd_bits(x), near_copies.odd_bits(y)) <= len(np.setxor1d(x, y))
    assert near_copies.differ_at_least(near_copies.odd_bits(x), near_copies.odd_bits(x)) == 0


def test_texts_that_stay_are_not_shuffled(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 20_000))) for _ in range(200)]
    table = docs(spark, [*texts, texts[0], texts[1]])
    found = simhash.rows_of(table).selectExpr("doc_id", "key", "key AS label")
    store = spark.sparkContext._jsc.sc().statusStore()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the table of copies is too large
    try:
        before = store.executorSummary("driver").totalShuffleWrite()
        kept = simhash.keep_one(table, found=found).collect()
        after = store.executorSummary("driver").totalShuffleWrite()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(r.doc_id for r in kept) == list(range(200))
    assert after - before < 500_000  # of 4 MB of texts


def test_sets_with_many_common_shingles_meet_once(spark, monkeypatch):
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join([*common, *(f"t{i}x{j}" for j in range(90))]) for i in range(12)]
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(near_copies, "frequent", lambda rows: (none.view(np.uint64), none, none.view(np.uint64)))
    met, possible = [], near_copies.possible

    def spied(pairs):
        met.append(sorted((r.a, r.b) for r in pairs.where(near_copies.reaches(F.least("behind", "behind_b"))).select("a", "b").collect()))
        return possible(pairs)

    monkeypatch.setattr(near_copies, "possible", spied)
    assert near_copies.classes(docs(spark, texts)).where("doc_id != component_id").count() == 0
    assert len(set(met[-1])) > 40
    assert len(met[-1]) < 1.5 * len(set(met[-1]))


def test_frequent_shingles_are_found_by_a_share_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 8)
    texts = [f"line{i % 10} of five common words " + " ".join(f"t{i}x{j}" for j in range(9)) for i in range(640)]
    got = set(near_copies.frequent(simhash.rows_of(docs(spark, texts)))[0].tolist())
    assert {int(near_copies.shingles(f"line{k} of five common words".encode())[0]) for k in range(10)} <= got
    rare = set(near_copies.shingles(texts[0].encode()).tolist()) - {int(near_copies.shingles(b"line0 of five common words")[0])}
    assert not rare & got
    monkeypatch.setattr(near_copies, "FREQUENT", 3)
    last, rank, crowded = near_copies.frequent(simhash.rows_of(docs(spark, texts)))
    assert len(last) == len(rank) <= 3 and not len(crowded)


def test_filter_holds_all_its_rows(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, i * i) for i in range(3000)], "a long, b long")
    other = rows.selectExpr("a", "-1 - b AS b")
    mark = bloom.maybe_in(rows, F.col("a"), F.col("b"))
    assert rows.where(mark).count() == 3000
    assert other.where(mark).count() < 300


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    texts = [PROSE, "a quite different text of seven words here", PROSE, "an unrelated text that has nothing like it", "an unrelated text that has nothing like it", PROSE, PROSE]
    table = docs(spark, texts, ids=[2, 7, 7, 5, 5, None, None])
    for kept in (simhash.keep_one(table), corpus_pipeline.near_dedup(spark, table, "")):
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted({(2, PROSE), (7, texts[1]), (5, texts[3])})
        assert kept.columns == table.columns
    nulls = docs(spark, [PROSE, PROSE, None], ids=[None, None, None])
    assert simhash.keep_one(nulls).count() == 2


def test_a_crowded_leaf_is_dealt_over_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 600, np.uint64)) ^ (np.uint64(1) << rng.integers(40, 64, 600, np.uint64)))
    monkeypatch.setattr(simhash, "LEAF", 32)
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = simhash.links(frame, leaf=200).collect()
    forest, want = simhash.Forest(len(x)), simhash.Forest(len(x))
    ends = [np.array([r[i] for r in got], np.int64).view(np.uint64) for i in (0, 1)]
    forest.union(*(np.searchsorted(x, e) for e in ends))
    want.union(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1)))
    assert (forest.up == want.up).all()


def test_vantage_trees_lose_no_link():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 300, np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 3), np.uint64), axis=1)
    x = np.unique(np.concatenate([centres, rng.choice(centres, 3000) ^ flips]))
    want = {(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4) if i < j}
    forest = simhash.Forest(len(x))
    for n, mask in enumerate(simhash.block_masks(4)):
        nodes = simhash.grow(x[:500], mask, 16, 1.0, n)
        home, probe = {}, {}
        for rows, leaf, _, resident in simhash.route(x, nodes, mask, 1):
            home.setdefault(leaf, []).extend(x[rows[resident]].tolist())
            probe.setdefault(leaf, []).extend(x[rows].tolist())
        assert sum(map(len, home.values())) == len(x)
        for leaf, members in home.items():
            a, b = simhash.leaf_links(np.array(members, np.uint64), np.array(probe[leaf], np.uint64), mask, 1, 4)
            forest.union(np.searchsorted(x, a), np.searchsorted(x, b))
    assert all(forest.up[i] == forest.up[j] for i, j in want)
    check = simhash.Forest(len(x))
    check.union(*np.array(sorted(want)).T)
    assert (check.up == forest.up).all()


def test_warc(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", None), (3, "u\r\n%3", "same"), (4, None, ""), (None, "u5", "same"), (6, "u6", "é" * 70000), (7, "u7", "WARC/1.1\r\n\r\nx")]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, payload string, refers_to int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("revisit", 2), None: ("response", None), 6: ("response", None), 7: ("response", None)
    }
    warc.archive(pages, f"file://{tmp_path}/a")
    read = warc.read_archive(spark, f"file://{tmp_path}/a")
    assert read.where("record_type = 'revisit'").count() == 2
    assert read.where("page_id = 3").first().target_uri == "u\r\n%3"
    assert bytes(read.where("page_id = 7").first().payload) == b"WARC/1.1\r\n\r\nx"
    assert read.where("page_id IN (6, 7) AND record_type = 'response'").count() == 2
    assert warc.read_archive(spark, f"file://{tmp_path}/a", payload="false").where("payload IS NOT NULL").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_by_brute_force(spark):
    rng = np.random.default_rng(13)
    rows = [(None if rng.random() < 0.05 else int(rng.integers(0, 300)), f"u{i}", None if rng.random() < 0.1 else "p" * int(rng.integers(0, 12))) for i in range(400)]
    rows = list({r[0] if r[0] is not None else f"n{i}": r for i, r in enumerate(rows)}.values())
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = sorted((repr(i), len(h or ""), "response" if i is None or first[h or ""] == i else "revisit", None if i is None or first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((repr(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == want


def test_warc_skips_without_inflating():
    rng = np.random.default_rng(14)
    payload = rng.integers(0, 256, 3 << 20, np.uint8).tobytes()
    row = lambda i: {"record_type": ("response", "request")[i % 2], "payload": payload, "page_id": i, "url": "é", "payload_bytes": len(payload), "payload_digest": "X", "refers_to": None}
    data = b"".join(warc.member(warc.record(row(i)), 1) for i in range(6))
    assert gzip.decompress(data) == b"".join(warc.record(row(i)) for i in range(6))
    for body, own in ((data, True), (b"".join(gzip.compress(warc.record(row(i)), 1) for i in range(6)), False)):
        stream = warc.Stream(io.BytesIO(body), True)
        found = list(warc.records(stream, True, lambda r: r["page_id"] == 3))
        assert [(r["page_id"], r["payload"] == payload) for r in found] == [(3, True)]
        assert (stream.inflated < len(payload) + 10 * warc.FIRST) == own
        stream = warc.Stream(io.BytesIO(body), True)
        assert [r["page_id"] for r in warc.records(stream, False, lambda r: r["record_type"] == "request")] == [1, 3, 5]
        assert (stream.inflated <= 6 * warc.FIRST) == own
    foreign = b"WARC/1.0\r\nwarc-type:warcinfo\r\nX-Odd: \xff\xfe\r\n\r\n\r\n\r\nWARC/1.0\r\nWARC-TYPE: response\r\ncontent-length:  3\r\n\r\nabc\r\n\r\n"
    for body, gz in ((foreign, False), (gzip.compress(foreign), True)):
        assert [(r["record_type"], r["payload"]) for r in warc.records(warc.Stream(io.BytesIO(body), gz), True, lambda r: True)] == [("warcinfo", b""), ("response", b"abc")]


def test_language(spark):
    words = {"aa": "shan tho wer ling", "bb": "zük öst grön"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[k].split(), 30)), k) for i in range(240) for k in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (None, "shan tho", None), (1003, rows[1][1] * 200, "bb")]
    out = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert np.mean([out[i].lang_pred == k for i, _, k in rows[:240] if out[i].held_out]) > 0.95
    assert out[1003].lang_pred == "bb" and all(0 <= r.score <= 1 for r in out.values())
    none = language_id.language_id(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.count() == 0


def test_language_of_repeated_rows_long_texts_and_many_languages(spark):
    for same in (7, 9, 10, 12, 13):
        if zlib.crc32(str(same).encode()) % 3 == 1:
            continue
        rows = spark.range(20_000).selectExpr(f"CAST({same} AS LONG) AS doc_id", "concat('shan tho wer ', id % 3) AS text", "'aa' AS lang", "'z' AS h")
        other = spark.range(60).selectExpr("id + 100 AS doc_id", "repeat('zük öst grön ', 4) AS text", "'bb' AS lang", "'z' AS h")
        sample = language_id.sampled(rows.union(other), 50)
        assert {lang for lang, _ in sample} == {"aa", "bb"} and len([1 for lang, _ in sample if lang == "aa"]) == 3
        out = language_id.language_id(rows.union(other), 50)
        assert out.count() == 20_060 and {r.lang_pred for r in out.where("doc_id >= 100").select("lang_pred").distinct().collect()} == {"bb"}
    long_ = spark.range(60).selectExpr("id AS doc_id", "repeat(IF(id % 2 = 0, 'shan tho wer ling ', 'zük öst grön '), IF(id % 2 = 0, 3000, 5)) AS text", "IF(id % 2 = 0, 'yy', 'zz') AS lang")
    assert {(r.doc_id % 2, r.lang_pred) for r in language_id.language_id(long_).collect()} == {(0, "yy"), (1, "zz")}
    many = spark.range(600).selectExpr("id AS doc_id", "concat('word', id % 300, ' text') AS text", "concat('l', id % 300) AS lang")
    assert len({lang for lang, _ in language_id.sampled(many, 400)}) > 250  # those whose rows aren't all held out


def test_language_by_brute_force():
    rng = np.random.default_rng(12)
    net = language_id.Network(["a", "b"], seed=3)
    texts = ["", "12", "ab", "x" * 255, "y" * 256, "öz" * 300, " ".join(rng.choice(["shan", "grön"], 400))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "held_out": [False] * len(texts)})

    class Value:
        value = language_id.Folded(net.classes, net.p)

    got = [r for b in language_id.predict_batches([batch], Value) for r in b.to_pylist()]
    for text, r in zip(texts, got, strict=True):
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data, total = text.encode(), np.zeros(2)
        for at in range(0, len(data), 256):
            w = np.frombuffer(data[at : at + 256].ljust(256, b"\0"), np.uint8)
            e = net.p["embed"][w]
            hidden = []
            for k in language_id.WIDTHS:
                for f in range(language_id.FILTERS):
                    hidden.append(max(0.0, max(sum(e[i + j] @ net.p[f"w{k}"][j][:, f] for j in range(k)) + net.p[f"b{k}"][f] for i in range(256 - k + 1))))
            z = np.array(hidden) @ net.p["out"] + net.p["bias"]
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * np.count_nonzero(w)
        mean = total / len(data)
        assert r["lang_pred"] == "ab"[mean.argmax()] and r["score"] == pytest.approx(mean.max(), abs=1e-3)


def test_folded_network_is_the_network():
    net = language_id.Network(["a", "b", "c"])
    x = np.random.default_rng(2).integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    p, e = net.p, net.p["embed"][x]
    h = [np.maximum((sum(e[:, j : j + x.shape[1] - k + 1] @ p[f"w{k}"][j] for j in range(k)) + p[f"b{k}"]).max(1), 0) for k in language_id.WIDTHS]
    z = np.exp(np.hstack(h) @ p["out"] + p["bias"])
    assert np.allclose(language_id.Folded(net.classes, p).softmax(x), z / z.sum(1, keepdims=True), atol=1e-4)


def water(budget, nodes):
    """Slow filling: children get weight shares until full, again and again."""
    out = dict.fromkeys(nodes, 0.0)
    open_ = {k for k, (cap, w) in nodes.items() if w and cap}
    while budget > 1e-9 and open_:
        w = sum(nodes[k][1] for k in open_)
        step = min(min((nodes[k][0] - out[k]) / nodes[k][1] for k in open_), budget / w)
        for k in open_:
            out[k] += step * nodes[k][1]
        budget -= step * w
        open_ = {k for k in open_ if nodes[k][0] - out[k] > 1e-9}
    return out


def test_mixing(spark):
    texts = [" ".join(["w"] * (i % 7)) for i in range(300)] + [None, " "]
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 8}", 9, i) for i, t in enumerate(texts)]
    table = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, lang string, source string, copies long, tokens int")
    taken = mixing.mix(table, fraction=0.8, max_epochs=2).collect()
    total = sum(len((t or "").split()) for t in [*texts, texts[5], texts[5]])
    got = sum(r["__quire_tokens"] * r["__quire_copies"] for r in taken)
    assert 0.6 * total < got <= 0.8 * total and all(r.text.strip() for r in taken)
    again = mixing.mix(table.repartition(7), fraction=0.8, max_epochs=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, taken))
    assert len({r["__quire_copies"] for r in taken if r.doc_id == 5}) <= 1
    assert mixing.mix(table.limit(0)).count() == 0


def test_a_leaf_of_rows_without_an_id_stands_or_falls_together(spark):
    rows = [(None, "a b c", "en", "src0") for _ in range(40)] + [(i, "a b c", "en", "src1") for i in range(40)]
    taken = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), fraction=0.5, max_epochs=1).collect()
    assert sum(r.doc_id is None for r in taken) in (0, 40) and 0 < len(taken) <= 40


def test_budgets_fill_siblings_first(spark):
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "a", 100), ("d1", "en", "c", 5), ("d2", "en", "a", 500)]
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, supply long"), 0.5, 1, mixing.WEIGHTS).collect()}
    top = water(807, {"d0": (1110, 40), "d1": (5, 30), "d2": (500, 20)})
    mid = water(top["d0"], {"en": (1010, 50), "de": (100, 20)})
    low = water(mid["en"], {"a": (10, 1), "b": (1000, 1)})
    want = {("d0", "en", "a"): low["a"], ("d0", "en", "b"): low["b"], ("d0", "de", "a"): mid["de"], ("d1", "en", "c"): top["d1"], ("d2", "en", "a"): top["d2"]}
    assert all(abs(got[k] - v) <= 3 for k, v in want.items())


def table_of(spark, x, ids=None):
    rows = [(ids[i] if ids else i, v, 1, "z") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")


def vectors(n, d=16):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, d)) * rng.uniform(0.5, 2, (n, 1))
    x[n // 2 :: 3] = x[7]
    return x.astype(np.float32)


BAD = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]


def test_graph_search(spark, monkeypatch):
    x = vectors(900)
    out = graph_search.nearest(table_of(spark, [*x.tolist(), *BAD]))
    found = {}
    for r in out.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = x.astype(float)
    hits = 0
    for q in range(0, 900, 20):
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        hits += len({i for i, _ in found[q]} & set(want.tolist()))
        assert all(abs(s[i] - t) < 1e-9 for i, t in found[q]) and [t for _, t in found[q]] == sorted((t for _, t in found[q]), reverse=True)
    assert hits >= 0.9 * 20 * len(found) and sorted(found) == list(range(0, 900, 20))
    assert graph_search.nearest(table_of(spark, [])).count() == 0
    few = graph_search.nearest(table_of(spark, x[:5].tolist())).collect()
    assert len(few) == 4


def test_cover_tree(spark):
    x = vectors(700)
    out = cover_tree.exact_topk(table_of(spark, [*x.tolist(), *BAD]))
    found = {}
    for r in out.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    every = [*range(700), 701]
    v = np.floor(256 * np.vstack([x.astype(float), np.zeros((1, 16))]))
    for q in range(0, 700, 50):
        s = (v @ v[q]).astype(int)
        order = sorted((-s[k], i) for k, i in enumerate(every) if i != q)[:5]
        assert found[q] == [(i, -t) for t, i in order]
    assert sorted(found) == list(range(0, 700, 50))
    assert cover_tree.exact_topk(table_of(spark, [])).count() == 0


def test_cover_tree_keeps_its_rules():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (900, 3)), rng.normal(0, 0.01, (400, 3)), rng.normal(0, 1, (1, 3)) * 1e4])
    x = np.unique(np.floor(256 * x), axis=0)
    tree = cover_tree.Tree(x)
    seen, split = np.zeros(len(x), int), 0
    for at in range(len(tree.centre)):
        points = tree.perm[tree.low[at] : tree.high[at]]
        reach = np.linalg.norm(x[points] - x[tree.centre[at]], axis=1)
        assert reach.max() <= tree.radius[at] * (1 + 1e-12) and (tree.radius[at] == 0 or tree.radius[at] <= cover_tree.BASE ** tree.level[at] * (1 + 1e-12))
        assert tree.centre[at] in points
        if not tree.children[at]:
            seen[points] += 1
            continue
        split += 1
        children = np.arange(tree.child[at], tree.child[at] + tree.children[at])
        level = set(tree.level[children].tolist())
        assert len(level) == 1 and (apart := level.pop()) < tree.level[at] and tree.centre[at] in tree.centre[children]
        c = x[tree.centre[children]]
        gaps = np.linalg.norm(c[:, None] - c[None], axis=2)[np.triu_indices(len(c), 1)]
        assert (gaps > cover_tree.BASE**apart).all() and (tree.radius[children] <= cover_tree.BASE**apart * (1 + 1e-12)).all()
        assert sorted(tree.perm[tree.low[at] : tree.high[at]]) == sorted(np.concatenate([tree.perm[tree.low[k] : tree.high[k]] for k in children]))
    assert (seen == 1).all() and split > 10


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(9)
    for size in (1e6, 1e9, 1e200):
        x = rng.normal(0, size, (130, 16)) if size < 1e100 else rng.normal(0, 1, (130, 16)) * 10.0 ** rng.integers(-3, 200, (130, 1))
        x[5] = x[100]
        x[6, 3] = x[100, 3]
        table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cover_tree.exact_topk(table).collect()}
        v = [[int(c) for c in np.floor(256 * row)] for row in x]
        for q in range(0, 130, 50):
            score = [max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v[q], w, strict=True)))) for w in v]
            want = sorted((-s, i) for i, s in enumerate(score) if i != q)[:5]
            assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in want]


def recall(x, queries):
    ids = np.arange(len(x))
    q, found, score = graph_search.answer(graph_search.build(ids, x), queries, x[queries])
    s = x[queries] @ x.T
    hits = 0
    for row, i in zip(s, queries.tolist(), strict=True):
        row[i] = -np.inf
        mine = [j for a, j in zip(q, found, strict=True) if a == i]
        assert len(set(mine)) == 20 and mine == [j for _, j in sorted((-float(np.einsum("i,i->", x[i], x[j])), j) for j in mine)]
        hits += len(set(mine) & set(np.argsort(-row, kind="stable")[:20].tolist()))
    return hits / 20 / len(queries)


@pytest.mark.parametrize("kind", ["gauss", "lognormal", "outlier", "clusters", "unit", "few lengths"])
def test_graph_search_recall_on_any_lengths(kind):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2500, 32))
    if kind == "lognormal":
        x *= np.exp(rng.normal(0, 0.5, (len(x), 1)))
    if kind == "outlier":
        x[7] *= 10_000
    if kind == "clusters":
        x = rng.normal(size=(20, 32))[rng.integers(0, 20, len(x))] + 0.3 * x
    if kind in ("unit", "few lengths"):
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "few lengths":
        x *= rng.choice([1e-3, 1.0, 1.1, 50.0], (len(x), 1))
    assert recall(x, np.arange(0, 2500, 40)) >= 0.9


def test_graph_search_over_several_shards(spark, monkeypatch):
    from quire.llm import vectors

    monkeypatch.setattr(vectors, "SHARD", 300)
    monkeypatch.setattr(vectors, "BLOCK", 10)
    monkeypatch.setattr(vectors, "BLOCKS", 2)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 16)) * np.exp(rng.normal(0, 0.4, (1200, 1)))
    got = {}
    for r in graph_search.nearest(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hits = 0
    for q in range(0, 1200, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(got[q].values()) & set(np.argsort(-s)[:20].tolist()))
        assert sorted(got[q]) == list(range(1, 21))
    assert hits >= 0.9 * 20 * 60


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    plain = "some calm words about rivers and stones under trees with birds".split()
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 60))
        if i % 3 == 0:
            for at in (5, 20, 40):
                words[at] = rng.choice(["dumbfool", "dumb.fool", "dumxbfool"])
        rows.append((i, " ".join(words), "en", 1.0))
        labels.append((i, int(i % 3 == 0)))
    rows += [(900, None, "en", 0.0), (901, "", "en", 0.0), (902, "d u m b f o o l " * 4 + " ".join(plain), "en", 0.0), (None, "calm", "en", 0.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1), (5, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(table, marks).collect()}
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert out[902].predicted == 1 and out[900].predicted == out[901].predicted == 0
    kept = toxicity.drop_toxic(table, marks)
    assert kept.columns == table.columns and kept.where("doc_id = 902").count() == 0
    assert toxicity.toxicity(table.limit(0), marks).count() == 0
    assert toxicity.toxicity(table, marks.limit(0)).where("predicted = 1").count() == 0


def test_kernel_by_brute_force():
    def slow(a, b):
        total = 0.0
        for x in itertools.combinations(range(len(a)), 3):
            for y in itertools.combinations(range(len(b)), 3):
                if x[2] - x[0] < toxicity.SPAN and y[2] - y[0] < toxicity.SPAN and [a[i] for i in x] == [b[i] for i in y]:
                    total += toxicity.DECAY ** (x[2] - x[0] + 1 + y[2] - y[0] + 1)
        return total

    def size(n):
        return sum(toxicity.DECAY ** (2 * (x[2] - x[0] + 1)) for x in itertools.combinations(range(n), 3) if x[2] - x[0] < toxicity.SPAN) ** 0.5 or 1.0

    marks, words = ["^fool$", "^dumbf", "^xyz$"], ["^fool$", "^foxol$", "^dumb$", "^dumbfool$", "^ab$", "^zzzz$"]
    got = toxicity.Landmarks(marks).kernel(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx((slow(w, m) / size(len(w)) / size(len(m))) ** toxicity.SHARPEN, rel=1e-4, abs=1e-7)


def test_svm_and_calibration_are_optimal():
    rng = np.random.default_rng(17)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] + 0.5 * rng.normal(size=120) > 0).astype(int)
    c = np.where(y == 1, 0.7, 0.4)
    loss = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - np.where(y == 1, 1, -1) * (x @ w[:-1] + w[-1]))).sum()
    w = toxicity.train_svm(x, y, c, rounds=2000)
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in rng.normal(0, 0.05, (300, 5)))
    f = x @ w[:-1] + w[-1]
    a, b = toxicity.platt(f, y)
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    cross = lambda a, b: (np.logaddexp(0, a * f + b) - target * (a * f + b)).sum()
    assert all(cross(a, b) <= cross(a + d, b + e) + 1e-6 for d, e in rng.normal(0, 0.05, (300, 2)))


def test_scores_do_not_depend_on_the_cache(monkeypatch):
    plain = "some calm words about rivers and stones under trees".split()
    rng = np.random.default_rng(18)
    texts = [" ".join([*rng.choice(plain, 30), *(["dumbfool"] * 3 if i % 3 == 0 else [])]) for i in range(90)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(90)])
    long_ = "dumbfool" * 20_000
    some = [*texts, long_, long_ + " " + texts[1], ""]
    want = toxicity.Scorer(model).scores(some)
    monkeypatch.setattr(toxicity, "CACHE", 5)
    small = toxicity.Scorer(model)
    assert [s for t in some for s in small.scores([t])] == pytest.approx(want) and all(len(w) <= toxicity.LONG for w in small.known)


def test_toxicity_learns_once_from_repeated_rows(spark):
    rows = [(i, f"calm words number {i} about rivers", "x") for i in range(60)] + [(200 + i, f"dumbfool words number {i} about rivers", "x") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _, _ in rows], "doc_id long, toxic int")
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    twice = table.unionByName(table).unionByName(table.where("doc_id = 3"))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(t, labels).collect()} for t in (table, twice))
    assert one == pytest.approx(two) and toxicity.toxicity(twice, labels).count() == 241


def test_least_keeps_the_sample(spark):
    frame = spark.range(20_000)
    taken = lambda f: [r.id for r in f.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    few = frame.where(least(F.xxhash64("id"), 50, 20_000))
    assert taken(few) == taken(frame) and 100 < few.count() < 400
    assert frame.where(least(F.xxhash64("id"), 50, 200)).count() == 20_000
    assert frame.where(least(F.xxhash64("id"), 1, 0)).count() == 20_000
    assert spark.range(1).where(least(F.lit(-(1 << 63)), 400, 10**13)).count() == 1


def test_token_counts(spark):
    lib = vocabulary().processor
    texts = [*EDGE, "<s> </s> <unk> <0x0A>", "a" + " " * 40 + "b"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096)
    assert token_counts.token_counts(docs(spark, [])).count() == 0


def brute_best(v, word):
    """The best total of scores over all cuts of a short word, tried one by one."""
    score = {v.pieces[i]: v.scores[i] for i in v.ids}
    least = min(score.values()) - 10
    best = -np.inf
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(edges)]
        if all(p in score or len(p) == 1 for p in parts):
            best = max(best, sum(score.get(p, least) for p in parts))
    return best


def test_viterbi_is_best():
    v, codec = vocabulary(), sentencepieces.Codec(MODEL)
    score = {i: v.scores[i] for i in v.ids}
    for word in ("the", "unbelievable", "zurück", "straße", "a,b.c", "hello", "qqqq"):
        ids = np.frombuffer(codec.encode([word])[0], "<i4")
        assert sum(score[i] for i in ids.tolist()) == pytest.approx(brute_best(v, SPACE + word))


def test_null_ids_and_repeated_rows_of_token_operators(spark):
    table = docs(spark, [PROSE, PROSE, "x y", None], ids=[None, 3, 3, 3])
    n = len(vocabulary().processor.encode(PROSE))
    want = sorted([(repr(None), n), (repr(3), n), (repr(3), len(vocabulary().processor.encode("x y"))), (repr(3), 0)])
    assert sorted((repr(r.doc_id), r.n_tokens) for r in token_counts.token_counts(table).collect()) == want
    assert sorted((repr(r.doc_id), r.n_pieces) for r in sentencepieces.encode_digests(table).collect()) == want


def test_sentencepieces(spark):
    table = docs(spark, EDGE)
    out = {r.doc_id: r for r in sentencepieces.encode_digests(table).collect()}
    assert all(r.round_trip for r in out.values()) and out[0].n_pieces == out[1].n_pieces == 0
    back = sentencepieces.decode(sentencepieces.encode(table).drop("text"))
    assert {r.doc_id: r.text for r in back.collect()} == {i: (t or "").replace(SPACE, " ") for i, t in enumerate(EDGE)}
    assert sentencepieces.encode(docs(spark, [])).count() == 0


def test_sentencepieces_are_the_librarys(spark):
    lib = vocabulary().processor
    texts = [*EDGE, "les Elle est là", "unbelievable zurück straße a,b.c", "a ", " ", "a" + " " * 40 + "b", "<s> </s> <0x0A>"]
    got = {r.doc_id: r.piece_ids for r in sentencepieces.encode(docs(spark, texts)).collect()}
    assert got == {i: lib.encode(t or "") for i, t in enumerate(texts)}


def test_merges_leave_the_librarys_neighbours_apart():
    v, rng = vocabulary(), np.random.default_rng(15)
    encoder = sentencepieces.codec().encoder
    bare = [i for i in v.ids.tolist() if not v.pieces[i].startswith(SPACE)]
    left = rng.choice([i for i in v.ids.tolist() if v.pieces[i].startswith(SPACE) and len(v.pieces[i].strip(SPACE))], 4000)
    right = rng.choice(bare, 4000)
    want = [v.processor.encode(v.pieces[a][1:] + v.pieces[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist(), strict=True) if v.pieces[a].count(SPACE) == 1]
    one = np.array([v.pieces[a].count(SPACE) == 1 for a in left.tolist()])
    assert encoder.decide(left[one], right[one]).tolist() == want and 0 < sum(want) < len(want)
    assert encoder.apart(left, right).tolist() == encoder.decide(left, right).tolist() == encoder.apart(left, right).tolist()


def test_words_of_any_pieces_are_the_librarys():
    v, rng = vocabulary(), np.random.default_rng(16)
    pieces = [v.pieces[i].replace(SPACE, " ") for i in v.ids.tolist()]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 4))) for _ in range(8000)]
    texts += ["".join(rng.choice(list("abcdeéß中文😀\u2028  ▁"), rng.integers(1, 12))) for _ in range(4000)]
    texts += ["a" * k for k in range(1, 60)] + ["ab" * k for k in range(1, 40)] + [" " * k for k in range(1, 40)]
    got = sentencepieces.codec().encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == v.processor.encode(texts, num_threads=1)


def test_model_type():
    assert vocabulary().is_bpe
    assert [model_type(x) for x in (b"", b"\x12\x02\x18\x01", b"\x12\x02\x18\x02", b"\x0a\x02\x18\x02")] == [1, 1, 2, 1]


def brute_base(text):
    out = []
    for m in re.finditer(secrets.ASSIGN, text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secrets(spark):
    key = "AKIA" + "Q" * 16
    weak = "Zx9" * 11
    texts = [*EDGE, f"id {key} token=abc é😀 PassWord: 'hunter22' {'0af' * 9}", "token: token: abcdefgh", f"client_id = bob1 {weak} http://h.example/x", f"{weak} far", f"client_id = bob1{' ' * 600}{weak}", f"x {key} https://api.example.com secret=zzzzzzz" * 3]
    got = {r.doc_id: r for r in secrets.secret_scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        digest = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert {x for x in digest.split(",") if x} <= set(r.spans.split(","))
    n = len(EDGE)
    kinds = lambda i: [x.split(":")[0] for x in got[i].spans.split(",") if x]
    assert kinds(n + 2) == ["weak_id", "weak_secret", "endpoint"]
    assert kinds(n + 3) == [] and kinds(n + 4) == []
    assert kinds(n + 5).count("endpoint") == 3
    clean = {r.doc_id: r for r in secrets.redact(docs(spark, texts)).collect()}
    assert key not in clean[n].text and clean[n].n_chars == len(clean[n].text) and clean[0].text is None and clean[5].text == PROSE
    assert secrets.secret_scan(docs(spark, [])).count() == 0


def test_secrets_of_many_matches(spark, monkeypatch):
    key = "AKIA" + "Q" * 16
    text = "".join(f"é😀 token={'abc' * 3}{i} {key}{'0af' * 9} client_id=bob{i} http://h.example/x " for i in range(1500))
    table = docs(spark, [text, "x " * 3000 + f"client_id = bob1 {'Zx9' * 11}", text, "clean", None], ids=[1, 2, None, 4, 5])
    got = {r.doc_id: r for r in secrets.secret_scan(table).collect()}
    base = brute_base(text)
    assert got[1].n_assign == 1500 and got[1].n_access == 1500 and got[1].n_hex == sum(k == 2 for _, k, _ in base)
    assert got[1].base_sha256 == got[None].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    for most in (secrets.BROADCAST_ROWS, 0):
        monkeypatch.setattr(secrets, "BROADCAST_ROWS", most)
        clean = {r.doc_id: r for r in secrets.redact(table).collect()}
        for i, t in ((1, text), (None, text), (2, table.where("doc_id = 2").first().text)):
            out, at = "", 0
            for x in sorted((tuple(map(int, y.split(":")[1:])) for y in got[i].spans.split(","))):
                if x[0] >= at:
                    out += t[at : x[0]] + "[secret]"
                at = max(at, x[1])
            assert clean[i].text == out + t[at:] and clean[i].n_chars == len(clean[i].text)
        assert clean[4].text == "clean" and clean[5].text is None


def test_sentencepieces_take_the_one_way_without_search_or_maximum(monkeypatch):
    encoder = sentencepieces.Merges(MODEL)
    of = [" the", " seventeen", " unbelievable", " naïve", " 日本語x", "  two", " \U0001f600a", " zzzzqqqxw", " internationalisation"]
    plain = {}
    for w in of:
        chars = sentencepieces.code_points(w.replace(" ", SPACE)).reshape(1, -1)
        plain[w] = sentencepieces.Encoder.equal_lengths(encoder, chars)[0]
    encoder.words(of)  # the pairs' answers are known from here on
    monkeypatch.setattr(np, "searchsorted", None)
    monkeypatch.setattr(sentencepieces.Merges, "gains", None)
    assert encoder.words(of) == plain


def test_components(spark):
    from quire.llm.components import components

    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, int(x)) for x in rng.integers(200, 400, 80)] + [(1, 1), (None, 3)]
    got = {r.v: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(v == 7 for k, v in got.items() if k >= 200)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_worker_keeps_the_caches_of_one_operator_alone(spark):
    class Sent:
        value = toxicity.fit([], [])

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array(["some words"])})
    list(toxicity.score_batches([batch], Sent, True))
    assert toxicity._OF_WORKER
    first = list(sentencepieces.encode_batches([batch], MODEL))
    assert not toxicity._OF_WORKER and sentencepieces.codec.cache_info().currsize == 1
    list(toxicity.score_batches([batch], Sent, True))
    assert toxicity._OF_WORKER and not sentencepieces.codec.cache_info().currsize and not vocabulary.cache_info().currsize
    assert list(sentencepieces.encode_batches([batch], MODEL)) == first


def test_batches_for_kernels_are_bounded_by_bytes(spark):
    toxicity.toxicity(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    wide = spark.range(0, 8000, 1, 1).selectExpr("id", "repeat('abcdefgh', 500) AS text")
    sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]}) for b in batches), "n long, bytes long").collect()
    assert sum(x.n for x in sizes) == 8000 and max(x.bytes for x in sizes) < 5 << 20


def test_toxicity_trains_without_workers_for_rows_of_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of document {i} " * 9 + "awful " * (i % 2)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    before = toxicity.train(docs, labels)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert toxicity.train(docs, labels).key() == before.key() and len(before.landmarks) > 1


def test_toxicity_chooses_landmarks_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    every = [f"{i:04d}words" for i in range(1500)]
    counts = [toxicity.Counter(rng.choice(every, 150, replace=False).tolist()) for _ in range(600)]
    tracemalloc.start()
    toxicity.choose(counts, np.arange(600) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    vocabulary_ = "calm words about rivers and stones under trees with birds flying over green hills".split()
    rows = []
    for i in range(120):
        words = list(rng.choice(vocabulary_, 40))
        if i % 4 == 0:
            words[3:6] = ["dumbfool"] * 3
        rows.append((i, " ".join(words), "en", f"src{i % 5}", 0))
    rows += [(200, rows[1][1], "en", "src1", 0), (201, None, None, None, None), (202, "token = abcdef123456 " + rows[2][1], "en", "src2", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(120)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*table.columns, "piece_ids"]
    got = {r.doc_id: r for r in out.collect()}
    assert 200 not in got and not any("abcdef123456" in r.text for r in got.values())
    assert not any(i % 4 == 0 for i in got if i < 120) and len(got) > 40
    docs_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.columns == table.columns
