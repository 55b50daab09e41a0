"""Every query against its DuckDB twin at the smallest scale, and kernels against hand-made cases."""

import math
import os
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire import catalog
from quire.functions.solver import update, weights
from quire.functions.content import fixed, lexemes, shorten_lines, strict_shorten, truncate_cm, value_of
from quire.functions.vector import chunk, merge_lines, optimise_stream, shorter
from quire.operators.grid import component_boxes, merge_cells
from quire.operators.images import png_bits, unsharp

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixtures here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize(
    ("token", "digits", "want"),
    [("3.14159", 3, "3.14"), ("0.50000", 3, ".5"), ("-0.2500", 2, "-.25"), ("123456", 3, "123000"), ("123.456", 2, "120"), ("-155.5", 2, "-160"), ("0.125", 2, ".12"), ("12", 4, "12"), ("-0.0", 3, "0"), ("x", 3, "x"), ("1.0", 2, "1")],
)
def test_shorter(token, digits, want):
    assert shorter(token, digits) == (want if len(want) < len(token) else token)


@given(st.floats(-1e9, 1e9).map(repr), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_shorter_never_grows(token, digits):
    assert len(shorter(token, digits)) <= len(token)


def test_truncate_cm():
    assert truncate_cm("q 1 0 0 1 12.3456 -0.5001 cm Q") == ("q 1 0 0 1 12.35 -.5 cm Q", 1)
    assert truncate_cm("1 0 0 2 12.3456 1 cm") == ("1 0 0 2 12.3456 1 cm", 0)


def slow_lexemes(text):
    """Character by character: (is it in a string, hex string, name or comment?) for each."""
    shut, depth, mode, escaped = [], 0, "", False
    for i, c in enumerate(text):
        if mode == "comment" and c in "\r\n":
            mode = ""
        if mode == "name" and c in " \t\r\n\f\v[]{}()<>/%":
            mode = ""
        if mode == "string":
            shut.append(True)
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            else:
                depth += {"(": 1, ")": -1}.get(c, 0)
                mode = "string" if depth else ""
            continue
        if mode == "hex":
            shut.append(True)
            mode = "" if c == ">" else mode
            continue
        if mode == "dict":
            shut.append(False)
            mode = ""
            continue
        if not mode:
            if c == "(":
                mode, depth = "string", 1
            elif c == "<":
                mode = "dict" if text[i + 1 : i + 2] == "<" else "hex"
            elif c == "/":
                mode = "name"
            elif c == "%":
                mode = "comment"
        shut.append(mode in ("string", "hex", "name", "comment"))
    return shut


@given(st.lists(st.sampled_from(["1.50000", "2", "-.25", "1e-3", "m", "l", "w", "(", ")", "\\", "<", ">", "<<", ">>", "/N1.5", "%", "\n", " ", " ", "[", "]", "Tj"]), max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_lexemes_by_character(text):
    found = list(lexemes(text))
    assert "".join(x.text for x in found) == text
    shut = [x.kind in ("string", "hex", "name", "comment") for x in found for _ in x.text]
    assert shut == slow_lexemes(text)


def test_strings_comments_and_names_stay():
    text = "(total 1.00000 2.00000 l \\) (x) 3.00000 w) Tj <4.00000 w> % 5.00000 w\n/N6.00000 w 7.00000 w"
    want = text.replace("7.00000 w", "7 w")
    assert strict_shorten(text) == optimise_stream(text, 3, True) == optimise_stream(text, 3, False) == want
    assert strict_shorten("1.50000 % c\n2.25000 m [1.0e2 3.000] l +.50 w 1.2.3 w") == "1.5 % c\n2.25 m [100 3] l .5 w 1.2.3 w"
    assert shorten_lines("1.50000 2.25000 m\n1.0 2.0 3.0 4.000 v 9.000 w") == "1.5 2.25 m\n1 2 3 4 v 9 w"
    assert [fixed(t, 2) for t in ("-0.50", "0.001", "-0.001", "12", "1e2")] == ["-.5", "0", "0", "12", "100"]
    assert [value_of(t) for t in ("1.5", "", "x", "1" * 130, "-2e1")] == [1.5, 0.0, 0.0, 0.0, -20.0]
    assert truncate_cm("1.0 0 0 1 .125 -0.001 cm (1 0 0 1 5.5555 5.5555 cm) Tj") == ("1.0 0 0 1 .12 0 cm (1 0 0 1 5.5555 5.5555 cm) Tj", 1)


def test_merge_lines():
    straight = [(float(i), 0.0) for i in range(6)]
    assert merge_lines(straight) == [5]
    assert merge_lines([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (1.0, 2.0)]) == [1, 3]
    assert merge_lines([]) == []


def test_optimise_stream():
    assert optimise_stream("0 0 m\n1.00000 0 l\n2.00000 0 l\n", 3, True) == "0 0 m\n2 0 l\n"
    assert optimise_stream("0 0 m\n1.00000 0 l\n2.00000 0 l\n", 3, False) == "0 0 m\n1 0 l\n2 0 l\n"
    assert optimise_stream("0 0 m 1 0.001 2 -0.001 3 0 c", 3, True) == "0 0 m 3 0 l"
    assert optimise_stream("0 0 m 1 5 2 5 3 0 c", 3, True) == "0 0 m 1 5 2 5 3 0 c"


@given(st.lists(st.sampled_from(["abc def\n", "x" * 50 + "\n", "longer line here\n", "no end"]), max_size=30))
@settings(max_examples=50, deadline=None)
def test_chunk_keeps_bytes(parts):
    data = "".join(parts).encode()
    got = chunk(data, 40, 32)
    assert b"".join(got) == data
    assert all(len(c) <= 32 or c.count(b"\n") <= 1 for c in got) or len(data) <= 40


@pytest.mark.parametrize("kind", ["data", "noise"])
@pytest.mark.parametrize("variant", ["dpmsolver", "taylor"])
@pytest.mark.parametrize("order", [2, 3])
def test_solver_order(kind, variant, order):
    """Against many small steps: where steps are small, half the step leaves about 1 / 2 ** (order + 1) of the error."""
    f = lambda x: x / (abs(x) + 1)

    def error(h, many=4000):
        x = 0.7
        for i in range(many):
            x = update(x, weights(kind, "dpmsolver", 2, -1.0 + i * h / many, h / many), f)
        return abs(update(0.7, weights(kind, variant, order, -1.0, h), f) - x)

    assert error(0.1) < error(0.2) / (0.85 * 2 ** (order + 1))


def test_unsharp():
    flat = [100] * 64
    assert unsharp(flat, 0.3) == flat
    edge = [0] * 32 + [200] * 32
    out = unsharp(edge, 0.3)
    assert out[24] == 0 and out[32] > 200 and len(set(out[32:40])) == 1


@given(st.integers(1, 20), st.integers(1, 9), st.integers(0, 2**32))
@settings(max_examples=30, deadline=None)
def test_png_keeps_bits(width, height, seed):
    bits = np.random.default_rng(seed).integers(0, 2, (height, width)).astype(bool)
    data = png_bits(bits)
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, header = 8, b"", b""
    while at < len(data):
        n, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(name + part)
        body, header, at = body + (part if name == b"IDAT" else b""), part if name == b"IHDR" else header, at + 12 + n
    assert (int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big"), header[8]) == (width, height, 1)
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, -1)
    assert not rows[:, 0].any() and (np.unpackbits(rows[:, 1:], axis=1)[:, :width] == bits).all()


def test_merge_cells():
    m = np.array([["A", "A", None], ["A", "A", "B"], ["C", "A", "B"]], object)
    assert merge_cells(m) == [(0, 0, 2, 2, "A"), (1, 2, 3, 3, "B"), (2, 0, 3, 1, "C"), (2, 1, 3, 2, "A")]


def test_component_boxes():
    m = np.zeros((5, 5), bool)
    m[0, 0] = m[1, 1] = m[4, 3:5] = True
    assert sorted(component_boxes(m)) == [(0, 0, 2, 2), (3, 4, 2, 1)]


def test_stream_equals_batch(spark, tmp_path):
    from quire.streaming.pages import complete_pages, run_to_end

    rows = [(1, 0, 2), (2, 0, 3), (1, 1, 2), (2, 1, 3), (3, 0, 1), (1, 1, 2)]
    spark.createDataFrame(rows, "page long, patch long, total long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page long, patch long, total long").parquet(str(tmp_path / "in"))
    out = complete_pages(stream)
    assert sorted(map(tuple, run_to_end(out, str(tmp_path / "out")).collect())) == [(1, 2), (3, 1)]
    spark.createDataFrame([(3, 0, 1), (2, 2, 3), (1, 0, 2)], "page long, patch long, total long").write.mode("append").parquet(str(tmp_path / "in"))
    again = complete_pages(spark.readStream.schema("page long, patch long, total long").parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, run_to_end(again, str(tmp_path / "out")).collect())) == [(1, 2), (2, 3), (3, 1)]


def test_quantiles_are_exact(spark):
    from quire.operators.profile import quantiles

    rng = np.random.default_rng(0)
    values = {"a": rng.normal(size=301), "b": np.concatenate([np.full(200, 3.0), rng.normal(size=100)]), "c": np.array([7.0]), "d": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("e", None)]
    got = {r.k: (r.p, r.q) for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p": 0.02, "q": 0.7}, buckets=16).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    for k, x in values.items():
        assert got[k] == pytest.approx((np.quantile(x, 0.02), np.quantile(x, 0.7)))


def test_running_sums(spark):
    from quire.streaming.pages import running_sums

    rows = [(i, (i * 7) % 5) for i in range(200)]
    got = running_sums(spark.createDataFrame(rows, "page long, n long"), [F.desc("n"), F.col("page")], "n", "before").collect()
    before = 0
    for r in sorted(got, key=lambda r: (-r.n, r.page)):
        assert r.before == before
        before += r.n
    assert len(got) == 200


def test_network_batches():
    from quire.operators.networks import BATCH, session

    s = session("double", ("CPU", "CUDA"))
    assert s.provider == "CUDA" and s is session("double", ("CPU", "CUDA"))
    for n in (0, 1, BATCH, BATCH + 1):
        x = np.arange(n * 4.0).reshape(n, 2, 2)
        assert len(s.run(x)) == n and (n == 0 or (s.run(x)[:, ::2, ::2] == x).all())


def test_write_back_leaves_what_has_no_result(spark):
    from quire.sources.snapshots import target, write_back

    attrs = {"/DecodeParms": "x", "/Width": "3"}
    objects = spark.createDataFrame([(1, "/DCTDecode", 10, attrs), (2, "/DCTDecode", 10, attrs)], "xref long, filter string, length long, attrs map<string,string>")
    results = spark.createDataFrame([(2, "JP2", 4)], "xref long, mode string, new_length long")
    got = {r.xref: (r.filter, r.length, r.attrs) for r in write_back(objects, results).collect()}
    assert got == {1: ("/DCTDecode", 10, attrs), 2: ("/JPXDecode", 4, {"/Width": "3"})}
    names = spark.createDataFrame([("a/b.c/d.pdf", "lossy"), ("a/b.c/d", "lossy"), ("d.pdf", "lossless")], "path string, phase string")
    assert [r[0] for r in names.select(target(F.col("path"), F.col("phase"))).collect()] == ["a/b.c/d_opted.pdf", "a/b.c/d_opted", "d.pdf"]


def test_progress_is_throttled():
    from quire.streaming.pages import Progress

    shown, times = [], iter([0.0, 0.1, 0.15, 0.25, 0.3])
    p = Progress(lambda q, n: shown.append((q, n)), 0.2, lambda: next(times))
    for n in (5, 5, 5, 5):
        p.add("q", n)
    p.add("q", 0, end=True)
    assert shown == [("q", 5), ("q", 20), ("q", 20)]


def test_control_plane(spark):
    from quire.plans import control

    ticks = iter(range(1000))
    cost = {1: 9, 2: 10, 4: 12, 8: 40}
    now = [0.0]

    def run(batch):
        now[0] += cost[batch]

    probes = control.probe_batches(run, 8, (1, 2, 4, 8, 16), 60, lambda: now[0])
    assert [p.batch for p in probes] == [1, 2, 4, 8] and control.best_batch(probes) == 4
    assert [p.batch for p in control.probe_batches(run, 8, (1, 2, 4, 8), 15, lambda: now[0])] == [1, 2]
    assert control.probe_batches(run, 0) == [] and control.best_batch([]) == 8 and control.best_batch([], "gpu") == 32
    assert [control.should_probe(n) for n in (20, 21)] == [False, True] and next(ticks) == 0
    assert [control.provider(x) for x in (["CPU", "CUDA"], ["DirectML", "CPU"], [])] == ["CUDA", "DirectML", "CPU"]
    assert [control.gray_mode(*x) for x in ((None, True), ("model", True), ("model", False), ("odd", True), ("plain", False))] == ["none", "model", "classic", "none", "plain"]
    assert control.capable(["a", "b"], ["b"]) == (False, ["a"])

    def end():
        raise EOFError

    assert [control.unattended(5, None), control.unattended(6, lambda: "n"), control.unattended(6, lambda: ""), control.unattended(6, end)] == [False, False, True, True]
    measure = lambda df: df.agg(F.sum("size")).first()[0]
    start = spark.createDataFrame([(1, 50_000), (2, 50_000)], "k int, size long")
    shrink = lambda share: lambda df: df.withColumn("size", F.floor(F.col("size") * share).cast("long"))
    kinds = []
    for limit in (100_000, 90_000, 60_000, 20_000):
        kept, outcome = control.Ladder(shrink(0.9), [("a", shrink(0.9)), ("worse", shrink(1.1)), ("b", shrink(0.7))], measure, limit).run(start)
        kinds.append(outcome.kind)
        assert measure(kept) == outcome.size
    assert kinds == ["small at first", "small after lossless", "lossy", "still large"]


def test_rollback_leaves_no_page_worse(spark):
    from quire.operators.guards import payload, rollback_to_fixpoint, worse_pages

    prev = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12)], "page long, xref long")
    cand = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 99)], "page long, xref long")
    sizes = spark.createDataFrame([(10, 5), (11, 7), (12, 1)], "xref long, size long")
    pages = spark.createDataFrame([(1,), (2,), (3,), (4,)], "page long")
    images, flagged = rollback_to_fixpoint(prev, cand, sizes, pages)
    assert worse_pages(payload(prev, sizes, pages), payload(images, sizes, pages)).isEmpty()
    assert [r.page for r in flagged.collect()] == [2]


def test_entry_without_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'page_payload' in e.queries(); assert not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
