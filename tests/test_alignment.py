"""Alignments against the table of lengths; boxes, reflow and renderings on small pages."""

import random
import time

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from test_documents import longest

from scrivano.functions import lcs
from scrivano.operators import alignment, layout

SCHEMA = "case int, ord int, text string"


def check(x, y, pairs, whole=True):
    assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    if whole:
        assert len(pairs) == longest(x, y)


@pytest.mark.parametrize("bits", [1 << 26, 200, 10, 1])
def test_matched(monkeypatch, bits):
    """Also where the table is halved again and again."""
    monkeypatch.setattr(lcs, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(200):
        k = rng.choice([2, 3, 8, 40])
        x, y = ([rng.randrange(k) for _ in range(rng.randrange(40))] for _ in range(2))
        check(x, y, lcs.matched(x, y))


def test_rising():
    rng = random.Random(4)
    for _ in range(200):
        v = [rng.randrange(20) for _ in range(rng.randrange(30))]
        got = lcs.rising(v)
        assert all(a < b and v[a] < v[b] for a, b in zip(got, got[1:])) and len(got) == longest(v, sorted(set(v)))


def sides(spark, cases):
    of = lambda k: spark.createDataFrame([(c, i, w) for c, both in cases.items() for i, w in enumerate(both[k])] or [], SCHEMA)
    return of(0), of(1)


def aligned(spark, cases, **more):
    got = {c: [] for c in cases}
    for r in alignment.pairs(*sides(spark, cases), DataFrame.cache, **more).collect():
        got[r.case].append((r.a, r.b))
    return {c: sorted(p) for c, p in got.items()}


def test_pairs_of_short_cases(spark):
    rng = random.Random(5)
    cases = {c: [[f"w{rng.randrange(6)}" for _ in range(rng.randrange(30))] for _ in range(2)] for c in range(30)}
    cases |= {50: (["a", None, "b"], ["a", None, "b"]), 51: (["a"], []), 52: ([], ["a"])}
    got = aligned(spark, cases)
    assert got[50] == [(0, 0), (2, 2)]
    for c, (x, y) in cases.items():
        if c != 50:
            check(x, y, got[c])


def test_pairs_by_anchors(spark):
    """Words that stand once cut the rest into gaps; in them the alignment is exact."""
    rng = random.Random(6)
    cases = {}
    for c in range(12):
        x = [f"u{i}" if rng.random() < 0.2 else f"w{rng.randrange(9)}" for i in range(300)]
        y = [w for w in x if rng.random() > 0.1]
        for _ in range(20):
            y.insert(rng.randrange(len(y)), f"n{rng.randrange(5)}")
        cases[c] = x, y
    cases[20] = (["r"] * 60 + ["u"], ["u"] + ["r"] * 60)  # the one anchor stands across what repeats
    cases[21] = ([f"w{i % 7}" for i in range(200)], [f"w{i % 5}" for i in range(200)])  # no anchor at all
    got = aligned(spark, cases, short=10)
    for c, (x, y) in cases.items():
        check(x, y, got[c], whole=c == 21)
        assert c == 20 or len(got[c]) >= 0.97 * longest(x, y)
    once = {c: [x.index(w) for w in set(x) if x.count(w) == y.count(w) == 1] for c, (x, y) in cases.items()}
    for c in range(12):  # what is in order on both sides all counts
        assert set(once[c]) <= {a for a, _ in got[c]}


def test_a_long_case(spark):
    rng = random.Random(7)
    x = [f"u{i}" if rng.random() < 0.05 else f"w{rng.randrange(400)}" for i in range(100_000)]
    y = [w for w in x if rng.random() > 0.02]
    before, after = sides(spark, {1: (x, y)})
    before, after = before.cache(), after.cache()
    before.count(), after.count()
    began = time.time()
    n = alignment.pairs(before, after, DataFrame.cache).count()
    assert time.time() - began < 60 and n >= 0.999 * len(y)


def test_moved_words(spark):
    cases = {1: (["a", "b", "c", "d", "e", "x", "x"], ["e", "a", "b", "c", "d", "y"])}
    before, after = sides(spark, cases)
    pairs = alignment.pairs(before, after, DataFrame.cache)
    off = alignment.sides(before, after, pairs, ("text",)).where("a IS NULL OR b IS NULL")
    assert {(r.a and r.a.text, r.b and r.b.text) for r in off.collect()} == {("e", None), ("x", None), (None, "e"), (None, "y")}
    assert [tuple(r) for r in alignment.moved(off).collect()] == [(1, 4, 0)]


BOX = "case string, page int, kind string, x0 double, top double, x1 double, bottom double"


def test_boxes(spark):
    """Each code alone, halves rounded to the even one, bags rather than sets."""
    shape = lambda c, p=0, dx=0.0, w=10.0, k="graphic": (c, p, k, dx, 0.0, dx + w, 5.0)
    before = [
        shape("same"), shape("moved"), shape("flowed", dx=0.0), shape("wide"), shape("lost page", 1), shape("twice"), shape("twice"), shape("half", w=0.25),
        shape("image", k="image"), shape("size", k="image"), shape("size", k="image", w=20), shape("swap", k="image"), shape("swap", k="image", w=20), shape("more", k="image"), shape("gone"),
    ]
    after = [
        shape("same", dx=0.2), shape("moved", dx=0.8), shape("flowed", dx=9.0), shape("wide", w=11.6), shape("twice"), shape("half", w=0.0),
        shape("size", k="image", w=12), shape("size", k="image", w=20), shape("swap", k="image", w=20), shape("swap", k="image"), shape("more", k="image"), shape("more", k="image"),
    ]
    cases = {r[0] for r in before}
    pages = spark.createDataFrame([(c, 2, 1 if c == "lost page" else 2) for c in cases], "case string, a int, b int")
    reflow = spark.createDataFrame([("flowed", 0, 1.0), ("wide", 0, 1.0)], "case string, page int, top double")
    got = layout.box_findings(spark.createDataFrame(before, BOX), spark.createDataFrame(after, BOX), pages, reflow).collect()
    assert {(r.case, r.code, r.severity, r.n) for r in got} == {
        ("moved", "graphics_changed", "warning", 1), ("gone", "graphics_changed", "warning", 1), ("twice", "graphics_changed", "warning", 1), ("wide", "graphics_changed_on_reflowed_page", "info", 1),
        ("image", "image_missing", "error", 1), ("size", "image_size_changed", "warning", 2), ("more", "image_size_changed", "warning", 1),
    }


WORD = "case string, ord int, text string, page int, x0 double, top double, size double, font string, color string, marked boolean"


def test_reflow_begins_at_the_least_top(spark):
    w = lambda i, top, page=0: ("c", i, f"w{i}", page, 0.0, top, 10.0, "f", "k", False)
    before = spark.createDataFrame([w(0, 10.0), w(1, 30.0), w(2, 40.0), w(3, 50.0)], WORD)
    after = spark.createDataFrame([w(0, 10.5), w(1, 24.0), w(2, 40.0), w(3, 2.0, 1)], WORD)
    got = {(r.page, r.top) for r in layout.reflow_tops(layout.aligned(before, after)).collect()}
    assert got == {(0, 24.0), (1, 2.0)}


def test_renderings(spark):
    w = lambda c, i, x=0.0, page=0, t="w": (c, i, t, page, x, 0.0, 10.0, "f", "k", False)
    plain = [w(c, 5 * i, page=i // 2) for c in ("same", "near", "far", "short", "long", "page", "text") for i in range(4)]
    change = {
        "near": lambda i, r: w("near", r[1], 0.009, r[3]), "far": lambda i, r: w("far", r[1], 0.02, r[3]) if i == 2 else r, "short": lambda i, r: r if i else None,
        "page": lambda i, r: w("page", r[1], page=1) if i == 1 else r, "text": lambda i, r: w("text", r[1], page=r[3], t="v") if i == 3 else r,
    }
    marked = [x for k, r in enumerate(plain) if (x := change.get(r[0], lambda i, r: r)(k % 4, r))] + [w("long", 99, page=1)]
    got = layout.render_findings(spark.createDataFrame(plain, WORD), spark.createDataFrame(marked, WORD)).collect()
    # a missing first word shifts all others; two of the three left lie on another page
    assert {(r.case, r.n) for r in got} == {("far", 1), ("short", 2), ("long", 1), ("page", 1), ("text", 1)}


def test_edited_lines(spark):
    w = lambda c, i, top, marked: (c, i, "w", 0, 0.0, top, 10.0, "f", "k", marked)
    before = spark.createDataFrame([w("a", 0, 1.0, True), w("a", 1, 2.0, True), w("b", 0, 1.0, True), w("c", 0, 1.0, True)], WORD)
    after = spark.createDataFrame([w("a", 0, 1.0, True), w("a", 1, 1.04, True), w("b", 0, 9.0, True), w("c", 0, 1.0, False)], WORD)
    assert {(r.case, r.n) for r in layout.edited_lines(before, after).collect()} == {("a", 1), ("c", 0)}
    assert layout.numbered(before).select(F.max("nth")).first()[0] == 1


def test_gate(spark):
    rows = [("a", "x", "info", 9), ("b", "x", "info", 9), ("b", "y", "warning", 1), ("b", "z", "warning", 1), ("c", "y", "warning", 8), ("c", "q", "error", 1), ("c", "r", "error", 2)]
    cases = spark.createDataFrame([(c,) for c in "abcd"], "case string")
    got = {tuple(r) for r in layout.gate(cases, spark.createDataFrame(rows, "case string, code string, severity string, n long")).collect()}
    assert got == {("a", "PASS", 1, "x"), ("b", "REVIEW_REQUIRED", 3, "y"), ("c", "FAIL", 3, "r"), ("d", "PASS", 0, None)}


def test_a_case_in_a_row_is_aligned_as_one_in_many(spark):
    rng = random.Random(5)
    rows = {"a": [], "b": []}
    texts = {}
    for case in range(6):
        a = [rng.choice("abcdefgh") if rng.random() < 0.6 else f"w{rng.randrange(60)}" for _ in range(120)]
        b = [w for w in a if rng.random() < 0.9] + ["new"] * case
        texts[case] = a, b
        for side, ws in zip("ab", (a, b)):
            rows[side] += [(case, o, w) for o, w in enumerate(ws)]
    d = {s: spark.createDataFrame(r, "case int, ord int, text string") for s, r in rows.items()}
    got = {}
    for r in alignment.pairs(d["a"], d["b"], lambda x: x.cache(), short=10).collect():
        got.setdefault(r.case, []).append((r.a, r.b))
    for case, (a, b) in texts.items():
        assert sorted(got[case]) == alignment.anchored(a, b, short=10)


def test_renderings_in_rows(spark):
    word = "struct<text:string,page:int,x0:double,top:double>"
    p = [("a", 0, 1.0, 1.0), ("b", 0, 2.0, 1.0), (None, 1, 0.0, 0.0)]
    m = [("a", 0, 1.005, 1.0), ("b", 0, 2.5, 1.0), (None, 1, 0.0, 0.0), ("c", 1, 5.0, 0.0)]
    rows = spark.createDataFrame([(1, p, m), (2, p[:1], m[:1]), (3, [], m)], f"case int, p array<{word}>, m array<{word}>")
    got = layout.rendered_rows(rows)
    flat = lambda s: rows.select("case", F.posexplode(s).alias("ord", "w")).select("case", "ord", "w.*")
    want = layout.render_findings(flat("p"), flat("m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, "marker_render_inconsistent", "warning", 3), (3, "marker_render_inconsistent", "warning", 4)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
