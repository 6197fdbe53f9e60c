"""The sweep by running sums against every case judged at every setting."""

import itertools
import math
import random

from pyspark.sql import functions as F

from scrivano.operators import calibration, layout

CASE = "case int, faulty boolean, fixed boolean, early double, wrapped double, still double"


def test_against_the_direct_sweep(spark):
    rng = random.Random(3)
    far = lambda: rng.choice([None, None, 0.0, 0.25, 0.3, 0.75, 0.8, 1.5, 2.0, math.inf])
    cases = [(c, rng.random() < 0.5, rng.random() < 0.1, far(), far(), rng.choice([None, None, far()])) for c in range(400)]
    areas = [(c, p, v, rng.choice([1, 3, 4, 15, 16, 63, 64, 200])) for c in range(400) for p in calibration.POSITIONS for v in calibration.LEVELS if rng.random() < 0.3]
    largest = {(c, p, v): a for c, p, v, a in areas}
    want = {}
    for p, v, a in itertools.product(calibration.POSITIONS, calibration.LEVELS, calibration.AREAS):
        n = dict.fromkeys(("tp", "fn", "fp", "tn"), 0)
        for c, faulty, fixed, early, wrapped, still in cases:
            flagged = fixed or any(d is not None and d > p for d in (early, wrapped)) or (still is not None and still <= p) or largest.get((c, p, v), 0) >= a
            n[("tp" if flagged else "fn") if faulty else ("fp" if flagged else "tn")] += 1
        want[p, v, a] = n
    got = calibration.sweep(spark.createDataFrame(cases, CASE), spark.createDataFrame(areas, "case int, position double, level int, area long")).collect()
    assert {(r.position, r.level, r.area): {k: r[k] for k in ("tp", "fn", "fp", "tn")} for r in got} == want
    assert all(r.miss_rate == round(r.fn / max(1, r.tp + r.fn), 4) for r in got)


def test_one_kind_of_cases_alone(spark):
    got = calibration.sweep(spark.createDataFrame([(1, True, False, 1.0, None, None)], CASE), spark.createDataFrame([], "case int, position double, level int, area long")).collect()
    assert len(got) == 27 and {(r.position, r.tp, r.fn, r.fp, r.tn) for r in got} == {(0.25, 1, 0, 0, 0), (0.75, 1, 0, 0, 0), (1.5, 0, 1, 0, 0)}


WORD = "case string, ord int, text string, page int, x0 double, top double, size double, font string, color string, marked boolean"


def test_deviations(spark):
    """Where a deviation lies is where gate D's own counts begin."""
    rng = random.Random(5)
    before, after = [], []
    for c in range(12):
        for i in range(12):
            w = [str(c), i, f"w{i}", i // 8, 50.0 * (i % 4), 12.0 * (i // 4), 10.0, "f", "k", i == 6 and c % 3 > 0]
            before.append(tuple(w))
            if rng.random() < 0.2:
                w[4] += rng.choice([0.5, 1.0, 3.0])
            if c % 4 == 1 and i > 8:
                w[5] += 1.0
            if c == 5 and i == 3:
                w[3] = 1
            after.append(tuple(w))
    before, after = spark.createDataFrame(before, WORD), spark.createDataFrame(after, WORD)
    pairs = layout.aligned(before, after).cache()
    first = layout.first_marked(before)
    dev = {r.case: r for r in calibration.deviations(pairs, first).collect()}
    for position in (0.25, 0.75, 1.5, 5.0):
        found = {(r.case, r.code) for r in layout.word_findings(pairs, first, position).collect()}
        assert {c for c, r in dev.items() if r.early is not None and r.early > position} == {c for c, code in found if code == "shift_before_edit"}
        assert {c for c, r in dev.items() if r.wrapped > position} == {c for c, code in found if code == "line_wrap_changed"}


def test_still_pages(spark):
    words = [("c", p, f"w{p}", p, 0.0, 0.0, 10.0, "f", "k", False) for p in range(3)]
    moved = [(*w[:4], (0.0, 1.0, 9.0)[i], *w[5:]) for i, w in enumerate(words)]
    pairs = layout.aligned(spark.createDataFrame(words, WORD), spark.createDataFrame(moved, WORD))
    box = lambda p, x: ("c", p, "graphic", x, 0.0, x + 5, 5.0)
    kind = "case string, page int, kind string, x0 double, top double, x1 double, bottom double"
    before = spark.createDataFrame([box(p, 0.0) for p in range(3)], kind)
    after = lambda *xs: spark.createDataFrame([box(p, x) for p, x in enumerate(xs)], kind)
    still = lambda *xs: [r.still for r in calibration.still_pages(before, after(*xs), pairs).collect()]
    assert still(0.0, 0.0, 0.0) == [] and still(0.0, 9.0, 9.0) == [1.0] and still(9.0, 9.0, 0.0) == [0.0] and still(0.0, 0.0, 9.0) == [9.0]
    pages = spark.createDataFrame([("c", 3, 3)], "case string, a int, b int")
    for position in (0.25, 0.75, 1.5):
        for xs in ((0.0, 9.0, 9.0), (9.0, 9.0, 0.0), (0.0, 0.0, 9.0)):
            codes = {r.code for r in layout.box_findings(before, after(*xs), pages, layout.reflow_tops(pairs, position)).collect()}
            assert ("graphics_changed" in codes) == (still(*xs)[0] <= position)
    assert pairs.select(F.count("*")).first()[0] == 3
