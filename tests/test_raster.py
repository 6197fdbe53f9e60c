"""Regions of changed pixels against a flood fill of the whole page."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivano.operators import raster

SCHEMA = "case string, page int, width int, height int, before binary, after binary, expected array<struct<x0:int,y0:int,x1:int,y1:int>>, cut int, start int, shift int"


def flooded(mask):
    """Sizes of the 8-connected regions."""
    left, out = {*zip(*map(list, np.nonzero(mask)))}, []
    while left:
        work, n = [left.pop()], 0
        while work:
            y, x = work.pop()
            n += 1
            for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if q in left:
                    left.remove(q)
                    work.append(q)
        out.append(n)
    return sorted(out)


def plain(b, a, expected=(), cut=None, start=None, shift=None, level=32):
    """The whole page at once, pixel by pixel."""
    h, w = b.shape[:2]
    far = lambda p, q: max(abs(int(u) - int(v)) for u, v in zip(p, q)) > level
    mask = np.array([[far(b[y, x], a[y, x]) for x in range(w)] for y in range(h)], bool).reshape(h, w)
    for e in expected:
        mask[e[1] : e[3], e[0] : e[2]] = False
    if cut is not None:
        mask[cut:] = False
        if shift is not None:
            rows = h - start - shift - 1
            for y in range(start, start + rows):
                for x in range(w):
                    seen = [
                        b[y - d + oy, (x - ox) % w] for d in (shift - 1, shift, shift + 1) for oy in (-1, 0, 1) for ox in (-1, 0, 1)
                        if 0 <= start - d + oy and start - d + oy + rows <= h and not (ox and x in (0, w - 1))
                    ]
                    if all(far(p, a[y, x]) for p in seen):
                        mask[y, x] = True
    block = [(y, x) for y in range(h - 1) for x in range(w - 1) if mask[y : y + 2, x : x + 2].all()]
    out = np.zeros_like(mask)
    for y, x in block:
        out[y : y + 2, x : x + 2] = True
    return out


def blotted(rng, h, w, density):
    a = np.full((h, w, 3), 255, np.uint8)
    for _ in range(int(density * h * w / 12)):
        y, x = rng.integers(h), rng.integers(w)
        a[y : y + rng.integers(1, 6), x : x + rng.integers(1, 6), rng.integers(3)] = rng.integers(256)
    return a


def row(case, b, a, expected=(), cut=None, start=None, shift=None):
    keys = ("x0", "y0", "x1", "y1")
    return (case, 0, b.shape[1], b.shape[0], bytearray(b.tobytes()), bytearray(a.tobytes()), [dict(zip(keys, e)) for e in expected] or None, cut, start, shift)


def areas(spark, rows, tile, least=1):
    got = {r[0]: [] for r in rows}
    for r in raster.regions(spark.createDataFrame(rows, SCHEMA), tile, least=least).collect():
        got[r.case].append(r.area)
    return {c: sorted(v) for c, v in got.items()}


def test_labels():
    rng = np.random.default_rng(1)
    for _ in range(200):
        mask = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.random()
        marks, n = raster.labelled(mask)
        assert sorted(np.bincount(marks[marks > 0], minlength=n + 1)[1:].tolist()) == flooded(mask) and ((marks > 0) == mask).all()


@pytest.mark.parametrize("tile", [4, 7, 16, 500])
def test_random_pages(spark, tile):
    rng = np.random.default_rng(tile)
    rows, want = [], {}
    for i in range(12):
        h, w = rng.integers(1, 40, 2)
        b, a = np.full((h, w, 3), 255, np.uint8), blotted(rng, h, w, rng.choice([0.2, 1, 3]))
        more = {}
        if i % 3 == 1:
            more["expected"] = [tuple(int(v) for v in (*rng.integers(0, 20, 2), *rng.integers(10, 40, 2))) for _ in range(2)]
        if i % 3 == 2:
            b = blotted(rng, h, w, 1)
            more["cut"] = int(rng.integers(0, h))
            shift, start = int(rng.integers(1, 6)), more["cut"] + int(rng.integers(0, 4))
            if shift < h - start - 2 and start - shift - 2 >= 0:
                more |= {"start": start, "shift": shift}
                a = np.roll(b, shift, axis=0)
                a[rng.integers(h) :, : rng.integers(1, w + 1)] = 90
        rows.append(row(f"c{i}", b, a, **more))
        want[f"c{i}"] = flooded(plain(b, a, **more))
    assert areas(spark, rows, tile) == want


def test_a_region_over_four_tiles_is_one(spark):
    b, a = (np.full((32, 32, 3), 255, np.uint8) for _ in range(2))
    a[12:20, 12:20] = 0  # around the corner of four tiles of 16
    a[0:2, 14:16] = a[2:4, 16:18] = 0  # two that touch by a corner across a border
    a[28:30, 2] = 0  # thinner than two pixels
    assert areas(spark, [row("c", b, a)], 16) == {"c": [8, 64]}
    found = raster.findings(raster.regions(spark.createDataFrame([row("c", b, a)], SCHEMA), 16))
    assert [tuple(r) for r in found.collect()] == [("c", "unexpected_visual_change", "warning", 1)]  # 8 pixels are too few


def test_pages_of_other_sizes(spark):
    b = np.zeros((4, 4, 3), np.uint8)
    rows = [row("same", b, b), row("size", b, np.zeros((4, 5, 3), np.uint8)), (*row("lost", b, b)[:5], None, None, None, None, None), ("none", 0, 0, 0, bytearray(), bytearray(), None, None, None, None)]
    assert areas(spark, rows, 16) == {"same": [], "size": [None], "lost": [None], "none": []}
    assert raster.regions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan(spark):
    d = spark.createDataFrame([(1100, 100.0, 72.0, 12.6, 50.4), (1100, 100.0, None, 12.0, 1.0), (1100, 100.0, 72.0, -3.0, 1.0), (1100, 100.0, 3.6, 12.0, None), (1100, 100.0, 72.0, None, 900.0)], "h int, dpi double, top double, shift double, last double")
    got = d.select(*(c.alias(n) for n, c in raster.plan(*map(F.col, ("h", "dpi", "top", "shift", "last"))).items())).collect()
    # 12.6 points are 17.5 rows, which rounds to the even 18
    assert [tuple(r) for r in got] == [(96, 96, 18), (None, None, None), (96, None, None), (1, None, None), (96, None, None)]


def test_regions_shuffle_nothing(spark):
    """Links between tiles met in a join whose side was sent to the driver: 637 MB for 0.1 GB of texts."""
    b = np.zeros((40, 40, 3), np.uint8)
    plan = raster.regions(spark.createDataFrame([row("c", b, 255 - b)], SCHEMA), 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_levels_in_one_reading(spark):
    """Each level's regions are those of a run of its own, and the plan reads its pages once."""
    rng = np.random.default_rng(3)
    b = rng.integers(0, 60, (20, 24, 3), np.uint8)
    a = b + rng.integers(0, 140, (20, 24, 3), np.uint8)
    pages = spark.createDataFrame([row("c", b, a), row("d", b, b), row("e", b, a[:9])], SCHEMA)
    got = raster.regions_by_level(pages, (32, 48, 96), tile=7, least=1)
    want = {(r.case, r.page, level, r.region, r.area) for level in (32, 48, 96) for r in raster.regions(pages, tile=7, level=level, least=1).collect()}
    assert {tuple(r) for r in got.collect()} == want and len({r[2] for r in want if r[0] == "c"}) == 3
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
