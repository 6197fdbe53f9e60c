"""Pixels of two renderings of a page compared outside the places where change is expected.

A page's difference is found tile by tile: the difference by channel, the difference from the content that moved down
(tolerant to a pixel either way).  Then comes the opening that removes what is thinner than two pixels.  Changed pixels that
touch, corners included, are one region.  A page comes as one row, so its mask, a byte a pixel beside the six of its
sides, is in that row's task too: runs of its rows are joined there, and regions alone become rows.

pages: case, page, width, height, before, after (binary, rows of red, green and blue), expected (array of struct of x0, y0,
x1, y1 in pixels, the upper bounds not included; may be null), cut, start, shift (rows, may be null; see plan()).
Pages whose sides differ in size, or that one side lacks, are one region each.  A page without pixels has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The level from which a channel differs, the least area of a region, and the rim of expected places.
LEVEL, LEAST_AREA, PADDING = 32, 16, 4
TILE = 256


def plan(height: Column, dpi: Column, reflow_top: Column, shift: Column, last_bottom: Column, padding: int = PADDING) -> dict[str, Column]:
    """cut, start and shift of a page, in rows, from lengths in points: where the reflow begins, how far words moved down, and
    where the edited words end; null where a page has none."""
    scale = dpi / 72.0
    rows = lambda points: (points * scale).cast("int")
    cut = F.greatest(F.lit(0), rows(reflow_top) - padding)
    start = F.greatest(cut, rows(F.coalesce(last_bottom, F.lit(0.0))) + padding)
    down = F.bround(shift * scale).cast("int")
    fits = (shift > 0) & (down > 0) & (down < height - start - 2) & (start - down - 2 >= 0)
    return {"cut": F.when(reflow_top.isNotNull(), cut), "start": F.when(fits, start), "shift": F.when(fits, down)}


def difference(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much the channel differs that differs most."""
    by = np.maximum(before, after) - np.minimum(before, after)
    return np.maximum(np.maximum(by[..., 0], by[..., 1]), by[..., 2])


def changed(before: np.ndarray, after: np.ndarray, level: int) -> np.ndarray:
    """Where any channel differs by more than level."""
    return difference(before, after) > level


def opened(mask: np.ndarray) -> np.ndarray:
    """What lies in a block of two by two pixels that are all set."""
    block = mask[:-1, :-1] & mask[1:, :-1] & mask[:-1, 1:] & mask[1:, 1:]
    out = np.zeros_like(mask)
    for y in (0, 1):
        for x in (0, 1):
            out[y : y + block.shape[0], x : x + block.shape[1]] |= block
    return out


def joined(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a mask's rows: row, begin, end, and the number of the first run of their region; runs that touch, corners included, are one."""
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (ys, begins), ends = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    up = list(range(len(ys)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    at, rows, lows, highs = 0, ys.tolist(), begins.tolist(), ends.tolist()
    for i, (y, low, high) in enumerate(zip(rows, lows, highs)):
        while at < i and (rows[at] < y - 1 or (rows[at] == y - 1 and highs[at] < low)):
            at += 1
        k = at
        while k < i and rows[k] == y - 1 and lows[k] <= high:  # [low - 1, high + 1) holds one of its pixels
            x, z = sorted((root(i), root(k)))
            up[z] = x
            k += 1
    return ys, begins, ends, np.array([root(k) for k in range(len(up))], np.int64)


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 1 for the regions of a mask, and how many there are."""
    ys, begins, ends, roots = joined(mask)
    kept, numbers = np.unique(roots, return_inverse=True)
    out = np.zeros(mask.shape, np.int32)
    for y, a, b, n in zip(ys, begins, ends, numbers):
        out[y, a:b] = n + 1
    return out, len(kept)


def _moved(b: np.ndarray, a: np.ndarray, top: int, left: int, bottom: int, right: int, start: int, shift: int) -> np.ndarray:
    """By how much the after side's [top, bottom) x [left, right) differs at least from all that the before side has near shift rows above."""
    height, width = b.shape[:2]
    rows = height - start - shift - 1
    best = np.full((bottom - top, right - left), 255, np.uint8)
    target = a[top:bottom, left:right]
    columns = np.arange(left, right)
    for o in range(-shift - 2, -shift + 3):
        if start + o < 0 or start + o + rows > height:
            continue
        for ox in (-1, 0, 1):
            delta = difference(b[top + o : bottom + o, (columns - ox) % width], target)
            if ox:
                delta[:, (columns == 0) | (columns == width - 1)] = 255
            best = np.minimum(best, delta)
    return best


def page_difference(b: np.ndarray, a: np.ndarray, top: int, left: int, bottom: int, right: int, expected, cut, start, shift) -> np.ndarray:
    """By how much the pixels of a part of a page differ, 0 where change is expected: those beyond a level are changed, before the opening."""
    by = difference(b[top:bottom, left:right], a[top:bottom, left:right])
    for e in expected or ():
        by[max(e["y0"] - top, 0) : max(e["y1"] - top, 0), max(e["x0"] - left, 0) : max(e["x1"] - left, 0)] = 0
    if cut is not None:
        by[max(cut - top, 0) :] = 0
        if shift is not None:
            lo, hi = max(top, start), min(bottom, len(b) - shift - 1)
            if lo < hi:
                part = by[lo - top : hi - top]
                np.maximum(part, _moved(b, a, lo, left, hi, right, start, shift), out=part)
    return by


REGIONS = "case string, page int, level int, region string, area long"


def _page(row: dict, tile: int) -> np.ndarray:
    """By how much the pixels of a page differ, put together from its tiles."""
    height, width = row["height"], row["width"]
    b, a = (np.frombuffer(row[s], np.uint8).reshape(height, width, 3) for s in ("before", "after"))
    by = np.zeros((height, width), np.uint8)
    for top in range(0, height, tile):
        for left in range(0, width, tile):
            bottom, right = min(height, top + tile), min(width, left + tile)
            by[top:bottom, left:right] = page_difference(b, a, top, left, bottom, right, row["expected"], row["cut"], row["start"], row["shift"])
    return by


#: Rows and bytes of both sides' pixels that one Arrow batch holds.
BATCH_ROWS, BATCH_BYTES = 10_000, 64 << 20


def regions(pages: DataFrame, tile: int = TILE, level: int = LEVEL, least: int = LEAST_AREA) -> DataFrame:
    """case, page, region (its first pixel), area: the changed regions of least pixels and more.  Nothing is shuffled."""
    return regions_by_level(pages, (level,), tile, least).drop("level")


def regions_by_level(pages: DataFrame, levels: Sequence[int], tile: int = TILE, least: int = LEAST_AREA) -> DataFrame:
    """The same at each of several levels, beside level: a page is read, and its sides are compared, once for all of them."""
    fits = (F.length("before") == F.length("after")) & (F.length("before") == 3 * F.col("width") * F.col("height"))
    sound = pages.where(F.coalesce(fits, F.lit(False)))
    every = F.explode(F.array(*map(F.lit, levels))).alias("level")
    odd = pages.where(~F.coalesce(fits, F.lit(False))).select(F.col("case").cast("string"), "page", every, F.lit("size").alias("region"), F.lit(None).cast("long").alias("area"))
    kind = pa.schema([("case", pa.string()), ("page", pa.int32()), ("level", pa.int32()), ("region", pa.string()), ("area", pa.int64())])

    def of(row: dict) -> Iterator[tuple]:
        by = _page(row, tile)
        most = by.max()
        for level in levels:
            if most > level:
                ys, begins, ends, roots = joined(opened(by > level))
                areas = np.bincount(roots, weights=ends - begins, minlength=len(roots)).astype(np.int64)
                for k in np.flatnonzero(areas >= max(least, 1)):
                    yield row["case"], row["page"], level, f"{ys[k]}.{begins[k]}", int(areas[k])

    def run(batches):
        for b in batches:
            found = [r for i in range(b.num_rows) for r in of(b.slice(i, 1).to_pylist()[0])]
            for at in range(0, len(found), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[at : at + BATCH_ROWS]), kind.types)], schema=kind)

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sent = sound.where("width > 0 AND height > 0").select(F.col("case").cast("string").alias("case"), "page", "width", "height", "before", "after", "expected", "cut", "start", "shift")
    return sent.mapInArrow(run, REGIONS).unionByName(odd)


def findings(found: DataFrame) -> DataFrame:
    """case, code, severity, n of regions()."""
    return found.groupBy("case").agg(F.count("*").alias("n")).select("case", F.lit("unexpected_visual_change").alias("code"), F.lit("warning").alias("severity"), "n")
