"""PNG files written here with every filter, depth and colour type, read again; broken ones; and two versions compared."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivano.operators import raster
from scrivano.sources import png


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows, step, kinds):
    """Rows of bytes, each filtered as its kind says, by the format's definition."""
    out, up = b"", [0] * len(rows[0])
    for row, kind in zip(rows, kinds):
        line = []
        for x, v in enumerate(row):
            a, b, c = row[x - step] if x >= step else 0, up[x], up[x - step] if x >= step else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v, p=p: abs(p - v))  # the first of equals
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *line])
        up = row
    return out


def png_of(values, color, depth=8, kinds=None, palette=None, interlaced=0):
    """values: height x width x channels, of depth bits each."""
    h, w, n = values.shape
    if depth < 8:
        bits = ((values[:, :, 0, None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(h, -1)
        rows = np.packbits(bits.astype(np.uint8), axis=1)
    else:
        rows = values.reshape(h, -1)
    data = filtered(rows.tolist(), max(1, n * depth // 8), kinds or [0] * h)
    packed = zlib.compress(data)
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlaced)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"")
    return png.SIGNATURE + body + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("color, depth", [(0, 1), (0, 2), (0, 4), (0, 8), (2, 8), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (6, 8)])
def test_every_kind(color, depth):
    rng = np.random.default_rng(color * 10 + depth)
    for w, h in ((1, 1), (7, 5), (16, 9), (33, 12)):
        values = rng.integers(0, 1 << depth, (h, w, png.CHANNELS[color]), np.uint8)
        palette = rng.integers(0, 256, (1 << depth, 3), np.uint8) if color == 3 else None
        width, height, pixels = png.decoded(png_of(values, color, depth, rng.integers(0, 5, h).tolist(), palette))
        want = palette[values[:, :, 0]] if color == 3 else values[:, :, :3] if color in (2, 6) else np.repeat(values[:, :, :1].astype(int) * 255 // ((1 << depth) - 1), 3, axis=2)
        assert (width, height) == (w, h) and (np.frombuffer(pixels, np.uint8).reshape(h, w, 3) == want).all()


def test_faults(spark):
    v = np.zeros((3, 4, 3), np.uint8)
    good = png_of(v, 2)
    cases = {
        "no_png": b"GIF89a", "truncated": good[:-6], "bad_sum": good.replace(b"a\0b", b"a\0c"), "unsupported": png_of(v, 2, interlaced=1), "bad_filter": png_of(v, 2).replace(b"", b"", 0), "no_header": png.SIGNATURE + chunk(b"IEND", b""),
        "size": png_of(np.zeros((100, 100, 3), np.uint8), 2), "bad_palette": png_of(np.full((2, 2, 1), 9, np.uint8), 3, 8, None, np.zeros((2, 3), np.uint8)), "bad_header": png.SIGNATURE + chunk(b"IHDR", b"x") + chunk(b"IEND", b""),
        "bad_data": png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"no stream") + chunk(b"IEND", b""),
    }
    packed = zlib.compress(bytes([9] + [0] * 12) * 3)
    cases["bad_filter"] = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")
    files = spark.createDataFrame([(k, bytearray(b)) for k, b in [*cases.items(), ("good", good)]], "path string, content binary")
    got = {r.path: r for r in png.pages(files, most=9_000).collect()}
    assert {k: got[k].fault for k in cases} == {k: k for k in cases}
    assert (got["good"].width, got["good"].height, bytes(got["good"].pixels), got["good"].fault) == (4, 3, v.tobytes(), None)


def test_versions_compared(spark, tmp_path):
    """Files of two versions, from the disk to their regions."""
    rng = random.Random(1)
    white = np.full((40, 30, 3), 255, np.uint8)
    for v in ("a", "b"):
        for page in range(3):
            p = white.copy()
            if v == "b" and page == 1:
                p[10:20, 5:12] = 0
            if v == "b" and page == 2:
                p = p[:30]
            (tmp_path / f"{v}_{page}.png").write_bytes(png_of(p, 2, kinds=[rng.randrange(5) for _ in range(len(p))]))
    rows = png.scan(spark, f"{tmp_path}/*.png").withColumn("name", F.regexp_extract("path", r"([ab])_(\d)\.png$", 1))
    rows = rows.select("name", F.lit("case").alias("case"), F.regexp_extract("path", r"(\d)\.png$", 1).cast("int").alias("page"), "width", "height", "pixels")
    both = png.paired(rows.where("name = 'a'"), rows.where("name = 'b'"))
    none = {"expected": "array<struct<x0:int,y0:int,x1:int,y1:int>>", "cut": "int", "start": "int", "shift": "int"}
    found = raster.regions(both.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}), tile=16)
    assert {(r.page, r.area) for r in found.collect()} == {(1, 70), (2, None)}
