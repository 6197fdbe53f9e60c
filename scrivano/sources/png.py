"""Rendered pages from PNG files, as the pixels that operators.raster compares.

Depths of one to eight bits; grey, colour, palettes, with or without a channel of opacity, which is left out as a page is
opaque.  Files with 16 bits a channel, interlaced ones, broken ones and those beyond MOST pixels give a row with a fault
and no pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: its first bytes, and the channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST = 1 << 26
FIELDS = "path string, width int, height int, pixels binary, fault string"


class Broken(ValueError):
    """What is wrong with a file; the first word is its fault."""


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk up to the end mark, their sums checked."""
    if data[:8] != SIGNATURE:
        raise Broken("no_png")
    at = 8
    while True:
        if at + 12 > len(data):
            raise Broken("truncated")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data):
            raise Broken("truncated")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise Broken("bad_sum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n


def unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """The rows of an image from their filtered bytes; step is the distance to the byte that stands for the pixel before."""
    if len(raw) < height * (stride + 1):
        raise Broken("truncated")
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, line, up = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            for c in range(step):  # each channel is a running sum
                out[y + 1, c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            own, above, left = line.tolist(), up.tolist(), [0] * step
            upper_left = [0] * step
            for x in range(stride):
                a, b = left[x], above[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = upper_left[x]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                left.append((own[x] + guess) & 255)
                upper_left.append(b)
            out[y + 1] = left[step:]
        else:
            raise Broken("bad_filter")
    return out[1:]


def decoded(data: bytes, most: int = MOST) -> tuple[int, int, bytes]:
    """Width, height and rows of red, green and blue."""
    header = palette = None
    body = []
    for kind, part in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if header is None:
        raise Broken("no_header")
    width, height, depth, color, _, _, interlaced = header
    if color not in CHANNELS or depth not in (1, 2, 4, 8) or interlaced or (depth < 8 and color not in (0, 3)):
        raise Broken("unsupported")
    if width * height > most or not width * height:
        raise Broken("size")
    n = CHANNELS[color]
    stride = (width * n * depth + 7) // 8
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(body), height * (stride + 1))
    except zlib.error as e:
        raise Broken("bad_data") from e
    rows = unfiltered(raw, height, stride, max(1, n * depth // 8))
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, :width]
    pixels = rows.reshape(height, width, n)
    if color == 3:
        if palette is None or pixels.max() >= len(palette):
            raise Broken("bad_palette")
        pixels = palette[pixels[:, :, 0]]
    elif n < 3:
        grey = pixels[:, :, :1] if depth == 8 else pixels[:, :, :1] * (255 // ((1 << depth) - 1))
        pixels = np.repeat(grey, 3, axis=2)
    return width, height, np.ascontiguousarray(pixels[:, :, :3]).tobytes()


def pages(files: DataFrame, most: int = MOST) -> DataFrame:
    """FIELDS of files (path, content): one row each."""

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows.append((path, *decoded(bytes(content), most), None))
                except Broken as e:
                    rows.append((path, None, None, None, str(e)))
                except (struct.error, ValueError):
                    rows.append((path, None, None, None, "bad_header"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FIELDS.split(", ")])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, FIELDS)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """pages() of the files that a path names."""
    return pages(spark.read.format("binaryFile").load(path).select("path", "content"))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """case, page, width, height, before, after of two versions' pages (case, page, width, height, pixels), as raster.regions() takes
    them beside its other columns.  Where the sides differ in size, or one lacks the page, one side's pixels are null."""
    of = lambda d, s: d.select("case", "page", F.col("width").alias(f"w{s}"), F.col("height").alias(f"h{s}"), F.col("pixels").alias(s))
    both = of(before, "before").join(of(after, "after"), ["case", "page"], "full")
    same = F.coalesce((F.col("wbefore") == F.col("wafter")) & (F.col("hbefore") == F.col("hafter")), F.lit(False))
    return both.select("case", "page", F.coalesce("wbefore", "wafter").alias("width"), F.coalesce("hbefore", "hafter").alias("height"), "before", F.when(same, F.col("after")).alias("after"))
