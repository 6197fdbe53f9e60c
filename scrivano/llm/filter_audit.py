"""Filter interaction audit: what each filter removes under every order of the filters.

profile() scans Arrow's buffers: bytes become classes by one table, prefix sums of the classes read at the texts'
offsets count words, capitals, symbols and code points, and sorted word keys, verified, count distinct words.
audit() counts documents by their set of failed filters; every order and step is then read from those counts.

Null texts are empty ones; an empty text has no words, so it fails A alone (and E, if a smaller id has none either).
Rows of one id each count.  A row without an id is never a copy and never makes one.  Labels of one id are joined by
or; labels without an id, null or other values mean 0.  Null parts are the empty string.  No document, no row.
Columns of any name may stand beside those named.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, discard, small_batches, written

#: The filters in the order of their bits, and their thresholds.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"

WHITE, CAPITAL, SYMBOL, LEAD = 1, 2, 4, 8
CLASS = np.zeros(256, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] |= WHITE
CLASS[65:91] |= CAPITAL
CLASS[list(SYMBOLS)] |= SYMBOL
CLASS[(np.arange(256) & 0xC0) != 0x80] |= LEAD

#: Bytes looked at in one go; a block ends at a word's end.
BLOCK = 1 << 20
#: Words longer than this many bytes are hashed; shorter ones are their own key.
SHORT = 8
KEEP = np.array([(1 << 8 * n) - 1 for n in range(SHORT + 1)], np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
VALUE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A5DEADBEEF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _words_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; data has eight bytes to spare."""
    return np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))[places]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from a and from b on are equal, pair by pair."""
    out = np.ones(len(a), bool)
    left = np.arange(len(a))
    for at in range(0, 64, 8):
        left = left[out[left] & (size[left] > at)]
        if not len(left):
            return out
        mask = KEEP[np.minimum(size[left] - at, 8)]
        out[left] = (_words_at(data, a[left] + at) & mask) == (_words_at(data, b[left] + at) & mask)
    for k in left[out[left] & (size[left] > 64)]:
        out[k] = data[a[k] : a[k] + size[k]].tobytes() == data[b[k] : b[k] + size[k]].tobytes()
    return out


def _distinct(data: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each of n texts: neighbours among the sorted keys are compared by their bytes."""
    order = np.lexsort((key, doc))
    doc, start, size, key = doc[order], start[order], size[order], key[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    out = np.bincount(doc[~again], minlength=n)
    pair = np.flatnonzero(again)
    wrong = size[pair] != size[pair - 1]
    long = np.flatnonzero(~wrong & (size[pair] > SHORT))
    wrong[long] = ~_same_bytes(data, start[pair[long]], start[pair[long] - 1], size[pair[long]])
    for d in np.unique(doc[pair[wrong]]):  # two words with one key: count that text's words themselves
        own = slice(*np.searchsorted(doc, [d, d + 1]))
        out[d] = len({data[s : s + k].tobytes() for s, k in zip(start[own], size[own], strict=True)})
    return out


def scanned(data: np.ndarray, offsets: np.ndarray, hashed=None) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and chars of the texts that offsets cut data into.

    hashed replaces the hashes of long words; tests make it collide.
    """
    n, last = len(offsets) - 1, int(offsets[-1])
    data = np.concatenate([data[:last], np.zeros(8, np.uint8)])
    sums = {k: np.zeros(n + 1, np.int64) for k in ("words", "capitals", "symbols", "chars")}
    base = dict.fromkeys(sums, 0)
    found: list[tuple[np.ndarray, ...]] = []
    powers = inverse = np.zeros(0, np.uint64)
    at = int(offsets[0])
    while at < last:
        stop = min(at + BLOCK, last)
        while stop < last and not CLASS[data[stop]] & WHITE:  # to the end of a word
            ahead = np.flatnonzero(CLASS[data[stop : min(stop + BLOCK, last)]] & WHITE)
            stop = stop + int(ahead[0]) if len(ahead) else min(stop + BLOCK, last)
        block = data[at:stop]
        cls = CLASS[block]
        lo, hi = np.searchsorted(offsets, [at, stop])
        cuts = offsets[lo:hi] - at  # texts that begin here
        begin = solid = (cls & WHITE) == 0
        begin = begin.copy()
        begin[1:] &= ~solid[:-1]
        begin[cuts] = solid[cuts]
        end = solid.copy()
        end[:-1] &= ~solid[1:]
        inner = cuts[cuts > 0] - 1
        end[inner] = solid[inner]
        for name, flags in (("words", begin), ("capitals", cls & CAPITAL), ("symbols", cls & SYMBOL), ("chars", cls & LEAD)):
            run = np.zeros(len(block) + 1, np.int32)
            np.cumsum(flags != 0, out=run[1:])
            sums[name][lo:hi] = base[name] + run[cuts]
            base[name] += int(run[-1])
        start = np.flatnonzero(begin)
        size = np.flatnonzero(end) + 1 - start
        key = _words_at(data, at + start) & KEEP[np.minimum(size, SHORT)]
        long = np.flatnonzero(size > SHORT)
        if len(long):
            if len(powers) < len(block):
                powers, inverse = _powers(BASE, len(block)), _powers(INVERSE, len(block))
            run = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(VALUE[block] * powers[: len(block)], out=run[1:])
            s = start[long]
            hashes = (run[s + size[long]] - run[s]) * inverse[s]
            key[long] = hashes if hashed is None else hashed(hashes)
        found.append((np.searchsorted(offsets, at + start, "right") - 1, at + start, size, key))
        at = stop
    for name in sums:
        sums[name][np.searchsorted(offsets, last) :] = base[name]
    out = {k: np.diff(v) for k, v in sums.items()}
    doc, start, size, key = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    out["distinct"] = _distinct(data, doc, start, size, key, n)
    return out


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary array, as Arrow holds them."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    cut = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), cut


COUNTS = ("words", "distinct", "capitals", "symbols", "chars")


def profile(docs: DataFrame, keep: dict[str, Column] | None = None, text_col: str = "text") -> DataFrame:
    """The columns keep, by name, and n_words, n_distinct, n_capitals, n_symbols and n_chars of each row's text."""
    small_batches(docs.sparkSession)
    keep = {c: column(c) for c in docs.columns if c != text_col} if keep is None else keep
    sent = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), as_bytes(column(text_col)).alias("raw"))
    kinds = [sent.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]

    def run(batches):
        for b in batches:
            if b.num_rows:
                counts = scanned(*_buffers(b.column("raw")))
                made = [pa.array(counts[k], pa.int64()) for k in COUNTS]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], *(f"n_{k}" for k in COUNTS)])

    out = sent.mapInArrow(run, ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), *(f"n_{k} long" for k in COUNTS)]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(f"n_{k}" for k in COUNTS))


def failures() -> Column:
    """The bits of the filters A to D that a profiled text fails."""
    fails = (
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * F.col("n_capitals") > MOST_CAPITALS * F.col("n_chars"),
        F.col("n_symbols") > 0,
    )
    out = F.lit(0)
    for k, f in enumerate(fails):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def masked(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, failed (the set of all five filters that fail, as bits), good, toxic and n, the number of such documents.

    Texts are compared by SHA-256.  Documents are counted by text, part and labels before any text's copies meet, so a
    text with ever so many copies is a few rows; the smallest id of a text is found by one aggregation.
    """
    keep = {"id": column(id_col), "part": F.coalesce(column(part_col).cast("string"), F.lit("")), "digest": F.unhex(F.sha2(as_bytes(column(text_col)), 256))}
    rows = profile(docs, keep, text_col).withColumn("failed", failures())
    rows = rows.groupBy("id", "part", "digest", "failed").agg(F.count("*").alias("n"))
    marks = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL")
    marks = marks.groupBy("id").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    told = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # min takes the smallest id with the number of its rows; in a group of these keys an id stands once
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    cells = told.groupBy("digest", "failed", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first.alias("first"))
    cells = written(cells)
    lowest = cells.groupBy(F.col("digest").alias("of")).agg(F.min("first.id").alias("low"))
    own = F.when(F.col("first.id") == F.col("low"), F.col("first.n")).otherwise(0) + F.col("nameless")
    both = cells.join(lowest, F.col("digest") == F.col("of")).withColumn("own", own)
    halves = F.array(F.struct("failed", F.col("own").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("own")).alias("n")))
    split = both.select("part", "good", "toxic", F.explode(halves).alias("half")).where("half.n > 0")
    out = written(split.groupBy("part", F.col("half.failed").alias("failed"), "good", "toxic").agg(F.sum("half.n").alias("n")))
    discard(cells)
    return out


def _steps() -> Column:
    """Every order's steps: filter_order, step, the filter's bit and the bits of those before it."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            rows.append({"filter_order": "".join(order), "step": k + 1, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(counts: DataFrame) -> DataFrame:
    """From masked()'s counts: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sums = counts.groupBy("part", "failed").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))  # at most 32 sets
    s = parts.select("part", "cells", F.explode(_steps()).alias("s"))
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(test, what: str = "n", weigh=None) -> Column:
        each = lambda c: c[what] if weigh is None else c[what] * weigh(c["failed"])
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(test(c["failed"]), each(c)).otherwise(0))

    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    # a document failing k filters goes at each of them in one k-th of the orders: 120 / k is whole up to five
    share = lambda m: (F.lit(120) / F.bit_count(m)).cast("long")
    return s.select(
        "part", "s.filter_order", "s.step",
        total(lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total(lambda m: m.bitwiseAND(bit) != 0, weigh=share).alias("shapley"),
    )
