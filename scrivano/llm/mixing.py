"""Mixing sources to target weights by cube-method balanced sampling.

Targets.  Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all
words; a target stops at twice its source's words and the excess goes to the others by weight.
With sources sorted by 2 * words / weight, the stopped ones are a prefix, so running sums give the
common level; they are summed by ranges of sources, of which there may be very many.

Sampling.  A document is expected target / words of its source times: its whole part for certain,
the rest as an inclusion probability.  The flight phase keeps three fractional documents at a time
and moves their probabilities along the null space of two constraints, the sums of words and of
documents, until one is 0 or 1.  It runs in blocks of about BLOCK documents of one source; what at
most two documents a block leave open goes to the next level, with fewer blocks, until one block a
source is left.  There at most two documents land on the rounding that misses the words least, and a
few documents change sides if that brings the words nearer.
Every block is bounded, whatever the source holds, and random numbers come from hashes of the
block, so reruns agree.

Defined results: null text has size 0; a null source is a source; rows alike in source, id and
text are one unit with their number; an empty table or a table without words gives target 0 and
taken 0; other columns are ignored.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, pick, repeated, text_key, words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK = 4096
SEED = 20
TINY = 1e-9
#: Documents that the landing may change at most, after at most two have landed.
REPAIRS = 32


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """df with a column for each of sums: its sum over the rows before, in the given order.

    Rows are dealt out by ranges of the order and summed range by range, so that no task holds all of them;
    what the driver adds up is one row a range.
    """
    key = ["range", *(f"order{i}" for i in range(len(order)))]
    spread = df.select("*", *(o.alias(k) for o, k in zip(order, key[1:]))).repartitionByRange(*(F.col(k).asc_nulls_last() for k in key[1:]))
    held = written(spread.withColumn("range", F.spark_partition_id()))
    spark, totals = df.sparkSession, held.groupBy("range").agg(*(F.sum(c).cast("double").alias(n) for n, c in sums.items())).collect()  # a row a partition
    rows, so_far = [], dict.fromkeys(sums, 0.0)
    for r in sorted(totals, key=lambda r: r["range"]):
        rows.append((r["range"], *so_far.values()))
        so_far = {n: x + (r[n] or 0.0) for n, x in so_far.items()}
    before = spark.createDataFrame(rows, "range int" + "".join(f", before_{n} double" for n in sums))
    line = Window.partitionBy("range").orderBy(*(F.col(k).asc_nulls_last() for k in key[1:])).rowsBetween(Window.unboundedPreceding, -1)
    inside = held.select("*", *(F.coalesce(F.sum(c).over(line), F.lit(0)).cast("double").alias(n) for n, c in sums.items()))
    out = inside.join(F.broadcast(before), "range")
    return out.select(*df.columns, *((F.col(n) + F.col(f"before_{n}")).alias(n) for n in sums))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) with target.  Each row is a source; there may be as many of them as web domains."""
    named = running(sizes, [F.col("source")], {"place": F.lit(1)})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place").cast("long"), F.lit(len(weights))) + 1).cast("int"))
    s = named.select("source", "source_size", w.cast("double").alias("w"), (F.col("source_size") * limit).cast("double").alias("most"))
    s = written(running(s, [F.col("most") / F.col("w"), F.col("source")], {"most_before": F.col("most"), "w_before": F.col("w")}))
    every = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    # the common level if all sources before this one have stopped; the first that it leaves below its limit sets it
    level = (share * every["words"] - F.col("most_before")) / (every["w"] - F.col("w_before"))
    # (from there on the level only falls, so it is the highest one; sources with the same limit don't matter)
    first = s.select(level.alias("level"), "w", "most").where("level * w <= most").agg(F.max("level")).first()[0]
    target = F.col("most") if first is None else F.least(F.col("most"), F.lit(float(first)) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def flight(p: list[float], size: list[int], rng: random.Random, landing: bool = False) -> list[float]:
    """Inclusion probabilities after the flight phase, and after the landing if asked for."""
    p, active, queue = list(p), [], [i for i, x in enumerate(p) if TINY < x < 1 - TINY]
    p = [x if TINY < x < 1 - TINY else float(round(x)) for x in p]
    open_ones, whole = list(queue), sum(a * b for a, b in zip(p, size))
    queue.reverse()
    while True:
        while len(active) < 3 and queue:
            active.append(queue.pop())
        if len(active) < 2:
            break
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (b - c, c - a, a - b)  # orthogonal to (a, b, c) and to (1, 1, 1)
            if not any(u):
                u = (1, -1, 0)
        elif size[active[0]] == size[active[1]]:
            u = (1, -1)
        else:
            break
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, u):
            p[i] += step * x
        still = []
        for i in active:
            if TINY < p[i] < 1 - TINY:
                still.append(i)
            else:
                p[i] = float(round(p[i]))
        if len(still) == len(active):  # rounding kept all open: settle the closest
            i = min(active, key=lambda i: (min(p[i], 1 - p[i]), i))
            p[i] = float(round(p[i]))
            still.remove(i)
        active = still
    if landing:
        want, count = sum(p[i] * size[i] for i in active), sum(p[i] for i in active)
        best = min(range(1 << len(active)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(active) if m >> k & 1) - want), abs(m.bit_count() - count), m))
        for k, i in enumerate(active):
            p[i] = float(best >> k & 1)
        # A long document may have landed far off: change single ones while that brings the words nearer.
        off = sum(a * b for a, b in zip(p, size)) - whole
        for _ in range(REPAIRS):
            i = min(open_ones, key=lambda i: (abs(off + size[i] * (1 - 2 * p[i])), i), default=None)
            if i is None or abs(off + size[i] * (1 - 2 * p[i])) >= abs(off):
                break
            off += size[i] * (1 - 2 * p[i])
            p[i] = 1 - p[i]
    return p


def _mover(names: list[str], level: int, last: bool):
    def move(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("id", "ascending"), ("k", "ascending")])
        h = t.column("h")
        rng = random.Random(f"{SEED} {level} {len(h)} {h[0]} {h[-1]}")
        p = flight(t.column("p").to_pylist(), t.column("size").to_pylist(), rng, last)
        return t.select(names).set_column(names.index("p"), "p", pa.array(p, pa.float64()))

    return move


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """One row for each distinct (source, id, text key): n rows alike, size, copies of all n, source_size, target."""
    rows = df.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    units = written(rows.groupBy("source", "id", "k").agg(F.count("*").alias("n"), F.max("size").alias("size")))
    sizes = written(targets(units.groupBy("source").agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("source_size"))))
    # A row a source: joined by value, Catalyst broadcasts it where its measured size allows.
    u = units.join(sizes.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    expected = F.when(F.col("source_size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(expected + TINY)
    u = u.withColumn("base", base).withColumn("p", F.greatest(F.lit(0.0), expected - base))
    u = u.withColumn("h", F.xxhash64(F.lit(SEED), "source", "id", "k"))
    most = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    names, done = u.columns, []
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in u.schema.fields)
    blocks, level = max(1, -(-most // block)), 0
    while True:
        last = blocks == 1

        part = F.pmod(F.shiftrightunsigned("h", 3), F.lit(blocks)).cast("int")
        moved = written(u.withColumn("part", part).groupBy("source", "part").applyInArrow(_mover(names, level, last), kind))
        done.append(moved if last else moved.where((F.col("p") == 0) | (F.col("p") == 1)))
        if last:
            break
        u = moved.where((F.col("p") > 0) & (F.col("p") < 1))
        blocks, level = max(1, -(-blocks * 3 // block)), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("source", "id", "k", "n", "size", "source_size", "target", (F.col("base") + F.col("p")).cast("long").alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id_col, size, source_size, target, taken."""
    p = plan(df, id_col, text_col, source_col)
    # n rows alike share their copies: the first ones get one more.
    low, more = F.expr("copies div n"), F.expr("copies % n")
    both = repeated(p.withColumn("c", low + 1), more).unionByName(repeated(p.withColumn("c", low), F.col("n") - more))
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("c")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: df's rows, each as often as it is taken."""
    p = plan(df, id_col, text_col, source_col)
    # The same id and text may stand under several sources, so the key holds the source.
    key = F.struct(column(id_col).alias("id"), column(source_col).alias("source"))
    return pick(df, p.select(F.struct("id", "source").alias("id"), "k", "n", "copies"), key, text_col)
