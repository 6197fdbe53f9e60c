"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has 64 bits: the bitwise majority of the XXH64 values of its word
shingles.  Two fingerprints link when at most 3 bits differ; a component is what links reach.

Search.  The 64 bits are a ring of 4 segments of 16 bits.  If the segment differences of a pair
sum to at most 3, the pigeonring principle gives a start segment from which, for every l, the
first l segments of the ring differ in at most l * 3 / 4 bits together: 0, 1, 2, 3.  So the join
key is (start, segment, next segment): equal first segment, at most one bit off in the second.
One side carries the key as it is, the other the 17 keys within one bit.  A key has 32 bits of
content, so random candidates are rare; the third and fourth link of the chain are conditions of
the join itself, which gives out true links alone.  No pair within 3 bits is lost.

Skew.  Equal fingerprints collapse to one row before the search (partial aggregation), so a group
of exact copies costs one row there.  A key that more than HOT fingerprints have (families of texts
that share much) is split by the next segment of the ring, within the budget that the chain leaves
there: 48 bits of content, so that one key has 2^16 fingerprints at most.  The way back to documents is
salted and touches only fingerprints that several documents or links share.

Similarity of shingle sets.  deduplicated() may ask for a Jaccard similarity of the texts' shingles: then
the links found here are held against the whole sets, and similar.py looks for the pairs beyond 3 bits.

Defined results: null or blank text has fingerprint zero and links like any other; repeated rows
come back as often as they came; a null id has its fingerprint and its component's smallest id,
null if the component has no id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, column, discard, pick, small_batches, text_key, written

SHINGLE = 3
SEED = 42
SEGMENTS = 4
BITS = 64 // SEGMENTS
DISTANCE = 3
SALTS = 32
#: Fingerprints with one key, from which on the key is split.
HOT = 4096
#: Shingles hashed at a time: bounds the memory that one very long text takes.
CHUNK = 1 << 16


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def folded(ones: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes: bits that more than half of them have."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(raw: bytes) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    found = raw.lower().split()  # of bytes, both know ASCII alone
    n = len(found) - SHINGLE + 1
    if not found:
        return 0
    if n < 1:
        found, n = [b" ".join(found)], 1
        size = 1
    else:
        size = SHINGLE
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        parts = zip(*(found[lo + k : hi + k] for k in range(size)))
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts), "<u8", hi - lo)
        ones += majority(h)
    return folded(ones, n)


def _fingerprints(batches):
    for b in batches:
        values = [fingerprint(t) for t in b.column("raw").to_pylist()]
        kept = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.int64())], names=[*b.schema.names[:-1], "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_key, fp."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    raw = df.select(column(id_col).alias("id"), text_key(column(text_col)).alias("text_key"), as_bytes(text_col).alias("raw"))
    return raw.mapInArrow(_fingerprints, f"id {kind}, text_key long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * (i % SEGMENTS)).bitwiseAND((1 << BITS) - 1)


def _differ(a: Column, b: Column, first: int, n: int) -> Column:
    mask = sum(((1 << BITS) - 1) << (BITS * ((first + k) % SEGMENTS)) for k in range(n))
    mask -= (1 << 64) * (mask >> 63)
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask).cast("long")))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct values in column fp that differ in 1 to 3 bits."""
    fp = F.col("fp")
    # a row becomes 72 of them: a small table in a few files goes to all tasks first
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keys = [
        F.shiftleft(F.lit(i).cast("long"), 2 * BITS).bitwiseOR(F.shiftleft(_segment(fp, i), BITS)).bitwiseOR(_segment(fp, i + 1))
        for i in range(SEGMENTS)
    ]
    flips = (0, *(1 << j for j in range(BITS)))
    near = F.array(*(F.struct(k.bitwiseXOR(F.lit(m).cast("long")).alias("key"), F.lit(m == 0).alias("same")) for k in keys for m in flips))
    a = fps.select(fp.alias("a"), F.explode(near).alias("n")).select("a", "n.*")
    b = fps.select(fp.alias("b"), F.explode(F.array(*keys)).alias("other"))
    # counted where the join wants them anyway: the same partitioning and order
    b = b.withColumn("held", F.count("*").over(Window.partitionBy("other")))
    ca, cb, start = F.col("a"), F.col("b"), F.shiftrightunsigned(F.col("key"), 2 * BITS)
    by_start = lambda f: reduce(lambda out, i: out.when(start == i, f(i)), range(SEGMENTS), F.when(F.lit(False), f(0)))
    chain = by_start(lambda i: _differ(ca, cb, i, 3)) <= 3 * DISTANCE // SEGMENTS
    true_link = (ca < cb) & chain & (F.bit_count(ca.bitwiseXOR(cb)) <= DISTANCE)
    found = a.hint("merge").join(b.where(f"held <= {hot}"), (F.col("key") == F.col("other")) & true_link).select("a", "b")
    split = written(b.where(f"held > {hot}").select("b", "other"))
    if split.isEmpty():
        discard(split)
        return found
    # what the first two segments leave of the third one's budget: 2 bits, or 1 after a difference
    third = lambda x: by_start(lambda i: _segment(x, i + 2))
    one, two = ([m for m in range(1 << BITS) if m.bit_count() <= n] for n in (1, 2))
    asked = a.join(split.select(F.col("other").alias("key")).distinct().hint("merge"), "key", "left_semi")
    masks = F.when(F.col("same"), F.array(*map(F.lit, two))).otherwise(F.array(*map(F.lit, one)))
    asked = asked.select("a", "key", F.explode(masks).alias("m")).select("a", "key", third(ca).bitwiseXOR(F.col("m").cast("long")).alias("third"))
    held = split.select("b", F.col("other").alias("key")).select("b", "key", third(cb).alias("third"))
    return found.unionByName(asked.hint("merge").join(held, ["key", "third"]).where(true_link).select("a", "b"))


def _salt(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int")


def _salts_used(salt: str) -> Column:
    """Aggregate: the set of salts as bits, so that a key is copied only to salts that its rows have."""
    return F.bit_or(F.expr(f"shiftleft(1L, {salt})"))


def _salts(used: str) -> Column:
    return F.expr(f"filter(sequence(0, {SALTS - 1}), i -> {used} & shiftleft(1L, i) <> 0)")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star rounds; each is written to the shared folder.  The join
    on a node is salted, as the centre of a star may hold much of the table, and merges: Spark's
    estimate of a side's size does not see the salts, so it might broadcast what grows with the input.
    """

    def star(e: DataFrame) -> DataFrame:
        """Each (u, v) with the smallest of u and all its v."""
        e = e.withColumn("s", _salt("v"))
        low = e.groupBy("u").agg(F.min("v").alias("m"), _salts_used("s").alias("used"))
        low = low.select("u", F.least("u", "m").alias("m"), F.explode(_salts("used")).alias("s"))
        return e.join(low.hint("merge"), ["u", "s"]).select("u", "v", "m")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())

    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct())
        discard(e)
        e, now = new, state(new)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, text_key, fingerprint, component_id."""
    prints = written(fingerprints(df, id_col, text_col)).withColumn("salt", _salt("id", "text_key"))
    classes = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("low"), _salts_used("salt").alias("used")))
    found = written(components(links(classes)))
    joined = found.join(classes, found.node == classes.fp)
    reached = joined.groupBy("root").agg(F.min("low").alias("component"))
    linked = joined.select("node", "root", "used").join(reached, "root").select(F.col("node").alias("fp"), "component", "used")
    copies = classes.where("n > 1").join(found, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("low").alias("component"), "used")
    several = linked.unionByName(copies).select("fp", "component", F.explode(_salts("used")).alias("salt"), F.lit(True).alias("several"))
    out = prints.join(several.hint("merge"), ["fp", "salt"], "left")
    return out.select(
        F.col("id").alias(id_col),
        "text_key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("several"), F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: tuple[int, int] | None = None) -> DataFrame:
    """One row of each group: the one with the smallest id (null last), then the smallest text key.

    A group is what links within 3 bits reach; with jaccard (a fraction of whole numbers), what pairs of
    texts reach whose sets of five-word shingles are that similar or more.  A group without any id is a
    component of its own fingerprint.
    """
    if jaccard:
        from .similar import deduplicated as by_sets

        return by_sets(df, id_col, text_col, jaccard)
    rows = near_duplicates(df, id_col, text_col)
    own = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    keys = rows.groupBy("component_id", own.alias("own"), column(id_col).alias("id"), F.col("text_key").alias("k")).agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "n")).alias("first")
    winners = keys.groupBy("component_id", "own").agg(first).select("first.id", "first.k", "first.n", F.lit(1).alias("copies"))
    return pick(df, winners, id_col, text_col)
