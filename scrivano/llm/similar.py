"""Near-duplicates by similarity of shingle sets: SimHash with pigeonring filtering, then what lies beyond its bits.

Two texts link when the sets of their five-word shingles have Jaccard similarity 0.8 or more; a group
is what links reach.  Shingles are 64-bit hashes of lower-cased words; a shorter text is one shingle.
Texts with one set of shingles are one node.

Fingerprints of sets at 0.8 differ in about 10 of 64 bits and in up to 17, more than any chain of segments
can prune by.  So the search has three steps, each of which compares only what no link has joined yet:

1. simhash.links on the sets' fingerprints: pairs within 3 bits.
2. Hubs.  All shingles have one fixed order, common ones last.  A text of n shingles shows its first
   n - ceil(0.8 n) + 1: two texts at 0.8 share 0.8 of the larger set, so that they share one of those they
   show.  Each text is compared with one hub of each shingle it shows, the text that shows it first: in a
   family of copies that were changed apart, the one that was changed least.  Hubs cost a row a shingle
   shown, whatever the family's size, and join the family.
3. The rest: pairs of texts that still are apart and show one shingle, unless sizes, the shingle's places or
   the sets' parities rule 0.8 out.  The shingle's largest group does not meet itself.  No pair is lost,
   whatever the order is.

All pairs found are held against whole sets before they link.

Defined results: null and blank texts are one group; else as in simhash.deduplicated.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from . import simhash
from .common import as_bytes, column, discard, pick, small_batches, text_key, written
from .simhash import SEED, components

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BUCKET_BITS = 17
#: A bucket with more than this share of all shingles holds one that very many texts have: its rows are salted.
HOT_SHARE, SALTS = 1024, 16
#: Words of 64 bits that a set's parities take.
PARITIES = 8
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles."""
    found = raw.lower().split()  # of bytes, both know ASCII alone
    if not found:
        return np.empty(0, "<u8")
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in found), "<u8", len(found))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, "<u8")
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * _FACTOR + h[k : k + n]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return np.unique(out ^ (out >> np.uint64(30)))


def node(grams: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).view("<i8"))


def print_of(grams: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set."""
    if not len(grams):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(grams), simhash.CHUNK):
        ones += simhash.majority(grams[lo : lo + simhash.CHUNK])
    return simhash.folded(ones, len(grams))


def parity(grams: np.ndarray) -> list[int]:
    """PARITIES signed words: bit i tells whether the set has an odd number of hashes that fall on i.

    A hash that one set has and another has not changes one bit, so that sets differ in as many hashes as in bits, or more.
    """
    odd = np.bincount((grams % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def shown(n: int, least: tuple[int, int] = LEAST) -> int:
    """How many shingles a text of n shows."""
    return n - (least[0] * n + least[1] - 1) // least[1] + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def _nodes(batches):
    """Each text's node and fingerprint; after a task's last text, its counts of shingles by bucket."""
    counts, kind = np.zeros(1 << BUCKET_BITS, np.int64), pa.null()
    names = ["id", "k", "node", "fp", "parity", "bucket", "n"]
    for b in batches:
        kind, sets = b.schema.field(0).type, [shingles(t) for t in b.column("raw").to_pylist()]
        for g in sets:
            np.add.at(counts, (g >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        made = pa.array(map(node, sets), pa.int64()), pa.array(map(print_of, sets), pa.int64()), pa.array(map(parity, sets), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int64())], names=names)
    at = np.flatnonzero(counts)
    if len(at):
        none = [pa.nulls(len(at), t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int32()), pa.array(counts[at])], names=names)


def _prefixes(counts: np.ndarray, least: tuple[int, int]):
    hot = counts > max(counts.sum() // HOT_SHARE, 1)

    def run(batches):
        seen = set()  # names only, of one task's texts
        for b in batches:
            parts = []
            for t in b.column("raw").to_pylist():
                g = shingles(t)
                name = node(g)
                if len(g) and name not in seen:
                    seen.add(name)
                    first = g[np.lexsort((g, counts[(g >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))[: shown(len(g), least)]]
                    parts.append((name, len(g), first))
            if parts:
                sizes = [len(p[2]) for p in parts]
                grams = np.concatenate([p[2] for p in parts])
                names = np.repeat(np.array([p[0] for p in parts], np.int64), sizes)
                salts = np.where(hot[(grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], 1 + names % SALTS, 0).astype(np.int32)
                columns = (
                    names,
                    np.repeat(np.array([p[1] for p in parts], np.int32), sizes),
                    np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]),
                    grams.view("<i8"),
                    salts,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "n", "at", "gram", "salt"])

    return run


def _compared(least: tuple[int, int]):
    """Pairs (a, b) whose texts x and y are similar.  Rows of one b lie side by side, so its set is made once."""

    def run(batches):
        last, held = None, None
        for b in batches:
            near = []
            for name, x, y in zip(b.column("b").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist()):
                if held is None or name != last:
                    last, held = name, shingles(y)
                near.append(similar(shingles(x), held, least))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def shows(raw: DataFrame, buckets: DataFrame, least: tuple[int, int] = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """gram, node, n, at, hub: each shingle that the texts in column raw show, with its place, of those that two texts show; and
    the tables to discard after it.

    hub (at, node, n) is the text that shows it first.  One shuffle deals out all that is shown; little of it stays.  Rows of a
    shingle that very many texts have are dealt out by salts, whose ends meet in a few rows before they go back to them.
    """
    rows = buckets.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most 2^17
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    every = raw.mapInArrow(_prefixes(counts, least), "node long, n int, at int, gram long, salt int")
    same = Window.partitionBy("gram", "salt")
    marked = every.select("*", F.min("node").over(same).alias("low"), F.max("node").over(same).alias("high"), F.min(F.struct("at", "node", "n")).over(same).alias("hub"))
    kept = written(marked.where("salt > 0 OR low <> high").distinct())
    names = ("gram", "node", "n", "at", "hub")
    salted = kept.where("salt > 0")
    ends = salted.groupBy("gram", "salt").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("hub").alias("hub"))
    whole = ends.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("hub").alias("hub")).where("low <> high")
    back = ends.select("gram", "salt").join(whole.select("gram", "hub").hint("merge"), "gram")
    hot = written(salted.drop("hub").join(back.hint("merge"), ["gram", "salt"]).select(*names))
    return kept.where("salt = 0").select(*names).unionByName(hot), [kept, hot]


def _alike(least: tuple[int, int]):
    """Whether parities leave the similarity asked for possible: sets of a and b hashes at least num/den alike differ in (den - num) / (den + num) of a + b at most."""
    num, den = least
    bits = reduce(add, (F.bit_count(F.col(f"ap{i}").bitwiseXOR(F.col(f"bp{i}"))) for i in range(PARITIES)))
    return (num + den) * bits <= (den - num) * (F.col("an").cast("long") + F.col("bn").cast("long"))


def _possible(least: tuple[int, int]):
    """Whether sizes an, bn and places aat, bat of a shared shingle leave the similarity asked for possible."""
    num, den = least
    a, b = F.col("an").cast("long"), F.col("bn").cast("long")
    most = F.least(a - F.col("aat"), b - F.col("bat"))  # the shingle is the first one shared, or an earlier one makes the pair
    return (den * a >= num * b) & (den * b >= num * a) & ((num + den) * most >= num * (a + b))


def _sided(held: DataFrame, side: str) -> DataFrame:
    return held.select("gram", *(F.col(c).alias(side + c) for c in held.columns if c != "gram"))


def hubs(held: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """Pairs (a, b) of each node and the hubs of the shingles it shows."""
    both = held.select(*(F.col(c).alias("a" + c) for c in ("node", "n", "at")), *(F.col(f"hub.{c}").alias("b" + c) for c in ("node", "n", "at")))
    both = both.where((F.col("anode") != F.col("bnode")) & _possible(least))
    return both.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).distinct()


#: Sizes of sets that may be at least num/den alike differ by one step of this scale at most; the scale is a little wider than that.
def _step(n: str, least: tuple[int, int]):
    return F.floor(F.log(F.col(n)) / (np.log(least[1] / least[0]) * (1 + 1e-9))).cast("int")


def apart(held: DataFrame, found: DataFrame, nodes: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """Pairs (a, b), a < b, all at the similarity asked for among them, that the components found (node, root) do not join.  nodes: node, parity.

    Of a shingle's rows those of its largest component do not meet each other: the rest meet all, by sizes that may be alike.
    """
    rooted = held.drop("hub").join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("gram", "root").agg(F.count("*").alias("rows"))
    several = sizes.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("rows", "root")).alias("most")).where("low <> high")
    several = several.select("gram", F.col("most.root").alias("largest"))
    odd = nodes.groupBy("node").agg(F.first("parity").alias("parity"))  # one set, one parity
    rooted = rooted.join(several.hint("merge"), "gram").join(odd.hint("merge"), "node")
    rooted = rooted.withColumns({"outer": F.col("root") != F.col("largest"), "step": _step("n", least)})
    rooted = written(rooted.select(*held.drop("hub").columns, "root", "outer", "step", *(F.col("parity")[i].alias(f"p{i}") for i in range(PARITIES))))
    a, b = _sided(rooted.where("outer"), "a"), _sided(rooted, "b")
    near = a.withColumn("bstep", F.explode(F.array(*(F.col("astep") + k for k in (-1, 0, 1)))))
    once = ~F.col("bouter") | (F.col("anode") < F.col("bnode"))
    both = near.hint("merge").join(b, ["gram", "bstep"]).where(once & (F.col("aroot") != F.col("broot")) & _possible(least) & _alike(least))
    out = written(both.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).distinct())
    discard(rooted)
    return out


def links(df: DataFrame, nodes: DataFrame, buckets: DataFrame, id_col: str, text_col: str, least: tuple[int, int] = LEAST) -> DataFrame:
    """Pairs (a, b) of similar nodes that reach what all such pairs reach.  nodes: id, k, node, fp, parity of df's rows; buckets: counts of their shingles."""
    held, tables = shows(df.select(as_bytes(column(text_col)).alias("raw")), buckets, least)
    prints = nodes.select("fp", "node").distinct()  # copies are one row before a fingerprint's rows meet
    of_print = prints.groupBy("fp").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    near = simhash.links(of_print.select("fp"))
    ends = near.join(of_print.select(F.col("fp").alias("a"), F.col("low").alias("x")).hint("merge"), "a").join(of_print.select(F.col("fp").alias("b"), F.col("low").alias("y")).hint("merge"), "b").select("x", "y")
    alike = prints.join(of_print.where("low <> high").hint("merge"), "fp").where("node <> low").select(F.col("low").alias("x"), F.col("node").alias("y"))
    by_print = ends.unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    early = written(by_print.unionByName(hubs(held, least)).distinct())

    # one text of each node that shows a shared shingle or has a near fingerprint: texts take less disk than their sets, which no code can shorten
    wanted = held.select("node").unionByName(early.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    alike = nodes.groupBy("node", "id", "k").agg(F.count("*").alias("rows"))
    one = alike.groupBy("node").agg(F.min(F.struct("k", F.col("id").isNull().alias("none"), "id", "rows")).alias("one"))
    one = one.join(wanted.hint("merge"), "node").select("node", F.col("one.k").alias("k"), F.col("one.id").alias("id"), F.col("one.rows").alias("rows"))
    texts = df.select(column(id_col).alias("t_id"), text_key(column(text_col)).alias("t_k"), as_bytes(column(text_col)).alias("raw"))
    kept = texts.join(one.hint("merge"), F.col("t_id").eqNullSafe(F.col("id")) & (F.col("t_k") == F.col("k"))).select("node", "raw", "rows")
    # only rows alike in id and text need a second shuffle, to leave one of them
    kept = kept.where("rows = 1").select("node", "raw").unionByName(kept.where("rows > 1").select("node", "raw").dropDuplicates(["node"]))
    whole = written(kept)

    def compared(pairs: DataFrame) -> DataFrame:
        x, y = (whole.select(F.col("node").alias(n), F.col("raw").alias(c)) for n, c in (("a", "x"), ("b", "y")))
        both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y")
        return written(both.mapInArrow(_compared(least), "a long, b long"))

    first = compared(early)
    reached = written(components(first))
    rest = apart(held, reached, nodes, least)
    more = compared(rest)
    for t in (*tables, early, whole, reached, rest):
        discard(t)
    return first.unionByName(more)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: tuple[int, int] = LEAST) -> DataFrame:
    """One row of each group: the one with the smallest id (null last), then the smallest text key."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    raw = df.select(column(id_col).alias("id"), text_key(column(text_col)).alias("k"), as_bytes(column(text_col)).alias("raw"))
    kinds = StructType().add("id", kind).add("k", "long").add("node", "long").add("fp", "long").add("parity", ArrayType(LongType())).add("bucket", "integer").add("n", "long")
    both = written(raw.mapInArrow(_nodes, kinds))
    nodes, buckets = both.where("bucket is null").select("id", "k", "node", "fp", "parity"), both.where("bucket is not null").select("bucket", "n")
    found = components(links(df, nodes, buckets, id_col, text_col, least))
    keys = nodes.groupBy("node", "id", "k").agg(F.count("*").alias("n"))
    low = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "n")).alias("first")
    classes = keys.groupBy("node").agg(low)
    grouped = classes.join(found.hint("merge"), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return pick(df, grouped.select("first.id", "first.k", "first.n", F.lit(1).alias("copies")), id_col, text_col)
