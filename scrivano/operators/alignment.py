"""Alignment of two word sequences of a case: which word of one side is which of the other.

Short cases are aligned by a longest common subsequence, exactly.  Long ones are first cut at anchors: words that stand
once on either side (found by one grouping over all words), of which the longest run that rises on both sides counts
(only the places of a case's anchors meet in one row, never its words).  Between two anchors, words that stand once
there are anchors in turn; what is left between anchors is aligned exactly.  So a word is compared only with the words
of its own gap.

before and after have case, ord and text; ord is unique in a case.  A case on one side alone has no pairs; null texts
match nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions import lcs

#: Words of a side up to which a case, or a gap, needs no anchors; and up to which its words fit a row.
SHORT, ROW = 1024, 1 << 16
ROUNDS = 2

PLACES = ArrayType(StructType().add("i", IntegerType()).add("j", IntegerType()))


@F.pandas_udf(PLACES)
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Places of a longest common subsequence of two arrays."""
    return pd.Series([[{"i": i, "j": j} for i, j in lcs.matched(list(x), list(y))] for x, y in zip(a, b)])


def anchored(x: list, y: list, short: int = SHORT, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """What pairs() gives of a case whose words fit a row: places aligned, rising on both sides."""
    if max(len(x), len(y)) <= short:
        return lcs.matched(x, y)
    at, to = lcs.shared(x, y)  # no other word is an anchor or has a partner
    x, y = [x[i] for i in at], [y[j] for j in to]
    if x == y:
        return list(zip(at, to))
    out, gaps = [], [(0, len(x), 0, len(y))]
    for _ in range(rounds):
        left = []
        for a, b, c, d in gaps:
            many, most = Counter(x[a:b]), Counter(y[c:d])
            place = {w: j for j, w in enumerate(y[c:d], c)}
            once = [(i, place[w]) for i, w in enumerate(x[a:b], a) if many[w] == 1 and most[w] == 1]
            found = [once[k] for k in lcs.rising([j for _, j in once])]
            out += found
            for i, j in [*found, (b, d)]:
                left.append((a, i, c, j))
                a, c = i + 1, j + 1
        gaps = [g for g in left if g[0] < g[1] and g[2] < g[3]]
    for a, b, c, d in gaps:
        out += [(a + i, c + j) for i, j in lcs.matched(x[a:b], y[c:d])]
    return sorted((at[i], to[j]) for i, j in out)


@F.pandas_udf(ArrayType(IntegerType()))
def rising(values: pd.Series) -> pd.Series:
    return pd.Series([lcs.rising(list(v)) for v in values])


def _exact(words: DataFrame, *keys: str) -> DataFrame:
    """keys, a, b: the ords of words of one group that are aligned."""
    listed = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("ord", "text"))))
    groups = words.where("text IS NOT NULL").groupBy(*keys).agg(listed("a").alias("wa"), listed("b").alias("wb")).where((F.size("wa") > 0) & (F.size("wb") > 0))
    pairs = groups.withColumn("p", F.explode(common(F.col("wa")["text"], F.col("wb")["text"])))
    return pairs.select(*keys, F.get(F.col("wa")["ord"], F.col("p.i")).alias("a"), F.get(F.col("wb")["ord"], F.col("p.j")).alias("b"))


def _anchors(words: DataFrame) -> DataFrame:
    """case, gap, a, b: words that stand once on either side of a gap, in the longest run that rises on both."""
    n = lambda side: F.count_if(F.col("side") == side)
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("ord")))
    once = words.where("text IS NOT NULL").groupBy("case", "gap", "text").agg(n("a").alias("na"), n("b").alias("nb"), at("a").alias("a"), at("b").alias("b")).where("na = 1 AND nb = 1")
    runs = once.groupBy("case", "gap").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("p"))
    kept = runs.withColumn("k", F.explode(rising(F.col("p")["b"])))
    return kept.select("case", "gap", F.get(F.col("p")["a"], F.col("k")).alias("a"), F.get(F.col("p")["b"], F.col("k")).alias("b"))


def pairs(before: DataFrame, after: DataFrame, keep: Callable[[DataFrame], DataFrame], short: int = SHORT, rounds: int = ROUNDS) -> DataFrame:
    """case, a, b: the ords of aligned words.

    keep(df) gives df to read several times: a stored table on a cluster.
    """
    side = lambda d, s: d.select("case", F.lit(s).alias("side"), "ord", "text")
    words = keep(side(before, "a").unionByName(side(after, "b")))
    sizes = words.groupBy("case").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    long = sizes.where(F.greatest("na", "nb") > short).select("case")
    out = _exact(words.join(long, "case", "left_anti"), "case")
    rest = words.join(long, "case", "left_semi").withColumns({"gap": F.lit(0), "on": F.lit(False)})
    order = Window.partitionBy("case", "side").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(rounds):
        found = keep(_anchors(rest.where("NOT on")))
        out = out.unionByName(found.select("case", "a", "b"))
        marks = found.select("case", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("ord")), F.struct(F.lit("b").alias("side"), F.col("b").alias("ord")))).alias("m")).select("case", "m.*", F.lit(True).alias("new"))
        rest = rest.join(marks, ["case", "side", "ord"], "left").withColumn("on", F.col("on") | F.coalesce("new", F.lit(False)))
        # both sides have the same anchors in the same order, so their count names the gap that a word lies in
        rest = keep(rest.withColumn("gap", F.sum(F.col("on").cast("int")).over(order).cast("int")).select("case", "side", "ord", "text", "gap", "on"))
    return out.unionByName(_exact(rest.where("NOT on"), "case", "gap").select("case", "a", "b"))


def sides(before: DataFrame, after: DataFrame, aligned: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """case, a and b: structs of ord and fields; b is null for a word that after lacks, a for one that before lacks."""
    of = lambda d, s: d.select("case", F.col("ord").alias(s), F.struct("ord", *fields).alias(f"w{s}"))
    left = of(before, "a").join(aligned, ["case", "a"], "left")
    return left.join(of(after, "b"), ["case", "b"], "full").select("case", F.col("wa").alias("a"), F.col("wb").alias("b"))


def moved(unmatched: DataFrame) -> DataFrame:
    """case, a, b of sides()'s words without a partner that stand elsewhere on the other side: removed and added words of
    one text, the n-th of one with the n-th of the other."""
    nth: Callable[[str], Column] = lambda s: F.row_number().over(Window.partitionBy("case", "text").orderBy("ord"))
    of = lambda s, o: unmatched.where(f"{o} IS NULL").select("case", f"{s}.ord", f"{s}.text").withColumn("n", nth(s)).withColumnRenamed("ord", s)
    return of("a", "b").join(of("b", "a"), ["case", "text", "n"]).select("case", "a", "b")
