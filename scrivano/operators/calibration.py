"""Which thresholds of the visual gate tell good renderings from faulty ones: all settings of a grid from one pass.

A case is judged once, not once a setting: by each criterion it has one largest deviation (or a least one, for what counts
only where a page did not reflow), and which settings it fails follows from where that lies among the thresholds.  Cases are
then counted by those places, and a setting's counts are running sums over them.

areas: case, position, level, area: the largest changed region of a case at a position tolerance and pixel level, as the
tolerance decides what has reflowed; no row where there is none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import rate
from .layout import GRAPHICS, steps

#: The thresholds of the grid.
POSITIONS, LEVELS, AREAS = (0.25, 0.75, 1.5), (32, 48, 96), (4, 16, 64)
_FAR = float("inf")
#: Digits of a deviation: the differences of places that are told apart from a threshold, not those of binary fractions.
DIGITS = 9


def deviations(pairs: DataFrame, first_marked: DataFrame | None = None) -> DataFrame:
    """case, early, wrapped: how far words before the first edited one moved at most, and how far words of a line moved apart.

    pairs: rows of layout.aligned().  Another page is infinitely far.
    """
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    both = both.withColumn("first", F.lit(None).cast("int")) if first_marked is None else both.join(first_marked, "case", "left")
    off = lambda f: F.abs(F.col(f"b.{f}") - F.col(f"a.{f}"))
    moved = F.when(F.col("a.page") != F.col("b.page"), _FAR).otherwise(F.greatest(off("x0"), off("top")))
    line = Window.partitionBy("case", "a.page", F.bround("a.top", 1)).orderBy("a.ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = both.withColumns({"la": F.first("a").over(line), "lb": F.first("b").over(line)})
    spread = F.abs((F.col("b.x0") - F.col("lb.x0")) - (F.col("a.x0") - F.col("la.x0")))
    apart = F.when(F.col("b.page") != F.col("lb.page"), _FAR).otherwise(F.greatest(F.abs(F.col("b.top") - F.col("lb.top")), spread))
    before = F.col("first").isNull() | (F.col("a.ord") < F.col("first"))
    return lead.groupBy("case").agg(F.round(F.max(F.when(before, moved)), DIGITS).alias("early"), F.round(F.max(apart), DIGITS).alias("wrapped"))


def still_pages(before: DataFrame, after: DataFrame, pairs: DataFrame, graphics: float = GRAPHICS) -> DataFrame:
    """case, still: of the pages whose drawn shapes differ, how far words moved on the one where they moved least, 0 without words.

    A difference counts where the page did not reflow: at tolerances of still and more.  before and after: boxes of pages that
    both sides have.
    """
    drawn = before.withColumn("one", F.lit(1)).unionByName(after.withColumn("one", F.lit(-1))).where("kind = 'graphic'")
    keys = [steps(F.col(c), graphics).alias(c) for c in ("x0", "top", "x1", "bottom")]
    changed = drawn.groupBy("case", "page", *keys).agg(F.sum("one").alias("left")).where("left <> 0").select("case", "page").distinct()
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    off = F.when(F.col("a.page") != F.col("b.page"), _FAR).otherwise(F.greatest(F.abs(F.col("b.x0") - F.col("a.x0")), F.abs(F.col("b.top") - F.col("a.top"))))
    on = both.select("case", off.alias("off"), F.explode(F.array_distinct(F.array("a.page", "b.page"))).alias("page")).groupBy("case", "page").agg(F.max("off").alias("off"))
    return changed.join(on, ["case", "page"], "left").groupBy("case").agg(F.min(F.coalesce("off", F.lit(0.0))).alias("still"))


def sweep(cases: DataFrame, areas: DataFrame, positions: Sequence[float] = POSITIONS, levels: Sequence[int] = LEVELS, least: Sequence[int] = AREAS) -> DataFrame:
    """position, level, area, tp, fn, fp, tn, miss_rate, false_alarm_rate of each setting.

    cases: case, faulty, fixed (whether a criterion without threshold fails it), early, wrapped, still (null: never).
    """
    places = F.array(*(F.struct(F.lit(p).alias("position"), F.lit(v).alias("level")) for p in positions for v in levels))
    by = cases.select("*", F.explode(places).alias("s")).select("*", "s.*")
    far = F.coalesce(F.greatest("early", "wrapped") > F.col("position"), F.lit(False)) | F.coalesce(F.col("still") <= F.col("position"), F.lit(False))
    sized = areas.select("case", F.col("position"), "level", F.col("area").alias("largest")).hint("merge")  # as many rows as cases
    by = by.withColumn("plain", F.col("fixed") | far).join(sized, ["case", "position", "level"], "left")
    # how many of the least areas the largest region has
    met = sum((F.when(F.col("largest") >= a, 1).otherwise(0) for a in sorted(least)), F.lit(0))
    cells = by.groupBy("position", "level", "faulty", F.when(F.col("plain"), len(least)).otherwise(met).alias("met")).agg(F.count("*").alias("n"))
    ranks = F.array(*(F.struct(F.lit(k + 1).alias("met"), F.lit(a).alias("area")) for k, a in enumerate(sorted(least))))
    grid = cells.select("position", "level").distinct().select("*", F.inline(ranks))
    grid = grid.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("faulty"), F.lit(0).cast("long").alias("n"))
    every = grid.unionByName(cells.withColumn("area", F.lit(None).cast("int")))
    own = Window.partitionBy("position", "level", "faulty")
    up = own.orderBy(F.col("met").desc()).rangeBetween(Window.unboundedPreceding, 0)
    sums = every.withColumns({"hit": F.sum("n").over(up), "all": F.sum("n").over(own)}).where("area IS NOT NULL")
    pick = lambda faulty, value: F.sum(F.when(F.col("faulty") == faulty, value))
    out = sums.groupBy("position", "level", "area").agg(pick(True, F.col("hit")).alias("tp"), pick(True, F.col("all") - F.col("hit")).alias("fn"), pick(False, F.col("hit")).alias("fp"), pick(False, F.col("all") - F.col("hit")).alias("tn"))
    return out.select("*", rate(F.col("fn"), F.col("tp") + F.col("fn")).alias("miss_rate"), rate(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarm_rate"))
