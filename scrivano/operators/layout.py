"""Layout comparison of two versions of a document by its words and boxes.

words: case, ord, text, page, x0, top, bottom, size, font, color, marked; marked words stand in an edited
place and are not compared.  boxes: case, page, kind (image or graphic), x0, top, x1, bottom.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import alignment

POSITION, SIZE = 0.75, 0.1  # points
FIELDS = ("text", "page", "x0", "top", "size", "font", "color")


def aligned(before: DataFrame, after: DataFrame, keep: Callable[[DataFrame], DataFrame] = DataFrame.cache) -> DataFrame:
    """case, a and b (structs of ord and FIELDS): words that are not marked, each with the other side's; null where that lacks it.

    keep: how what is read several times is kept, as alignment.pairs() takes it.
    """
    plain = lambda d: d.where("not coalesce(marked, false)")
    pairs = alignment.pairs(plain(before), plain(after), keep)
    return alignment.sides(plain(before), plain(after), pairs, FIELDS)


def word_findings(pairs: DataFrame, first_marked: DataFrame | None = None, position: float = POSITION, size: float = SIZE) -> DataFrame:
    """case, code, severity, n.  first_marked (case, first) is the first edited word's ord; without one, all lie before."""
    if first_marked is None:
        pairs = pairs.withColumn("first", F.lit(None).cast("int"))
    else:
        pairs = pairs.join(first_marked, "case", "left")
    near = lambda f, most: F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) <= most
    plain = lambda side: F.regexp_replace(F.coalesce(f"{side}.font", F.lit("")), r"^[^+]*\+", "")
    page = F.col("a.page") == F.col("b.page")
    stable = page & near("x0", position) & near("top", position)
    early = F.col("first").isNull() | (F.col("a.ord") < F.col("first"))
    line = Window.partitionBy("case", "a.page", F.bround("a.top", 1)).orderBy("a.ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = pairs.where("a is not null and b is not null").withColumns({"la": F.first("a").over(line), "lb": F.first("b").over(line)})
    shift = F.abs((F.col("b.x0") - F.col("lb.x0")) - (F.col("a.x0") - F.col("la.x0")))
    broken = (F.col("b.page") != F.col("lb.page")) | (F.abs(F.col("b.top") - F.col("lb.top")) > position) | (shift > position)
    lines = lead.where(broken).groupBy("case").agg(F.count_distinct("a.page", F.bround("a.top", 1)).alias("broken"))
    n = lambda c: F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & c)
    counts = pairs.groupBy("case").agg(
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
        n((plain("a") != plain("b")) | ~near("size", size)).alias("fonts"),
        n(~F.col("a.color").eqNullSafe(F.col("b.color"))).alias("colors"),
        n(~stable & early).alias("early"),
        n(~page).alias("pages"),
        n(~stable).alias("moved"),
    ).join(lines, "case", "left")
    flow = F.when((F.col("pages") == 0) & (F.col("early") == 0), F.col("moved")).otherwise(0)
    rules = (
        ("context_text_render_mismatch", "warning", F.col("unmatched")), ("font_changed", "warning", F.col("fonts")), ("text_color_changed", "warning", F.col("colors")),
        ("shift_before_edit", "warning", F.col("early")), ("page_flow_changed", "warning", F.col("pages")), ("vertical_reflow", "info", flow),
        ("line_wrap_changed", "warning", F.coalesce("broken", F.lit(0))),
    )
    rows = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), k.cast("long").alias("n")) for c, s, k in rules))
    return counts.select("case", F.explode(rows).alias("f")).select("case", "f.*").where("n > 0")


def page_shifts(pairs: DataFrame, position: float = POSITION) -> DataFrame:
    """case, page, shift: median move of the words that moved straight up or down."""
    straight = (F.col("a.page") == F.col("b.page")) & (F.abs(F.col("a.x0") - F.col("b.x0")) <= position) & (F.abs(F.col("a.top") - F.col("b.top")) > position)
    return pairs.where(straight).groupBy("case", F.col("a.page").alias("page")).agg(F.median(F.col("b.top") - F.col("a.top")).alias("shift"))


def marked_lines(words: DataFrame) -> DataFrame:
    """case, lines: how many lines hold words of edited places."""
    return words.where("marked").groupBy("case").agg(F.count_distinct("page", F.bround("top", 1)).alias("lines"))


def first_marked(words: DataFrame) -> DataFrame:
    return words.where("marked").groupBy("case").agg(F.min("ord").alias("first"))


#: How far a word may reach beyond its page, and the bounds of the marker colour (red and blue, green).
OUTSIDE, MARKER_HIGH, MARKER_LOW = 0.5, 0.97, 0.03


def is_marker(color: Column) -> Column:
    """Whether an array of red, green and blue from 0 to 1 is the colour that marks edited places."""
    r, g, b = (F.get(color, F.lit(i)) for i in range(3))
    return F.coalesce((F.size(color) == 3) & (r > MARKER_HIGH) & (g < MARKER_LOW) & (b > MARKER_HIGH), F.lit(False))


def page_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """case, code, severity, n of pages (case, page, width, height, images, graphics, words: array<struct<x0, x1, bottom>>)."""

    def counted(pages: DataFrame, side: str) -> DataFrame:
        beyond = lambda w: (w["x0"] < -OUTSIDE) | (w["x1"] > F.col("width") + OUTSIDE) | (w["bottom"] > F.col("height") + OUTSIDE)
        blank = (F.size("words") == 0) & (F.col("images") == 0) & (F.col("graphics") == 0)
        return pages.groupBy("case").agg(F.count("*").alias(f"pages_{side}"), F.count_if(blank).alias(f"blank_{side}"), F.sum(F.size(F.filter("words", beyond))).alias(f"beyond_{side}"))

    both = counted(before, "a").join(counted(after, "b"), "case", "full").na.fill(0)
    more = lambda what: F.greatest(F.col(f"{what}_b") - F.col(f"{what}_a"), F.lit(0))
    rules = (("page_count_changed", "warning", F.abs(F.col("pages_b") - F.col("pages_a"))), ("blank_page_introduced", "error", more("blank")), ("text_outside_page", "warning", more("beyond")))
    rows = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), n.cast("long").alias("n")) for c, s, n in rules))
    return both.select("case", F.explode(rows).alias("f")).select("case", "f.*").where("n > 0")


#: Fixed value: the tolerance of vector graphics in points; images are compared in whole points.
GRAPHICS = 0.5


def reflow_tops(pairs: DataFrame, position: float = POSITION) -> DataFrame:
    """case, page, top: where a page's reflow begins, the least top of words of either side that did not stay in place."""
    near = lambda f: F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) <= position
    moved = pairs.where("a IS NOT NULL AND b IS NOT NULL").where(~((F.col("a.page") == F.col("b.page")) & near("x0") & near("top")))
    ends = moved.select("case", F.explode(F.array(*(F.struct(F.col(f"{s}.page").alias("page"), F.col(f"{s}.top").alias("top")) for s in ("a", "b")))).alias("e"))
    return ends.groupBy("case", "e.page").agg(F.min("e.top").alias("top"))


def steps(value: Column, step: float) -> Column:
    """A length in whole steps, halves to the even one."""
    return F.bround(value / step).cast("long")


def box_findings(before: DataFrame, after: DataFrame, pages: DataFrame, reflow: DataFrame, graphics: float = GRAPHICS) -> DataFrame:
    """case, code, severity, n of the images and graphics of two versions.

    pages: case, a and b, how many pages either side has.  reflow: case, page, top of reflow_tops().
    Bags of boxes are compared by counting each rounded form on both sides, so no page's boxes meet in one row: images of
    a case by their sizes, where none is missing; graphics by page, on the pages that both sides have, by place and size
    where the page did not reflow, else by size alone in double steps.
    """
    both = before.withColumn("one", F.lit(1)).unionByName(after.withColumn("one", F.lit(-1)))
    size = lambda step: (steps(F.col("x1") - F.col("x0"), step).alias("w"), steps(F.col("bottom") - F.col("top"), step).alias("h"))
    left = F.sum("one").alias("left")  # of one form, how many more there are before

    images = both.where("kind = 'image'")
    missing = images.groupBy("case").agg(F.greatest(left, F.lit(0)).alias("missing"))
    sized = images.groupBy("case", *size(1.0)).agg(left).where("left <> 0").groupBy("case").agg(F.sum(F.abs("left")).alias("sized"))
    pictures = missing.join(sized, "case", "left").select("case", "missing", F.when(F.col("missing") == 0, F.col("sized")).alias("sized"))

    drawn = both.where("kind = 'graphic'").join(pages, "case").where(F.col("page") < F.least("a", "b"))
    flowed = drawn.join(reflow.select("case", "page", F.lit(True).alias("flowed")), ["case", "page"], "left").withColumn("flowed", F.coalesce("flowed", F.lit(False)))
    place = [F.when(~F.col("flowed"), steps(F.col(c), graphics)).alias(f"k{c}") for c in ("x0", "top", "x1", "bottom")]
    sizes = [F.when(F.col("flowed"), c).alias(f"k{i}") for i, c in enumerate(size(2 * graphics))]
    changed = flowed.groupBy("case", "page", "flowed", *place, *sizes).agg(left).where("left <> 0").select("case", "page", "flowed").distinct()
    shapes = changed.groupBy("case").agg(F.count_if(~F.col("flowed")).alias("still"), F.count_if("flowed").alias("flowed"))

    rules = (("image_missing", "error", "missing"), ("image_size_changed", "warning", "sized"), ("graphics_changed", "warning", "still"), ("graphics_changed_on_reflowed_page", "info", "flowed"))
    rows = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.col(n).cast("long").alias("n")) for c, s, n in rules))
    found = pictures.join(shapes, "case", "full").select("case", F.explode(rows).alias("f")).select("case", "f.*")
    return found.where("n > 0")


def edited_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """case, code, severity, n: cases whose edited places fill another number of lines, with the number they fill now."""
    both = marked_lines(before).withColumnRenamed("lines", "a").join(marked_lines(after).withColumnRenamed("lines", "b"), "case", "full").na.fill(0, ["a", "b"])
    return other_lines(both)


def other_lines(counts: DataFrame) -> DataFrame:
    """The same of counts: case, a and b, how many lines edited places fill on either side."""
    return counts.where("a <> b").select("case", F.lit("edited_text_line_count_changed").alias("code"), F.lit("info").alias("severity"), F.col("b").cast("long").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """words with nth, their place in the case from 0: places in a page by a window, pages' places by their counts.

    No case is sorted as a whole: what is sorted is a page, and of a case the counts of its pages.
    """
    upto = F.coalesce(F.sum("n").over(Window.partitionBy("case").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = words.groupBy("case", "page").agg(F.count("*").alias("n")).select("case", "page", upto.alias("start"))
    own = F.row_number().over(Window.partitionBy("case", "page").orderBy("ord")) - 1
    return words.withColumn("own", own).join(starts, ["case", "page"]).withColumn("nth", F.col("start") + F.col("own")).drop("own", "start")


#: Fixed value: how far a word of the marked copy may lie from the plain copy's.
RENDERED = 0.01


def render_findings(plain: DataFrame, marked: DataFrame, position: float = RENDERED) -> DataFrame:
    """case, code, severity, n: words that two renderings of one text, without and with marks, do not have in one place.

    The n-th word is held against the n-th word; words beyond the shorter list count too.
    """
    of = lambda d, s: numbered(d).select("case", "nth", F.struct("text", "page", "x0", "top").alias(s))
    near = lambda f: F.abs(F.col(f"p.{f}") - F.col(f"m.{f}")) <= position
    same = (F.col("p.text") == F.col("m.text")) & (F.col("p.page") == F.col("m.page")) & near("x0") & near("top")
    off = of(plain, "p").join(of(marked, "m"), ["case", "nth"], "full").where(~F.coalesce(same, F.lit(False)))
    return _inconsistent(off.groupBy("case").agg(F.count("*").alias("n")))


def _inconsistent(counts: DataFrame) -> DataFrame:
    return counts.select("case", F.lit("marker_render_inconsistent").alias("code"), F.lit("warning").alias("severity"), "n")


def rendered_rows(both: DataFrame, position: float = RENDERED) -> DataFrame:
    """The same of documents that fit a row: case, p and m, either rendering's words (text, page, x0, top) in order.  Nothing is shuffled."""
    near = lambda p, m, f: F.abs(p[f] - m[f]) <= position
    same = lambda p, m: F.coalesce((p["text"] == m["text"]) & (p["page"] == m["page"]) & near(p, m, "x0") & near(p, m, "top"), F.lit(False))
    off = F.size(F.filter(F.zip_with("p", "m", same), lambda s: ~s)).cast("long")
    return _inconsistent(both.select("case", off.alias("n")).where("n > 0"))


def gate(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """case, status, findings, worst of gate D: failed with an error, to be reviewed with a warning, else passed; worst is the code of the
    gravest findings that most of them have, ties by name.  cases: case; findings: case, code, severity, n of all of this module and raster's."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    grave = F.max(F.struct(rank.alias("rank"), F.col("n").alias("n"), F.transform(F.split("code", ""), lambda c: -F.ascii(c)).alias("order"), "code")).alias("top")
    found = findings.groupBy("case").agg(F.count("*").alias("findings"), grave)
    status = F.when(F.col("top.rank") == 2, "FAIL").when(F.col("top.rank") == 1, "REVIEW_REQUIRED").otherwise("PASS")
    return cases.select("case").join(found, "case", "left").select("case", status.alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"), F.col("top.code").alias("worst"))
