"""What a model is shown of a document: one JSON line a block, as many as a budget of characters holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that JSON writes with a sign of their own; other control characters get their number.
SIGNS = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
BUDGET = 24_000


def json_string(text: Column) -> Column:
    """A text as a JSON string: characters beyond ASCII stand as they are; null is null."""
    out = text
    for c, sign in SIGNS.items():
        out = F.replace(out, F.lit(c), F.lit(sign))
    rare = out
    for n in range(32):
        if chr(n) not in SIGNS:
            rare = F.replace(rare, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
    out = F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def json_line(**fields: Column) -> Column:
    """An object of texts and booleans, its fields in the order given."""
    pieces = []
    for name, value in fields.items():
        pieces += [F.lit(f'{", " if pieces else ""}"{name}": '), value]
    return F.concat(F.lit("{"), *pieces, F.lit("}"))


def block_line(blocks: DataFrame) -> Column:
    boolean = F.when(blocks["editable"], "true").otherwise("false")
    return json_line(id=json_string(F.col("location_id")), section=json_string(F.col("section")), where=json_string(F.col("container")), editable=boolean, text=json_string(F.col("text")))


def shown(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """path, rank, ord, location_id, line, truncated: the lines of a document that the budget holds, line ends counted between them.

    blocks: path, rank, ord, location_id, section, container, editable, text; blank blocks are left out.  The first line that does not
    fit ends them; truncated says that there is one.  A document of which no line fits has no row.
    """
    told = blocks.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)^\s*$")).withColumn("line", block_line(blocks))
    order = Window.partitionBy("path").orderBy("rank", "ord")
    # what stands before a line that fits are lines that fit, as the sum only grows
    upto = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    whole = F.max("upto").over(Window.partitionBy("path"))
    cut = told.select("path", "rank", "ord", "location_id", "line", upto.alias("upto")).withColumn("truncated", whole > budget)
    return cut.where(F.col("upto") <= budget).drop("upto")


def contexts(lines: DataFrame) -> DataFrame:
    """path, context, truncated: a document's shown lines as one text, which the budget bounds."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "ord", "line")))
    return lines.groupBy("path").agg(F.array_join(F.transform(listed, lambda b: b["line"]), "\n").alias("context"), F.first("truncated").alias("truncated"))
