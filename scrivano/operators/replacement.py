"""Edits put into a paragraph's segments, so that what stays keeps its formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.diff import dealt, tokens


def preserve(text: Column) -> Column:
    """Whether outer or double blanks need the attribute that keeps them."""
    return text.rlike(r"(?U)^\s|\s$|  ")


def replaced(df: DataFrame, segs: str = "segments", start: str = "start", end: str = "end", new: str = "new_text") -> DataFrame:
    """df with texts, array<struct<text, preserve>>: the segments' texts after [start, end) became new.

    For ranges that range_code clears, which hold text alone.  Unchanged words stay in their segments,
    changed ones go to the segment of the first character they replace, added ones follow what stands
    before them.
    """
    lo, hi = F.col(start), F.col(end)
    hit = lambda s: (s["kind"] == "text") & (s["end"] > s["start"]) & (s["start"] < hi) & (s["end"] > lo)
    touched = F.filter(segs, hit)
    inside = F.transform(touched, lambda s: F.substring(s["text"], F.greatest(lo - s["start"], F.lit(0)) + 1, F.least(s["end"], hi) - F.greatest(s["start"], lo)))
    ends = F.transform(touched, lambda s: F.least(s["end"], hi) - lo)

    def text(s: Column) -> Column:
        nth = F.array_position(F.transform(touched, lambda t: t["start"]), s["start"]).cast("int")
        before = F.substring(s["text"], F.lit(1), F.greatest(lo - s["start"], F.lit(0)))
        after = F.when(s["end"] > hi, F.substring(s["text"], hi - s["start"] + 1, s["end"] - hi)).otherwise("")
        return F.when(hit(s), F.concat(before, F.get(F.col("_dealt"), nth - 1), after)).otherwise(s["text"])

    out = df.withColumn("_dealt", dealt(tokens(F.array_join(inside, "")), tokens(F.col(new)), ends))
    return out.withColumn("texts", F.transform(F.transform(segs, text), lambda t: F.struct(t.alias("text"), preserve(t).alias("preserve")))).drop("_dealt")
