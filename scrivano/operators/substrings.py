"""Which texts hold which terms, as plain substrings: an index join by each term's rarest n-gram.

A term can only stand in a text that holds all its n-grams, so it is looked for where its rarest one is.  Of the texts'
n-grams only those that some term has are kept; they are counted, each term picks the one with the fewest texts, texts
and terms meet by that n-gram, and the pairs that meet are checked.  No text meets a term without a shared n-gram, and
neither side is sent whole to anything.  Terms shorter than an n-gram are n-grams of their own length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def candidates(texts: DataFrame, terms: DataFrame, keep: Callable[[DataFrame], DataFrame], id_col: str = "id", text_col: str = "text", term_col: str = "term") -> DataFrame:
    """id_col and term_col: the pairs that must be checked."""
    wanted = terms.select(F.col(term_col).alias("term")).where("term IS NOT NULL AND term <> ''").distinct()
    wanted = wanted.withColumn("n", F.least(F.lit(GRAM), F.length("term")))
    sizes = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # GRAM rows at most
    if not sizes:
        return texts.select(id_col, F.lit(None).cast("string").alias(term_col)).where("false")
    own = F.lit(None).cast("array<string>")
    for n in sizes:
        own = F.when(F.col("n") == n, grams(F.col("term"), n)).otherwise(own)
    needed = keep(wanted.select("term", F.explode(own).alias("gram")))
    every = F.flatten(F.array(*(grams(F.col("body"), n) for n in sizes)))
    body = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where("id IS NOT NULL AND body IS NOT NULL")
    held = keep(body.select("id", F.explode(every).alias("gram")).join(needed.select("gram").distinct(), "gram", "left_semi").distinct())
    spread = needed.join(held.groupBy("gram").agg(F.count("*").alias("texts")), "gram", "left").na.fill(0, ["texts"])
    rarest = spread.groupBy("term").agg(F.min(F.struct("texts", "gram")).alias("r")).where("r.texts > 0").select("term", F.col("r.gram").alias("gram"))
    return held.join(rarest, "gram").select(F.col("id").alias(id_col), F.col("term").alias(term_col))


def containing(texts: DataFrame, terms: DataFrame, keep: Callable[[DataFrame], DataFrame] = DataFrame.cache, id_col: str = "id", text_col: str = "text", term_col: str = "term") -> DataFrame:
    """id_col and term_col, once each: a text of that id holds the term.

    Case counts.  Null and empty terms, null texts and texts without an id are in no pair.  keep(df) gives df to read
    several times: a stored table on a cluster.
    """
    met = candidates(texts, terms, keep, id_col, text_col, term_col)
    whole = texts.select(F.col(id_col).alias("of"), F.col(text_col).alias("body"))
    return met.join(whole, F.col(id_col) == F.col("of")).where(F.col("body").contains(F.col(term_col))).select(id_col, term_col).distinct()
