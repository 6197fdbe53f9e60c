"""Salient terms of texts: names first, then capitals that begin sentences, then frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import COMMON_INITIAL, STOP

INITIAL = r"(?:^|[.!?:;\n•\-]\s*)([A-Z][A-Za-z0-9+#.]*[A-Za-z0-9+#])"
LIMIT = 40


def _times(text: Column, term: Column) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term))


def salient_terms(df: DataFrame, id_col: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id_col, rank, term: the first `limit` terms of each text, each normalised form once.

    Names come by how often the text holds them, then by code point; initial capitals by place; words of
    four letters and more that stand there twice or more by count, then by first place.
    """
    text = F.col(text_col)
    row = lambda tier, term, a, b: F.struct(F.lit(tier).alias("tier"), a.cast("long").alias("a"), b.cast("long").alias("b"), term.alias("term"))
    names = F.transform(T.named_terms(text), lambda t: row(0, t, -_times(text, t), F.lit(0)))
    starts = F.transform(T.every(text, INITIAL, 1), lambda t, i: row(1, t, i, F.lit(0)))
    starts = F.filter(starts, lambda r: ~F.lower(r["term"]).isin(*COMMON_INITIAL))
    named = df.select(id_col, F.explode(F.concat(names, starts)).alias("r"))
    named = named.where(~F.lower("r.term").isin(*STOP) & (F.length(T.normalize_term(F.col("r.term"))) >= 2))
    words = df.select(id_col, F.posexplode(F.transform(T.every(text, T.WORD), F.lower)).alias("pos", "word"))
    words = words.where((F.length("word") > 3) & ~F.col("word").isin(*STOP)).groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("at")).where("n >= 2")
    every = named.unionByName(words.select(id_col, row(2, F.col("word"), -F.col("n"), F.col("at")).alias("r")))
    once = every.groupBy(id_col, T.normalize_term(F.col("r.term")).alias("key")).agg(F.min("r").alias("r"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("r"))
    return once.select(id_col, rank.alias("rank"), F.col("r.term").alias("term")).where(F.col("rank") <= limit)
