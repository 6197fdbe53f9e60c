"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

All counts of a text come from one array of its words, bound once.  Windows of five words are
compared by 64-bit hashes, within one text only; a text without repeated windows, found by one
hash set, skips the sort that gives the places of repeated ones.

Defined results: null or blank text has zero counts, fails the base rules (fewer than 10 words) and
is not kept; repeated rows get repeated results; texts are read whole; an empty table gives an
empty result; columns named like the results are replaced, others stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, column, fresh, let, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in that is was for on by with be this at it as are "
    "der die und das von zu den im nicht mit ist ein eine auf für sich "
    "la le les de des et un une que est en dans du au pour qui "
    "el los las del se con su una por para no al"
).split()
#: name, numerator, denominator, least, most, and from how many words on the rule holds.
THRESHOLDS = (
    ("mean word length", "word_chars", "n_words", 2.0, 20.0, 10),
    ("symbols a word", "n_symbols", "n_words", None, 0.1, 10),
    ("upper-case share of letters", "n_upper", "word_chars", None, 0.4, 10),
    ("stop words a word", "n_stop", "n_words", 0.01, None, 100),
    ("repeated lines", "n_dup_lines", "n_lines", None, 0.5, 40),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_upper")


def _repeat_words(w: Column) -> Column:
    """Words of w that stand in a window of five found twice or more."""
    first = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    hashes = F.when(F.size(w) >= WINDOW, first).otherwise(F.array().cast("array<bigint>"))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def found(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, lambda s: let(places(s), covered)))

    return let(hashes, found)


def stats(text: Column) -> Column:
    """Struct of COUNTS, all long."""
    text = F.coalesce(text, F.lit(""))
    size = lambda x: F.length(x)
    without = lambda chars: F.translate(text, chars, "")
    with_word = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")

    def all_of(w: Column, lines: Column) -> Column:
        values = {
            "n_words": F.size(w),
            "word_chars": size(without(WHITE)),
            "n_symbols": size(text) - size(without(SYMBOLS)),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(w),
            "n_lines": F.size(lines),
            "n_stop": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
            "n_upper": size(text) - size(F.regexp_replace(text, "\\p{Lu}+", "")),
        }
        return F.struct(*(values[c].cast("long").alias(c) for c in COUNTS))

    return let(words(text), lambda w: let(with_word, lambda lines: all_of(w, lines)))


def verdict(table=THRESHOLDS) -> Column:
    """The table as one condition on the counts: true if no rule is broken."""

    def broken(top: str, bottom: str, least, most, since: int) -> Column:
        a, b = F.col(top), F.col(bottom)
        out = F.lit(False)
        if least is not None:
            out = out | (a < F.lit(least) * b)
        if most is not None:
            out = out | (a > F.lit(most) * b)
        return (F.col("n_words") >= since) & out

    return ~reduce(lambda x, y: x | y, (broken(*r[1:]) for r in table))


def rated(df: DataFrame, text_col: str = "text", table=THRESHOLDS) -> DataFrame:
    """df with COUNTS, base_failed and kept."""
    made = {c.lower() for c in (*COUNTS, "base_failed", "kept")}
    names = [c for c in df.columns if c.lower() not in made]
    held = fresh(names, "stats")
    out = df.select(*map(column, names), stats(column(text_col)).alias(held)).select(*map(column, names), *(F.col(held)[c].alias(c) for c in COUNTS))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(table))
