"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import GENERIC, LEADERSHIP, NUMBER_WORDS, OUTCOME

#: The patterns of numbers and of words.
NUMBER = r"(?<![\p{L}\p{N}_.])([$€£₹]?)\s?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)(?:\s?(%|(?:percent|[kKmMbB]|x)(?![A-Za-z0-9_])|\+))?"
WORD = r"[A-Za-z][A-Za-z0-9+#.\-/]*[A-Za-z0-9+#]|[A-Za-z]{2,}"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def numeric_claims(text: Column) -> Column:
    """Distinct numbers with currency and unit, normalised, and number words."""
    whole = F.transform(every(text, NUMBER), lambda m: F.regexp_replace(F.lower(m), r"[\s,]", ""))
    whole = F.transform(whole, lambda m: F.regexp_replace(m, "percent$", "%"))
    whole = F.transform(whole, lambda m: F.regexp_replace(F.regexp_replace(m, r"(\.\d*?)0+(?=\D*$)", "$1"), r"\.(?=\D*$)", ""))
    words = F.filter(F.transform(every(text, "[A-Za-z]+"), F.lower), lambda w: w.isin(*NUMBER_WORDS))
    return F.array_distinct(F.concat(whole, words))


def normalize_term(term: Column) -> Column:
    return F.regexp_replace(F.lower(term), "[^a-z0-9+#]", "")


def stems(text: Column) -> Column:
    return F.array_distinct(every(F.lower(text), "[a-z]+"))


def introduced_verbs(original: Column, proposed: Column, evidence: Column) -> Column:
    """Words of proposed that begin with a listed stem with which no word of the others begins."""
    every_stem = [*OUTCOME, *LEADERSHIP]
    listed = F.array(*map(F.lit, every_stem))
    # few words begin with a listed stem: only these meet the other words, which are taken once a row
    some = F.filter(stems(proposed), lambda w: w.rlike(f"^(?:{'|'.join(every_stem)})"))

    def fresh(words: Column) -> Column:
        new = let(F.array_union(stems(original), stems(evidence)), lambda before: F.filter(listed, lambda v: ~F.exists(before, lambda b: b.startswith(v))))
        return let(new, lambda new: F.filter(F.array_sort(words), lambda w: F.exists(new, lambda v: w.startswith(v))))

    return let(some, lambda words: F.when(F.size(words) == 0, words).otherwise(fresh(words)))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(t: Column, before: Column, first: Column) -> Column:
    """A token without wrapping signs if it looks like a name, else null."""
    token = F.btrim(t, F.lit("()[]{}\"'`,;:!?"))
    token = F.when(token.rlike(r"\.[A-Za-z].*"), token).otherwise(F.regexp_replace(token, r"\.+$", ""))
    start = first | before.rlike(r"[.!?:;]$") | before.isin("—", "-", "–", "|", "•")
    good = token.rlike(r"^.+[\p{Lu}]") | token.rlike(r"\p{Nd}") | token.rlike(r"[+#]|\.[A-Za-z]") | (token.rlike(r"^\p{Lu}") & ~start)
    return F.when(token.rlike("[A-Za-z]") & ~F.lower(token).isin(*GENERIC) & good, token)


def named_terms(text: Column) -> Column:
    """Distinct tokens that look like names: inner capitals, digits, symbols, or a capital inside a sentence."""

    def of(raw: Column) -> Column:
        found = F.transform(raw, lambda t, i: _named(t, F.get(raw, i - 1), i == 0))
        return F.array_distinct(F.filter(found, lambda t: t.isNotNull()))

    return let(every(text, r"\S+"), of)  # bound once: the text is split once, not for each of its tokens


def normalized_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def token_keys(text: Column) -> Column:
    """Distinct normalised tokens, none empty."""
    return F.array_distinct(F.filter(F.transform(every(text, r"\S+"), normalize_term), lambda k: k != ""))


def keys_and_words(text: Column) -> Column:
    """Distinct normalised tokens and words (WORD) of a text, maybe an empty one among them.

    No word spans two tokens, so words are looked for in each token once; all are normalised in one pass, not one by one.
    """
    once = F.array_join(F.array_distinct(F.split(text, r"[ \t\n\r]+", -1)), " ")
    both = let(once, lambda t: F.concat(t, F.lit(" "), F.array_join(every(t, WORD), " ")))
    return F.array_distinct(F.split(F.regexp_replace(F.lower(both), "[^a-z0-9+# ]+", ""), " ", -1))


def term_keys(text: Column) -> Column:
    """Distinct normalised named terms, none empty."""
    return F.array_distinct(F.filter(F.transform(named_terms(text), normalize_term), lambda k: k != ""))


def compound_parts(text: Column) -> Column:
    """array<struct<key, parts>>: words joined by hyphens or strokes, normalised, with their raw parts, of which two at least are not empty."""
    raw = F.transform(every(text, r"\S+"), lambda t: F.btrim(t, F.lit("()[]{}\"'`,;:!?.")))
    joined = F.filter(raw, lambda t: t.rlike("[A-Za-z0-9][-/][A-Za-z0-9]"))
    parts = lambda t: F.filter(F.split(t, "[-/]"), lambda p: normalize_term(p) != "")
    return F.array_distinct(F.filter(F.transform(joined, lambda t: F.struct(normalize_term(t).alias("key"), parts(t).alias("parts"))), lambda c: F.size(c["parts"]) > 1))


def looks_named(raw: Column) -> Column:
    return raw.rlike(r"[\p{Nd}\p{Lu}+#]")


def neutralised(text: Column) -> Column:
    """Text that cannot close a delimiter of the prompt it is put in: a character without width stands in "</"."""
    return F.replace(text, F.lit("</"), F.lit("<​/"))


def prompt(template: str, truncated: Column | None = None, note: str = "", **values: Column) -> Column:
    """A template with {name} filled in; blank values read (none); the note follows where truncated holds."""
    pieces, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        value = F.coalesce(values[m[1]], F.lit(""))
        pieces += [F.lit(template[at : m.start()]), F.when(normalized_space(value) == "", "(none)").otherwise(neutralised(value))]
        at = m.end()
    pieces.append(F.lit(template[at:]))
    return F.concat(*pieces, F.lit("") if truncated is None else F.when(truncated, note).otherwise(""))


def download_name(file_name: Column, suffix: str, fallback: str) -> Column:
    """The name without its last extension, 100 characters at most, with a suffix."""
    stem = F.regexp_replace(F.coalesce(file_name, F.lit("")), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.when(stem == "", fallback).otherwise(F.substring(stem, 1, 100)), F.lit(suffix))
