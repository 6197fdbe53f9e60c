"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Units.  Of each text these are compared with the templates: every line, every paragraph of several lines,
the header (the comment lines it begins with), and the whole text, as licence files are.  A line without
letters or figures ends a paragraph; marks of comments are no terms.  So a notice may be one sentence,
wrapped, or a file.  The opening, a text's first OPENING terms however it is wrapped, is compared with the
openings of whole licences: those that are too long to be a template are known by what they begin with, and
their versions by the terms that only one of them has.

What says most decides: the opening, then the whole text, then paragraphs and the header, then lines; last
comes a mere reservation of rights, which stands in most other licences too.  Of one rank the best score wins.

Vectors.  A unit's vector has the templates' terms alone, counted, by their inverse frequency among the
templates.  Terms of no template count in another way: a unit must hold at least SHARE of its terms, and
two of them, from the templates; a text as a whole FILE_SHARE.  So a verdict rests on the text and the templates, not on how large the
corpus is.  A text none of whose terms could give any template
the least cosine (Cauchy-Schwarz, over all its known terms) is not cut into units; it has no such unit.

A licence file is one that as a whole is a template's text, that opens as one, or that is named so; a mere reservation
of rights makes none.  A directory has the
licence that most of its licence files have.  A file without one inherits that of the nearest directory
above it: each directory is joined by path with its ancestors, then files with their directory; both joins
are salted, as the top directory is above all others, and one directory may hold a third of all files.

Defined results: null or blank text has no licence of its own and may inherit; a null path is the
top directory; ties go to the first licence by name; repeated rows get repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, let, written
from .licence_texts import OPENINGS, TEMPLATES

#: Words without weight.
COMMON = tuple("the a an of and or to in is this that are for with by be under on as it at you not any".split())
LICENCE_NAME = "(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Lines of a header: marks that begin a comment.
COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--|\"\"\")"
SOLID = "[A-Za-z0-9]"
LEAST = 0.75
#: Least share of known terms in a unit, and in a text as a whole, which makes it a licence file.
SHARE = 0.5
FILE_SHARE = 0.8
KNOWN = 2
#: Terms of an opening, and the words of a text among which they are looked for.
OPENING, PARTS = 40, 120
#: Fixed value: the template that reserves rights and grants none.
RESERVED = "Proprietary"
SALTS = 16
WORD = "a-z0-9.+-"
SEPARATORS = f"[^{WORD}]+"


def _terms_of(text: str) -> list[str]:
    return [t for t in (x.strip(".+-") for x in re.split(SEPARATORS, text.lower())) if t and t not in COMMON]


def vectors(templates=TEMPLATES) -> tuple[list[str], list[list[float]]]:
    """The templates' terms in order, and of each term its weight in each template, whose vectors have length 1; terms' own weights come last."""
    counts = [Counter(_terms_of(text)) for _, text in templates]
    vocab = sorted(set().union(*counts))
    idf = {t: math.log((1 + len(templates)) / (1 + sum(t in c for c in counts))) + 1 for t in vocab}
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for c in counts]
    return vocab, [[*(c[t] * idf[t] / norm for c, norm in zip(counts, norms)), idf[t]] for t in vocab]


def terms(text: Column) -> Column:
    """Terms of a text, without common words; letters other than a to z separate."""
    parts = F.transform(F.split(F.lower(text), SEPARATORS), lambda t: F.btrim(t, F.lit(".+-")))
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*COMMON))


def opening(text: Column) -> Column:
    """The first OPENING terms among a text's first PARTS words.  The words are cut off first, so that the rest is not looked at."""
    head = F.regexp_extract(F.lower(text), f"^(?:[^{WORD}]*+[{WORD}]++){{0,{PARTS}}}+", 0)
    parts = F.transform(F.regexp_extract_all(head, F.lit(f"[{WORD}]+"), F.lit(0)), lambda t: F.btrim(t, F.lit(".+-")))
    return F.slice(F.filter(parts, lambda t: (t != "") & ~t.isin(*COMMON)), 1, OPENING)


#: Ranks of units, the one that says most last.
RESERVE, LINE, BLOCK, WHOLE, OPENED = range(5)


def units(text: Column) -> Column:
    """Array of struct(text, rank): the lines, paragraphs of several lines and header of a text."""

    def of(lines: Column) -> Column:
        solid = F.transform(lines, lambda l: F.when(l.rlike(SOLID), l).otherwise(""))
        paragraphs = F.filter(F.split(F.array_join(solid, "\n"), "\n\n+"), lambda p: p.contains("\n"))
        prose = F.array_position(F.transform(lines, lambda l: l.rlike(COMMENT) | ~l.rlike(SOLID)), False)
        header = F.array_join(F.slice(lines, F.lit(1), F.when(prose > 0, prose - 1).otherwise(F.size(lines)).cast("int")), "\n")
        ranked = lambda texts, rank: F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(rank).alias("rank")))
        head = F.array(F.struct(header.alias("text"), F.when(header.contains("\n"), BLOCK).otherwise(LINE).alias("rank")))
        return F.concat(ranked(F.filter(lines, lambda l: l.rlike(SOLID)), LINE), ranked(paragraphs, BLOCK), head)

    return let(F.split(text, "\n", -1), of)


class Scorer:
    """Columns that compare texts with templates."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        self.vocab, weights = vectors(templates)
        self.words = F.array(*map(F.lit, self.vocab))
        self.weights = F.array(*(F.array(*map(F.lit, w)) for w in weights))

    def known(self, found: Column) -> Column:
        return F.filter(found, lambda t: t.isin(*self.vocab))

    def _row(self, term: Column) -> Column:
        return F.get(self.weights, (F.array_position(self.words, term) - 1).cast("int"))

    def possible(self, text: Column) -> Column:
        """Whether the terms of a text leave any of its units a chance: the length of each template's part that they make up."""
        rows = F.transform(F.array_distinct(self.known(terms(text))), self._row)
        length = lambda r: F.transform(F.sequence(F.lit(0), F.lit(len(self.names) - 1)), lambda k: F.aggregate(r, F.lit(0.0), lambda a, x: a + F.get(x, k) * F.get(x, k)))
        return let(rows, lambda r: (F.size(r) >= KNOWN) & (F.coalesce(F.array_max(length(r)), F.lit(0.0)) >= LEAST * LEAST * (1 - 1e-9)))

    def ranked(self, best: Column, rank: Column | int) -> Column:
        """struct(rank, score, k, name) of what best() gives; a reservation of rights has the lowest rank."""
        name = F.get(F.array(*map(F.lit, self.names)), -best["k"])
        rank = F.lit(rank) if isinstance(rank, int) else rank
        return F.when(best.isNotNull(), F.struct(F.when(name == RESERVED, RESERVE).otherwise(rank).alias("rank"), best["score"].alias("score"), best["k"].alias("k"), name.alias("name")))

    def best(self, unit: Column, share: float = SHARE) -> Column:
        """struct(score, k) of the template most like a unit's terms, k negative so that the first one wins a tie; null below LEAST."""
        last = F.lit(len(self.names))

        def counted(s: Column) -> Column:
            """(weights, count) of each different term of a sorted array."""
            begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
            return let(begins, lambda b: F.transform(b, lambda i, j: F.struct(self._row(F.get(s, i)).alias("x"), (F.coalesce(F.get(b, j + 1), F.size(s)) - i).cast("double").alias("n"))))

        def cosine(v: Column) -> Column:
            norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, t: a + F.pow(t["n"] * F.get(t["x"], last), F.lit(2.0))))
            dot = lambda k: F.aggregate(v, F.lit(0.0), lambda a, t: a + t["n"] * F.get(t["x"], last) * F.get(t["x"], k))
            every = let(norm, lambda n: F.transform(F.sequence(F.lit(0), last - 1), lambda k: F.struct(F.round(dot(k) / n, 4).alias("score"), (-k).alias("k"))))
            return F.when(F.size(v) >= KNOWN, let(F.array_max(every), lambda b: F.when(b["score"] >= LEAST, b)))

        def judged(t: Column) -> Column:
            found = lambda k: F.when((F.size(k) > 0) & (F.size(k) >= share * F.size(t)), let(F.array_sort(k), lambda s: let(counted(s), cosine)))
            return let(self.known(t), found)

        return let(unit, judged)


def own(df: DataFrame, path: Column, text_col: str, keep: list[str], templates=TEMPLATES, openings=OPENINGS) -> DataFrame:
    """keep, _path, licence, score and is_file of each row: one projection."""
    text, scorer, opener = F.coalesce(column(text_col), F.lit("")), Scorer(templates), Scorer([(name, " ".join(_terms_of(t)[:OPENING])) for name, t in openings])
    none = F.lit(None).cast("struct<rank:int,score:double,k:int,name:string>")
    part = F.array_max(F.transform(units(text), lambda u: let(scorer.best(terms(u["text"])), lambda b: scorer.ranked(b, u["rank"]))))
    whole = let(scorer.best(terms(text), FILE_SHARE), lambda b: scorer.ranked(b, WHOLE))
    begun = let(opener.best(opening(text)), lambda b: opener.ranked(b, OPENED))
    found = F.when(scorer.possible(text), F.struct(part.alias("part"), whole.alias("whole"))).otherwise(F.struct(none.alias("part"), none.alias("whole")))
    where = F.coalesce(path, F.lit(""))
    named = F.element_at(F.split(where, "/"), -1).rlike(LICENCE_NAME)

    def told(s: Column) -> Column:
        top = F.greatest(s["part"], s["whole"], s["begun"])  # nulls are skipped
        stated = F.coalesce(s["whole"]["rank"] == WHOLE, F.lit(False)) | s["begun"].isNotNull()
        return let(top, lambda t: F.struct(t["name"].alias("licence"), t["score"].alias("score"), (t.isNotNull() & (named | stated)).alias("is_file")))

    every = let(found, lambda f: F.struct(f["part"].alias("part"), f["whole"].alias("whole"), begun.alias("begun")))
    # as the one row of an array, so that no plan computes it again for each of its fields
    return df.select(*map(column, keep), where.alias("_path"), F.inline(F.array(let(every, told))))


def _parent(path: Column) -> Column:
    """Directory of a path: what stands before its last slash."""
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(df: DataFrame, path: Column, text_col: str = "text", keep: list[str] | None = None, templates=TEMPLATES) -> DataFrame:
    """keep, path, licence ("none" without one), origin (own, inherited, none), score, licensed_by.

    licensed_by is the directory that a licence is inherited from; score is of the file's own.
    """
    keep = keep or ["doc_id"]
    files = written(own(df, path, text_col, keep, templates).withColumn("_dir", _parent(F.col("_path"))))
    votes = files.where("is_file").groupBy("_dir", "licence").agg(F.count("*").alias("n"))
    stated = votes.groupBy("_dir").agg(F.max_by("licence", F.struct("n", F.transform(F.split("licence", ""), lambda c: -F.ascii(c)))).alias("theirs"))
    dirs = files.select("_dir").distinct()
    # ancestors: a directory itself, then without its last part, and so on to the top
    parts = F.split("_dir", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))
    up = dirs.select("_dir", F.explode(F.array_distinct(above)).alias("by"))
    # the top directory is above all others: each row of stated goes to SALTS tasks
    up = up.withColumn("_part", F.pmod(F.xxhash64("_dir"), F.lit(SALTS)).cast("int"))
    stated = stated.select(F.col("_dir").alias("by"), "theirs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    nearest = up.join(stated.hint("merge"), ["by", "_part"]).groupBy("_dir").agg(F.max_by(F.struct("by", "theirs"), F.length("by")).alias("from"))
    nearest = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = files.withColumn("_salt", F.pmod(F.xxhash64("_path", *keep), F.lit(SALTS)).cast("int"))
    out = salted.join(nearest.hint("merge"), ["_dir", "_salt"], "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return out.select(
        *keep,
        F.col("_path").alias("path"),
        F.coalesce("licence", "from.theirs", F.lit("none")).alias("licence"),
        origin.alias("origin"),
        "score",
        F.when(F.col("licence").isNull(), F.col("from.by")).alias("licensed_by"),
    )
