"""Secret scans with corpus-wide ownership frequency, in DataFrame operations alone.

Places.  split() by a pattern gives what lies between its matches, regexp_extract_all the matches;
running sums of their lengths, block by block, are the matches' code points.  Both run only on texts
that rlike finds to have a match.

Ownership.  Each candidate's value is hashed.  Distinct (hash, owner, repository) are counted by
hash: first distinct, with partial aggregation, then by owner, then by hash, so a value that half
of the corpus copies is a few rows a task.  A value with MANY_OWNERS owners or more, or with two and
MANY_REPOS repositories, is a widely copied example; of the others, one that looks random is live,
however many repositories of its owner hold it.  Only values with several owners or
repositories are joined back, salted, as one value may stand in a third of all rows.

Spans: base spans always stay; of the method's further kinds (keys of known issuers, private-key
blocks, passwords in addresses) those are added that are not widely copied and overlap no base span.
Two of their patterns are bounded, so that their time grows with the text alone: a signed token whose
head has more than 400 characters after "eyJ" is not added, and of an address's scheme the last 16 characters count.

Defined results: null text is the empty text and has no spans; null owner or repository counts as
one; repeated rows get repeated results; texts are read whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, repeated, written

MANY_OWNERS = 3
#: From so many repositories on, a value of two owners is a copied example too.
MANY_REPOS = 6
SALTS = 16
#: Spans whose places are summed at a time, so that a text with very many of them is not copied for each.
BLOCK = 256


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
#: kind, pattern, group of the value, least length of the value.  Each pattern is read alike by Java and RE2.
BASE = (
    ("assign", f"({_KEYWORD})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
)
MORE = (
    # Repeats that could run on without an end are bounded, so that a pattern's time grows with the text alone.
    ("issued", "(?:gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{20,}|sk-[A-Za-z0-9_-]{20,}|[rs]k_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35,}|npm_[A-Za-z0-9]{36,}|eyJ[A-Za-z0-9_-]{8,400}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,})", 0, 16),
    ("pem", "-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----[A-Za-z0-9+/=\\s]*-----END (?:[A-Z]+ ){0,2}PRIVATE KEY-----", 0, 60),
    ("address", "[a-z][a-z0-9+]{0,15}://[A-Za-z0-9._%-]+:([A-Za-z0-9._%!*+-]{8,})@", 1, 8),
)
KINDS = tuple(k[0] for k in (*BASE, *MORE))
SPAN = "array<struct<start:int,no:int,end:int,value:string>>"


def _spans(text: Column, no: int, pattern: str, group: int, least: int) -> Column:
    """Array of SPAN in order."""
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def found(whole: Column, values: Column, at: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            end = F.get(at, i)
            return F.struct((end - F.length(w)).alias("start"), F.lit(no).alias("no"), end.alias("end"), F.get(values, i).alias("value"))

        return F.filter(F.transform(whole, one), lambda s: F.length(s["value"]) >= least)

    steps = lambda g, w: F.transform(w, lambda x, i: F.length(F.get(g, i)) + F.length(x))
    ends = let(F.split(text, pattern, -1), lambda g: let(all_of(0), lambda w: let(_running(steps(g, w)), lambda at: let(all_of(group) if group else w, lambda v: found(w, v, at)))))
    return F.when(text.rlike(pattern), ends).otherwise(F.array().cast(SPAN))


def _blocks(items: Column) -> Column:
    """An array of arrays of BLOCK items, the last one shorter; for one item or more."""
    last = lambda it: ((F.size(it) - 1) / BLOCK).cast("int")
    return let(items, lambda it: F.transform(F.sequence(F.lit(0), last(it)), lambda b: F.slice(it, b * BLOCK + 1, F.lit(BLOCK))))


def _running(steps: Column) -> Column:
    """Running sums of an array of one number or more, each number counted in."""

    def sums(numbers: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))
        return F.aggregate(numbers, zero, add)["out"]

    def joined(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x))
        return let(sums(whole, F.lit(0)), lambda upto: F.flatten(F.transform(blocks, lambda b, i: sums(b, F.coalesce(F.get(upto, i - 1), F.lit(0))))))

    return let(_blocks(steps), joined)


def _clear_of(more: Column, base: Column) -> Column:
    """Spans of more that overlap none of base.  Blocks of base with their reach spare most comparisons."""

    def reach(b: Column) -> Column:
        ends = F.transform(b, lambda x: x["end"])
        return F.struct(F.array_min(F.transform(b, lambda x: x["start"])).alias("low"), F.array_max(ends).alias("high"), b.alias("spans"))

    over = lambda x, m: (x["start"] < m["end"]) & (m["start"] < x["end"])
    hit = lambda blocks, m: F.exists(blocks, lambda b: (b["low"] < m["end"]) & (m["start"] < b["high"]) & F.exists(b["spans"], lambda x: over(x, m)))
    kept = let(F.transform(_blocks(F.array_sort(base)), reach), lambda blocks: F.filter(more, lambda m: ~hit(blocks, m)))
    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(kept)


def _order(spans: Column) -> Column:
    return F.array_sort(spans)


def candidates(text: Column) -> Column:
    """Array of structs start, no (of KINDS), end, value: base spans and further ones, in order."""
    text = F.coalesce(text, F.lit(""))
    base = F.flatten(F.array(*(_spans(text, i, *k[1:]) for i, k in enumerate(BASE))))
    more = F.flatten(F.array(*(_spans(text, len(BASE) + i, *k[1:]) for i, k in enumerate(MORE))))
    return _order(let(base, lambda b: F.concat(b, let(more, lambda m: _clear_of(m, b)))))


def _random(value: Column) -> Column:
    """Looks like a generated value: at least 8 different characters, and not one word alone."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 8) & (value.rlike("[0-9]") | (value.rlike("[A-Z]") & value.rlike("[a-z]")))


def _text(spans: Column, *more) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"], s["end"], *(s[m] for m in more))
    return F.array_join(F.transform(spans, one), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols=("source", "lang")) -> DataFrame:
    """One row per input row: id_col, n_assign, n_access, n_hex, base_sha256, spans, verdicts."""
    repo = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols))
    cands = F.transform(candidates(F.col(text_col)), lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), _random(s["value"]).alias("random")))
    found = written(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), repo.alias("repo"), cands.alias("c")))
    some = found.where(F.size("c") > 0)
    one = some.select("owner", "repo", F.explode("c.hash").alias("hash")).distinct()
    owners = one.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).where("owners > 1 or repos > 1")
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Rows alike in id and candidates are one row here; they come back at the end.
    # A digest stands for the candidates, so that a text with many does not carry all of them with each.
    rows = some.groupBy("id", F.sha2(F.to_json("c"), 256).alias("k")).agg(F.count("*").alias("n"), F.first("c").alias("c"))
    parts = rows.select("id", "k", "n", F.explode("c").alias("s")).select("*", F.col("s.hash").alias("hash"), F.pmod(F.xxhash64("id", "s.start"), F.lit(SALTS)).cast("int").alias("salt"))
    judged = parts.join(owners.hint("merge"), ["hash", "salt"], "left")
    n_owners, n_repos = F.coalesce("owners", F.lit(1)), F.coalesce("repos", F.lit(1))
    copied = (n_owners >= MANY_OWNERS) | (n_owners >= 2) & (n_repos >= MANY_REPOS)
    verdict = F.when(copied, "example").when(F.col("s.random"), "live").otherwise("plain")
    own = F.struct(F.col("s.start").alias("start"), F.col("s.no").alias("no"), F.col("s.end").alias("end"), verdict.alias("verdict"), n_owners.alias("owners"), n_repos.alias("repos"))
    known = judged.groupBy("id", "k").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(own)).alias("v"))
    known = repeated(known, F.col("n")).select("id", "v")
    none = F.array().cast("array<struct<start:int,no:int,end:int,verdict:string,owners:bigint,repos:bigint>>")
    every = known.unionByName(found.where(F.size("c") == 0).select("id", none.alias("v")))
    base = F.filter("v", lambda s: s["no"] < len(BASE))
    kept = F.filter("v", lambda s: (s["no"] < len(BASE)) | (s["verdict"] != "example"))
    count = lambda i: F.size(F.filter("v", lambda s: s["no"] == i)).cast("long")
    return every.select(
        F.col("id").alias(id_col),
        *(count(i).alias(f"n_{k[0]}") for i, k in enumerate(BASE)),
        F.sha2(_text(base), 256).alias("base_sha256"),
        _text(kept).alias("spans"),
        _text(F.col("v"), "verdict", "owners", "repos").alias("verdicts"),
    )
