"""Untrusted JSON replies: the object found in what surrounds it, then each item on its own; what fails is kept as rows.

Problems name the path of a field and what is wrong with it, so that they can be quoted back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

ITEM = "location_id string, original_text string, proposed_text string, edit_type string, reason string, supporting_evidence array<struct<location_id:string,quote:string>>, confidence double"
# Kinds of edit; lengths that a field may have; how many pieces of evidence, gaps and items.
EDIT_TYPES = ("grammar", "clarity", "concision", "keyword_alignment", "impact")
LENGTHS = {"location_id": (0, 40), "original_text": (1, 600), "proposed_text": (0, 800), "reason": (1, 500)}
EVIDENCE_LENGTHS = {"location_id": (0, 40), "quote": (1, 400)}
FIELDS = ("location_id", "original_text", "proposed_text", "edit_type", "reason", "supporting_evidence", "confidence")
ENVELOPE = ("alignment_summary", "gaps_without_evidence", "proposals")
SUMMARY, GAPS, EVIDENCE, MOST = 1500, 20, 4, 60

PROBLEMS = "array<struct<path:string,problem:string>>"


def bare(reply: Column) -> Column:
    """Without a reasoning prefix and a code fence."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    body = strip(F.substring_index(strip(reply), "</think>", -1))

    def inside(t: Column) -> Column:
        t = F.when(t.contains("\n"), F.substring(t, F.instr(t, "\n") + 1, F.length(t))).otherwise(t)
        fences = F.regexp_count(t, F.lit("```"))  # what the last one closes
        return F.when(fences > 0, F.call_function("substring_index", t, F.lit("```"), fences)).otherwise(t)

    return F.when(body.startswith("```"), let(F.btrim(body, F.lit("`")), inside)).otherwise(body)


def first_object(text: Column) -> Column:
    """The text from its first opening brace to the brace that closes it, braces inside strings aside; null without one.

    One pass over the text's signs: a state of depth, string and place.
    """
    start = F.instr(text, "{")
    signs = F.regexp_extract_all(F.substring(text, start, F.length(text)), F.lit(r'(?s)\\.|["{}]|[^"\\{}]++|\\'), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(s["quoted"], 0).when(t == "{", 1).when(t == "}", -1).otherwise(0)
        at = s["at"] + F.length(t)
        ends = (s["end"] == 0) & (depth == 0) & (t == "}") & ~s["quoted"]
        return F.struct(depth.alias("depth"), (s["quoted"] != (t == '"')).alias("quoted"), at.alias("at"), F.when(ends, at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(signs, state, step)["end"]
    return F.when(start > 0, let(end, lambda e: F.when(e > 0, F.substring(text, start, e))))


def parsed(reply: Column) -> Column:
    """The reply's JSON as a variant: all of it, else the first whole object in it; null without one."""
    return let(bare(reply), lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(first_object(b))))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (null) or a number's type; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _field(v: Column, name: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", as_type)


def _found(path: Column, problem: Column) -> Column:
    """One problem, or none where it is null."""
    return F.when(problem.isNotNull(), F.array(F.struct(path.alias("path"), problem.alias("problem")))).otherwise(F.array().cast(PROBLEMS))


def _text_problem(v: Column, name: str, least: int, most: int) -> Column:
    n = F.length(_field(v, name, "string"))
    k = kind(_field(v, name))
    return F.when(k.isNull(), "missing").when(k != "STRING", "string_type").when(n < least, "string_too_short").when(n > most, "string_too_long")


def _extra(v: Column, known: tuple[str, ...], prefix: Column) -> Column:
    keys = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, known)))
    return F.transform(keys, lambda k: F.struct(F.concat(prefix, k).alias("path"), F.lit("extra_forbidden").alias("problem")))


def _evidence_problems(list_: Column, path: str, prefix: Column) -> Column:
    k, n = kind(list_), F.size(F.try_variant_get(list_, "$", "array<variant>"))
    whole = F.when(k.isNull(), "missing").when(k != "ARRAY", "list_type").when(n < 1, "too_short").when(n > EVIDENCE, "too_long")

    def one(e: Column, i: Column) -> Column:
        at = F.concat(prefix, F.lit(f"{path}."), i.cast("string"))
        texts = [_found(F.concat(at, F.lit(f".{f}")), _text_problem(e, f, lo, hi)) for f, (lo, hi) in EVIDENCE_LENGTHS.items()]
        return F.when(kind(e) != "OBJECT", _found(at, F.lit("model_type"))).otherwise(F.concat(*texts, _extra(e, tuple(EVIDENCE_LENGTHS), F.concat(at, F.lit(".")))))

    each = F.flatten(F.transform(F.try_variant_get(list_, "$", f"array<variant>"), one))
    return F.when(whole.isNull(), each).otherwise(_found(F.concat(prefix, F.lit(path)), whole))


def _confidence_problem(v: Column) -> Column:
    k, x = kind(_field(v, "confidence")), _field(v, "confidence", "double")
    bad = F.when(k.isin("OBJECT", "ARRAY"), "float_type").when(x.isNull(), "float_parsing").when(x < 0, "greater_than_equal").when(x > 1, "less_than_equal")
    return F.when(k.isNotNull() & (k != "VOID"), bad)


def item_problems(v: Column, edit_types=EDIT_TYPES, prefix: Column | None = None) -> Column:
    """PROBLEMS of an item (a variant), in the order of FIELDS, fields that nobody asked for last."""
    prefix = F.lit("") if prefix is None else prefix
    of = {f: _found(F.concat(prefix, F.lit(f)), _text_problem(v, f, lo, hi)) for f, (lo, hi) in LENGTHS.items()}
    k = kind(_field(v, "edit_type"))
    listed = F.when(k.isNull(), "missing").when((k != "STRING") | ~_field(v, "edit_type", "string").isin(*edit_types), "enum")
    of["edit_type"] = _found(F.concat(prefix, F.lit("edit_type")), listed)
    of["supporting_evidence"] = _evidence_problems(_field(v, "supporting_evidence"), "supporting_evidence", prefix)
    of["confidence"] = _found(F.concat(prefix, F.lit("confidence")), _confidence_problem(v))
    whole = _found(F.regexp_replace(prefix, r"\.$", ""), F.lit("model_type"))
    return F.when(kind(v) == "OBJECT", F.concat(*(of[f] for f in FIELDS), _extra(v, FIELDS, prefix))).otherwise(whole)


def envelope_problems(v: Column) -> Column:
    """PROBLEMS of a reply's own fields."""
    summary, gaps = _field(v, "alignment_summary"), _field(v, "gaps_without_evidence")
    told = F.when(kind(summary) != "STRING", "string_type").when(F.length(_field(v, "alignment_summary", "string")) > SUMMARY, "string_too_long")
    rows = F.try_variant_get(gaps, "$", "array<variant>")
    listed = F.when(kind(gaps) != "ARRAY", "list_type").when(F.size(rows) > GAPS, "too_long")
    each = F.flatten(F.transform(rows, lambda g, i: _found(F.concat(F.lit("gaps_without_evidence."), i.cast("string")), F.when(kind(g) != "STRING", "string_type"))))
    none = F.array().cast(PROBLEMS)
    gap = F.when(listed.isNull(), F.coalesce(each, none)).otherwise(_found(F.lit("gaps_without_evidence"), listed))
    return F.concat(_found(F.lit("alignment_summary"), told), gap, _extra(v, ENVELOPE, F.lit("")))


def items(replies: DataFrame, reply: str = "reply", edit_types=EDIT_TYPES) -> DataFrame:
    """Other columns, pos, item, code, problems: one row per item, code null if valid or schema_invalid.

    A reply without an object, or whose proposals are no list, is one row with pos null and code reply_invalid; one whose own
    fields are wrong is one with code schema_invalid, and its items do not count.  A reply without proposals has no row.
    """
    others = [c for c in replies.columns if c != reply]
    v = replies.select(*others, parsed(F.col(reply)).alias("_v"))
    listed = _field(F.col("_v"), "proposals")
    bad = F.coalesce((kind(F.col("_v")) != "OBJECT") | (kind(listed) != "ARRAY"), F.col("_v").isNull())
    none = F.array().cast(PROBLEMS)
    v = v.withColumn("_bad", bad).withColumn("_wrong", F.when(F.col("_bad"), none).otherwise(envelope_problems(F.col("_v"))))
    sound = ~F.col("_bad") & (F.size("_wrong") == 0)
    list_ = F.when(sound, F.slice(_field(F.col("_v"), "proposals", "array<variant>"), 1, MOST))
    rows = v.select(*others, "_bad", "_wrong", F.posexplode_outer(list_).alias("pos", "_i"))
    prefix = F.concat(F.lit("proposals."), F.col("pos").cast("string"), F.lit("."))
    problems = F.when(F.col("pos").isNotNull(), item_problems(F.col("_i"), edit_types, prefix)).otherwise(F.col("_wrong"))
    out = rows.where("_bad OR pos IS NOT NULL OR size(_wrong) > 0").withColumn("problems", problems)
    code = F.when(F.col("_bad"), "reply_invalid").when(F.size("problems") > 0, "schema_invalid")
    return out.select(*others, "pos", F.from_json(F.to_json("_i"), ITEM).alias("item"), code.alias("code"), "problems")


#: Answers after which a request is tried again, and the waits between tries in seconds.
RETRIED, FIRST_WAIT, LONGEST_WAIT, SPREAD = (408, 429), 0.5, 8.0, 0.25


def retried(status, error):
    """Whether an attempt failed in a way that may pass: no answer (error timeout or transport), or an answer that says so."""
    return F.coalesce(error.isin("timeout", "transport"), F.lit(False)) | F.coalesce(status.isin(*RETRIED) | (status >= 500), F.lit(False))


def wait(attempt):
    """Seconds before the try after attempt (1, 2, ...), without the random part of up to SPREAD."""
    return F.least(F.lit(LONGEST_WAIT), F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), attempt - 1))


def outcomes(attempts: DataFrame, most: int = 3) -> DataFrame:
    """request, tries, status, waited: what became of each request whose attempts (request, n, status, error) are logged; later attempts than
    the first that is not tried again, or than most, are none of it."""
    stop = F.min(F.when(~retried(F.col("status"), F.col("error")) | (F.col("n") >= most), F.col("n")))
    end = attempts.groupBy("request").agg(F.coalesce(stop, F.max("n")).alias("tries"))
    used = attempts.join(end, "request").where("n <= tries")
    return used.groupBy("request", "tries").agg(F.max_by("status", "n").alias("status"), F.coalesce(F.sum(F.when(F.col("n") < F.col("tries"), wait(F.col("n")))), F.lit(0.0)).alias("waited"))
