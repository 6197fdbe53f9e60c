"""Text plans: DataFrame expressions in Spark, and DuckDB SQL written for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.vocabulary import GENERIC, LEADERSHIP, NUMBER_WORDS, OUTCOME, STOP
from ..operators import blocks as B
from ..operators import edit_rules as R
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: DuckDB relations used by several statements.
BLOCKS = """blocks AS (
  SELECT doc_id, version, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS ord, unnest(ls) AS text
  FROM (SELECT doc_id, sha256(text) AS version, string_split(text, chr(10)) AS ls FROM documents) d)"""
EDITS = (
    BLOCKS
    + """, usable AS (
  SELECT doc_id, ord, text, ws[1] AS w0, ws[2] AS w1, length(ws[1]) + 1 AS s FROM (SELECT *, string_split(text, ' ') AS ws FROM blocks) x
  WHERE len(ws) >= 2 AND length(ws[2]) >= 3),
edits AS (
  SELECT doc_id, ord, text, 0 AS n, s AS start, s + length(w1) AS stop, w1 AS original,
    CASE ord % 6 WHEN 0 THEN w1 || w1 WHEN 1 THEN w1 || ' 25%' WHEN 2 THEN 'led ' || w1 WHEN 3 THEN w1 || ' see www.example.com' WHEN 4 THEN repeat(w1 || ' ', 40) ELSE w1 END AS proposed,
    CASE WHEN ord % 4 <> 0 THEN (ord % 10) / 10.0 END AS confidence FROM usable
  UNION ALL
  SELECT doc_id, ord, text, 1, s + 1, s + 3, substring(text, CAST(length(w0) + 3 AS INTEGER), 2), 'Q7', 0.35 FROM usable)"""
)
#: The first of two edits wins if it is as confident or more.
GREEDY = EDITS + """, taken AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY -coalesce(confidence, 0), n) AS r FROM edits) e WHERE r = 1)"""


@query(f"WITH {BLOCKS} SELECT doc_id, ord, 'loc_' || substr(sha256(version || '|body|p[' || ord || ']|' || substr(sha256(text), 1, 16)), 1, 16) AS location_id, CAST(length(text) AS BIGINT) AS n_chars, trim(text) <> '' AS editable FROM blocks")
def blocks_index(spark, sf_dir):
    b = B.blocks(table(spark, sf_dir, "documents"))
    return b.select("doc_id", "ord", "location_id", F.length("text").cast("long").alias("n_chars"), "editable")


CLAIMS_SQL = f"""SELECT DISTINCT doc_id, claim FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(m), '[\\s,]', '', 'g'), 'percent$', '%'), '(\\.\\d*?)0+(\\D*)$', '\\1\\2'), '\\.(\\D*)$', '\\1') AS claim FROM (
    SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([%+])(\\d)', '\\1 \\2', 'g'), '(?:^|[^\\pL\\pN_.])([$€£₹]?\\s?(?:\\d{{1,3}}(?:,\\d{{3}})+|\\d+(?:\\.\\d+)?)(?:\\s?(?:%|percent\\b|[kKmMbB]\\b|x\\b|\\+))?)', 1)) AS m FROM documents) a
  UNION ALL
  SELECT doc_id, w FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents) b WHERE w IN {_list(NUMBER_WORDS)}) c"""


@query(CLAIMS_SQL)
def numeric_claims_by_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.numeric_claims(F.col("text"))).alias("claim"))


@query("SELECT term, count(*) AS n FROM (SELECT regexp_replace(lower(unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+'))), '[^a-z0-9+#]', '', 'g') AS term FROM documents) t WHERE term <> '' GROUP BY term")
def normalized_terms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.every(F.col("text"), "[^ \\t\\n\\r]+")).alias("w"))
    return words.select(T.normalize_term(F.col("w")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT stem, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS stem FROM documents) t GROUP BY stem")
def word_stems(spark, sf_dir):
    # distinct within a document already: one count per stem, combined on the map side
    return table(spark, sf_dir, "documents").select(F.explode(T.stems(F.col("text"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("n_docs"))


@query(f"""WITH raw AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS l FROM documents) d),
  t AS (SELECT doc_id, pos, raw, trim(raw, '()[]{{}}"''`,;:!?') AS a, lag(raw) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM raw),
  u AS (SELECT *, CASE WHEN regexp_matches(a, '\\.[A-Za-z]') THEN a ELSE regexp_replace(a, '\\.+$', '') END AS term FROM t)
  SELECT DISTINCT doc_id, term FROM u WHERE regexp_matches(term, '[A-Za-z]') AND lower(term) NOT IN {_list(GENERIC)}
    AND (regexp_matches(term, '^.+\\p{{Lu}}') OR regexp_matches(term, '\\p{{Nd}}') OR regexp_matches(term, '[+#]|\\.[A-Za-z]')
      OR (regexp_matches(term, '^\\p{{Lu}}') AND NOT (before IS NULL OR regexp_matches(before, '[.!?:;]$') OR before IN ('—', '-', '–', '|', '•'))))""")
def named_terms_by_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.named_terms(F.col("text"))).alias("term"))


@query(f"""SELECT item_id, word, n, first_pos FROM (SELECT item_id, word, count(*) AS n, min(pos) AS first_pos FROM (
  SELECT item_id, lower(unnest(l)) AS word, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM (SELECT item_id, regexp_extract_all(text, '{T.WORD}') AS l FROM benchmark) b) w
  WHERE length(word) > 3 AND word NOT IN {_list(STOP)} GROUP BY item_id, word) x WHERE n >= 2""")
def jd_term_frequency(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.transform(T.every(F.col("text"), T.WORD), F.lower)).alias("pos", "word"))
    w = w.where((F.length("word") > 3) & ~F.col("word").isin(*STOP))
    return w.groupBy("item_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).where("n >= 2")


COVERAGE_SQL = f"""WITH terms AS (SELECT DISTINCT item_id, regexp_replace(word, '[^a-z0-9+#]', '', 'g') AS k FROM (
    SELECT item_id, word FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '{T.WORD}'))) AS word FROM benchmark) b
    WHERE length(word) > 3 AND word NOT IN {_list(STOP)} GROUP BY item_id, word HAVING count(*) >= 2) x),
  size AS (SELECT item_id, count(*) AS n FROM terms GROUP BY item_id),
  tokens AS (SELECT DISTINCT doc_id, regexp_replace(lower(unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+'))), '[^a-z0-9+#]', '', 'g') AS k FROM documents)
  SELECT d.doc_id, t.item_id, count(*) AS matched, max(s.n) AS considered, CAST(round_even(100.0 * count(*) / max(s.n), 0) AS INTEGER) AS percent
  FROM tokens d JOIN terms t ON d.k = t.k JOIN size s ON s.item_id = t.item_id GROUP BY d.doc_id, t.item_id"""


@query(COVERAGE_SQL)
def keyword_coverage(spark, sf_dir):
    """Frequent terms of each benchmark item (the third tier alone) found in each document; coverage_estimate has all tiers.

    Pairs without a match are left out.
    """
    terms = jd_term_frequency(spark, sf_dir).select("item_id", T.normalize_term(F.col("word")).alias("k")).distinct()
    size = terms.groupBy("item_id").agg(F.count("*").alias("considered"))
    tokens = F.array_distinct(F.transform(T.every(F.col("text"), "[^ \\t\\n\\r]+"), T.normalize_term))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens).alias("k"))
    hits = docs.join(terms, "k").groupBy("doc_id", "item_id").agg(F.count("*").alias("matched")).join(size, "item_id")
    return hits.select("doc_id", "item_id", "matched", "considered", F.bround(100 * F.col("matched") / F.col("considered")).cast("int").alias("percent"))


@query(f"WITH {BLOCKS} SELECT doc_id, ord FROM (SELECT doc_id, ord, length(text) AS n, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS used FROM blocks WHERE trim(text) <> '') t WHERE used <= 24000")
def context_budget_cut(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("ord")
    b = B.blocks(table(spark, sf_dir, "documents")).where("editable")
    return b.withColumn("used", F.sum(F.length("text") + 1).over(order) - 1).where("used <= 24000").select("doc_id", "ord")


@query(f"""WITH {BLOCKS} SELECT doc_id, ord, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM (
  SELECT doc_id, ord, CASE WHEN length(trim(text)) BETWEEN 2 AND 40 AND regexp_matches(text, '[A-Za-z]') AND upper(text) = text THEN left(trim(text), 60) END AS label FROM blocks) b""")
def section_carry_forward(spark, sf_dir):
    t = F.btrim("text")
    label = F.when(F.length(t).between(2, 40) & F.col("text").rlike("[A-Za-z]") & (F.upper("text") == F.col("text")), F.call_function("left", t, F.lit(60)))
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return B.blocks(table(spark, sf_dir, "documents")).withColumn("label", label).select("doc_id", "ord", F.last("label", ignorenulls=True).over(order).alias("section"))


TAGS = {"paragraphs": "<p[ >]", "links": "<a ", "items": "<li[ >]", "headings": "<h[1-6]", "breaks": "<br", "scripts": "<script"}


@query("SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(html, '{p}')) AS BIGINT) AS {n}" for n, p in TAGS.items()) + " FROM pages")
def page_tag_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *(F.regexp_count("html", F.lit(p)).cast("long").alias(n) for n, p in TAGS.items()))


@query("SELECT regexp_matches(html, '(?i)<!\\s*(DOCTYPE|ENTITY)') AS rejected, count(*) AS n FROM pages GROUP BY 1")
def unsafe_markup_rejects(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.col("html").rlike("(?i)<!\\s*(DOCTYPE|ENTITY)").alias("rejected")).agg(F.count("*").alias("n"))


@query(f"""WITH {EDITS} SELECT doc_id, ord, n, CASE WHEN length(original) = 0 THEN 'empty_target' WHEN instr(text, original) = 0 THEN 'target_not_found'
  WHEN instr(substring(text, CAST(instr(text, original) + 1 AS INTEGER)), original) > 0 THEN 'ambiguous_target' ELSE 'unique' END AS status FROM edits""")
def locate_unique_status(spark, sf_dir):
    e = B.edits(B.blocks(table(spark, sf_dir, "documents")))
    return e.select("doc_id", "ord", "n", R.locate_status(F.col("text"), F.col("original")).alias("status"))


@query(f"WITH {EDITS} SELECT a.doc_id, a.ord, a.n AS a, b.n AS b FROM edits a JOIN edits b ON a.doc_id = b.doc_id AND a.ord = b.ord AND a.n < b.n AND a.start < b.stop AND b.start < a.stop")
def edit_overlaps(spark, sf_dir):
    e = B.edits(B.blocks(table(spark, sf_dir, "documents"))).select("doc_id", "ord", "n", "start", "end")
    a, b = e.alias("a"), e.alias("b")
    both = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.ord") == F.col("b.ord")) & (F.col("a.n") < F.col("b.n")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))
    return both.select("a.doc_id", "a.ord", F.col("a.n").alias("a"), F.col("b.n").alias("b"))


@query(f"WITH {GREEDY} SELECT doc_id, ord, n FROM taken")
def greedy_accept(spark, sf_dir):
    taken = R.greedy(B.edits(B.blocks(table(spark, sf_dir, "documents"))))
    return taken.select("doc_id", "ord", F.explode("kept.n").alias("n"))


@query(f"WITH {GREEDY} SELECT doc_id, ord, sha256(left(text, start) || proposed || substring(text, CAST(stop + 1 AS INTEGER))) AS new_hash FROM taken")
def apply_edits_text(spark, sf_dir):
    taken = R.greedy(B.edits(B.blocks(table(spark, sf_dir, "documents"))))
    return R.applied(taken).select("doc_id", "ord", F.sha2("new_text", 256).alias("new_hash"))


_VERB = " OR ".join(f"(starts_with(w, '{v}') AND NOT EXISTS (SELECT 1 FROM unnest(regexp_extract_all(lower(original), '[a-z]+')) AS u(b) WHERE starts_with(b, '{v}')))" for v in [*OUTCOME, *LEADERSHIP])


@query(f"WITH {EDITS} SELECT DISTINCT doc_id, ord, n, w AS verb FROM (SELECT doc_id, ord, n, original, unnest(regexp_extract_all(lower(proposed), '[a-z]+')) AS w FROM edits) e WHERE {_VERB}")
def introduced_verbs(spark, sf_dir):
    e = B.edits(B.blocks(table(spark, sf_dir, "documents")))
    # outer, as for an inner one Spark adds a filter on the array's size, which makes the array once more
    return e.select("doc_id", "ord", "n", F.explode_outer(T.introduced_verbs(F.col("original"), F.col("proposed"), F.lit(""))).alias("verb")).where("verb IS NOT NULL")


@query(f"WITH {EDITS} SELECT doc_id, ord, n, length(proposed) - length(original) > least(greatest(40, length(original)), 120) AS too_long, regexp_matches(proposed, 'www\\.') AS link FROM edits")
def growth_and_link_rejects(spark, sf_dir):
    e = B.edits(B.blocks(table(spark, sf_dir, "documents")))
    return e.select("doc_id", "ord", "n", R.too_long(F.col("original"), F.col("proposed")).alias("too_long"), F.col("proposed").rlike("www\\.").alias("link"))


def _claims(text: str) -> str:
    """A text's numeric claims as a list, each once."""
    number = f"regexp_extract_all(regexp_replace({text}, '([%+])(\\d)', '\\1 \\2', 'g'), '(?:^|[^\\pL\\pN_.])([$€£₹]?\\s?(?:\\d{{1,3}}(?:,\\d{{3}})+|\\d+(?:\\.\\d+)?)(?:\\s?(?:%|percent\\b|[kKmMbB]\\b|x\\b|\\+))?)', 1)"
    plain = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(m), '[\\s,]', '', 'g'), 'percent$', '%'), '(\\.\\d*?)0+(\\D*)$', '\\1\\2'), '\\.(\\D*)$', '\\1')"
    words = f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z]+'), lambda w: lower(w)), lambda w: w IN {_list(NUMBER_WORDS)})"
    return f"list_distinct(list_concat(list_transform({number}, lambda m: {plain}), {words}))"


_LINK_SQL = R.LINK.replace("'", "''")


@query(f"""WITH {EDITS}, c AS (
  SELECT *, {_claims('original')} AS co, {_claims('proposed')} AS cp, regexp_extract_all(lower(original), '[a-z]+') AS wo, regexp_extract_all(lower(proposed), '[a-z]+') AS wp FROM edits),
d AS (SELECT *, len(list_filter(cp, lambda x: NOT list_contains(co, x))) AS added, len(list_filter(co, lambda x: NOT list_contains(cp, x))) AS removed,
  len(list_filter({[*OUTCOME, *LEADERSHIP]}, lambda v: len(list_filter(wp, lambda w: starts_with(w, v))) > 0 AND len(list_filter(wo, lambda w: starts_with(w, v))) = 0)) AS verbs FROM c)
SELECT doc_id, ord, n, CASE WHEN length(original) = 0 THEN 'empty_target' WHEN instr(text, original) = 0 THEN 'target_not_found' WHEN instr(substring(text, CAST(instr(text, original) + 1 AS INTEGER)), original) > 0 THEN 'ambiguous_target'
  WHEN trim(proposed) = '' THEN 'empty_replacement' WHEN regexp_matches(proposed, '[\\x00-\\x1f\\x7f\\x{{2028}}\\x{{2029}}]') THEN 'invalid_characters' WHEN proposed = original THEN 'no_change'
  WHEN length(proposed) - length(original) > least(greatest(40, length(original)), 120) THEN 'too_long' WHEN regexp_matches(proposed, '{_LINK_SQL}') AND NOT regexp_matches(original, '{_LINK_SQL}') THEN 'unsupported_contact_or_link'
  WHEN removed > 0 AND added > 0 THEN 'changed_number' WHEN added > 0 THEN 'unsupported_number' WHEN verbs > 0 THEN 'accept_confirm' ELSE 'accept' END AS code FROM d""")
def evidence_rule_codes(spark, sf_dir):
    e = B.edits(B.blocks(table(spark, sf_dir, "documents")))
    return e.select("doc_id", "ord", "n", R.code(e).alias("code"))


@query(f"WITH {BLOCKS} SELECT doc_id, sha256(text) AS text_hash, count(*) AS n FROM blocks WHERE trim(text) <> '' GROUP BY doc_id, text HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    b = B.blocks(table(spark, sf_dir, "documents")).where("editable")
    return b.groupBy("doc_id", "text").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.sha2("text", 256).alias("text_hash"), "n")


@query("SELECT page_id, len(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/')) - 1 AS depth FROM pages")
def relative_path_depth(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.size(F.split(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "/", -1)) - 1).cast("long").alias("depth"))
