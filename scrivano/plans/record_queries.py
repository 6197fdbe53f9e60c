"""Plans over sessions, progress, evaluation and stores, with DuckDB SQL of their own.

Requests, steps and scores are derived from the driver's events, conversations and labels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import evaluation, sessions
from ..sources import stores
from ..sources.tables import table
from .text_queries import BLOCKS

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


LEASE = 86_400
_KINDS = ("claim", "complete", "complete", "fail", "decide", "begin", "finish", "abort", "claim")

#: Each user's events as requests on a session; the first one creates it.
_REQUESTS = f"""e AS (
  SELECT user_id AS s, event_id AS n, floor(epoch(ts)) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id % 4 AS expected,
         CASE WHEN event_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS decision, [{', '.join(f"'{k}'" for k in _KINDS)}][event_id % {len(_KINDS)} + 1] AS kind FROM events),
q AS (SELECT *, CASE WHEN i = 1 THEN 'create' ELSE kind END AS request FROM e)"""
_FOLD = f"""WITH RECURSIVE {_REQUESTS},
f AS (
  SELECT DISTINCT s, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS revision, CAST(NULL AS DOUBLE) AS lease, CAST(NULL AS VARCHAR) AS result FROM e
  UNION ALL
  SELECT s, i, n,
    CASE WHEN r <> 'ok' THEN status WHEN request IN ('create', 'claim') THEN 'analyzing' WHEN request = 'fail' THEN 'analysis_failed' WHEN request = 'begin' THEN 'finalizing'
         WHEN request = 'finish' AND decision <> 'FAIL' THEN 'finalized' ELSE 'awaiting_review' END,
    CASE WHEN r = 'ok' AND request = 'create' THEN 0 WHEN r = 'ok' AND request IN ('complete', 'decide') THEN revision + 1 ELSE revision END,
    CASE WHEN r = 'ok' AND request IN ('claim', 'begin') THEN sec + {LEASE} WHEN r = 'ok' AND request <> 'decide' THEN NULL ELSE lease END, r
  FROM (
    SELECT q.s, q.i, q.n, q.sec, q.request, q.decision, f.status, f.revision, f.lease, CASE
      WHEN q.request = 'create' THEN CASE WHEN f.status IS NULL THEN 'ok' ELSE 'invalid_state' END
      WHEN f.status IS NULL THEN 'not_found'
      WHEN q.request = 'claim' THEN CASE WHEN f.status = 'analysis_failed' OR f.status = 'analyzing' AND (f.lease IS NULL OR f.lease < q.sec) THEN 'ok' ELSE 'busy' END
      WHEN q.request = 'complete' THEN CASE WHEN f.status = 'analyzing' THEN 'ok' ELSE 'invalid_state' END
      WHEN q.request = 'fail' THEN CASE WHEN f.status = 'analyzing' THEN 'ok' ELSE 'ignored' END
      WHEN q.request = 'decide' THEN CASE WHEN f.status NOT IN ('awaiting_review', 'finalized') THEN 'invalid_state' WHEN f.revision <> q.expected THEN 'stale_review' ELSE 'ok' END
      WHEN q.request = 'begin' THEN CASE WHEN f.revision <> q.expected THEN 'stale_review' WHEN f.status = 'finalizing' AND coalesce(f.lease, 0) > q.sec THEN 'busy'
        WHEN f.status NOT IN ('awaiting_review', 'finalized', 'finalizing') THEN 'invalid_state' ELSE 'ok' END
      WHEN q.request = 'abort' THEN CASE WHEN f.status = 'finalizing' THEN 'ok' ELSE 'ignored' END
      ELSE 'ok' END AS r
    FROM f JOIN q ON q.s = f.s AND q.i = f.i + 1) x)"""


def _requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS)).cast("int"))
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.join(first, "user_id").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("n"), at.alias("at"), F.when(F.col("event_id") == F.col("first"), "create").otherwise(kind).alias("request"),
        (F.col("event_id") % 4).alias("expected"), F.when(F.col("event_id") % 3 == 0, "FAIL").otherwise("PASS").alias("decision"),
    )


@query(f"{_FOLD} SELECT s AS session_id, n, result FROM f WHERE i > 0")
def session_outcomes(spark, sf_dir):
    """What became of each request: states, leases and revisions folded in order."""
    return sessions.outcomes(sessions.folded(_requests(spark, sf_dir), LEASE))


@query(f"{_FOLD} SELECT s AS session_id, status, revision, lease FROM f QUALIFY row_number() OVER (PARTITION BY s ORDER BY i DESC) = 1")
def session_ends(spark, sf_dir):
    return sessions.folded(_requests(spark, sf_dir), LEASE).select("session_id", "status", "revision", "lease")


_STEPS = [s for s, _ in sessions.STEPS]


@query(f"""WITH d AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(_STEPS))}) v(place, step)),
st AS (SELECT user_id, max(event_id) AS since FROM events WHERE event_type = 'signup' GROUP BY user_id),
r AS (SELECT e.user_id, e.event_id, event_id % 6 AS place, props FROM events e JOIN st ON st.user_id = e.user_id WHERE event_type <> 'signup' AND event_id > since AND event_id % 6 < 5),
c AS (SELECT st.user_id, coalesce(max(place), 0) AS here FROM st LEFT JOIN r ON r.user_id = st.user_id GROUP BY st.user_id)
SELECT c.user_id AS session_id, d.step, CASE WHEN d.place < here THEN 'done' WHEN d.place > here THEN 'pending' WHEN c.user_id % 3 = 1 THEN 'failed' ELSE 'active' END AS state,
  arg_max(r.props, r.event_id) AS detail, min(r.event_id) AS first_event
FROM c CROSS JOIN d LEFT JOIN r ON r.user_id = c.user_id AND r.place = d.place WHERE c.user_id % 3 < 2 GROUP BY c.user_id, d.step, d.place, here""")
def run_progress(spark, sf_dir):
    """The five steps of each unfinished run with states, first times and latest details."""
    e = table(spark, sf_dir, "events")
    step = F.coalesce(F.get(F.array(*map(F.lit, _STEPS)), (F.col("event_id") % 6).cast("int")), F.lit("unknown_step"))
    event = F.when(F.col("event_type") == "signup", "analysis_started").otherwise("analysis_progress")
    rows = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("n"), F.col("event_id").alias("at"), event.alias("event"), step.alias("step"), F.col("props").alias("detail"))
    status = F.when(F.col("session_id") % 3 == 0, sessions.ANALYZING).when(F.col("session_id") % 3 == 1, sessions.FAILED).otherwise(sessions.FINALIZED)
    out = sessions.progress(rows, rows.select("session_id").distinct().withColumn("status", status))
    return out.select("session_id", "step", "state", "detail", F.col("step_started_at").alias("first_event"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_comment FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS l_comment, l_returnflag FROM lineitem) x WHERE l_returnflag <> 'R')
SELECT l_orderkey AS session_id, sha256('v' || l_orderkey || '#' || string_agg('edt_' || l_linenumber || ':' || sha256(l_comment), '|' ORDER BY 'edt_' || l_linenumber || ':' || sha256(l_comment))) AS key FROM a GROUP BY l_orderkey""")
def accepted_set_keys(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    rows = l.select(F.col("l_orderkey").alias("session_id"), F.concat(F.lit("v"), "l_orderkey").alias("version"), F.concat(F.lit("edt_"), "l_linenumber").alias("edit_id"), F.col("l_partkey").cast("string").alias("new_text"))
    return sessions.accepted_set_keys(rows)


@query("""SELECT o_custkey AS session_id, o_orderkey AS finalization_id, CASE WHEN o_orderstatus = 'F' THEN 'blocked' WHEN o_orderkey % 3 = 0 THEN 'finalize_again'
  WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'acknowledge' ELSE 'ready' END AS download
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def download_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    latest = o.groupBy(F.col("o_custkey").alias("session_id")).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("f")).select("session_id", "f.*")
    decision = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "P", "REVIEW_REQUIRED").otherwise("PASS")
    seen = F.when(F.col("o_orderkey") % 2 != 0, F.lit("2024"))
    rows = latest.select("session_id", F.col("o_orderkey").alias("finalization_id"), decision.alias("decision"), (F.col("o_orderkey") % 3 != 0).alias("is_current"), seen.alias("acknowledged_at"))
    return sessions.download_state(rows).select("session_id", "finalization_id", "download")


@query("""SELECT c_custkey AS session_id, coalesce(o.n, 0) AS finalizations, coalesce(l.n, 0) AS proposals, coalesce(e.n, 0) AS events, o.latest AS finalization_id FROM customer c
  LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) l ON l.o_custkey = c_custkey
  LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON user_id = c_custkey""")
def session_views(spark, sf_dir):
    """Everything that belongs to a session, counted by key before it is joined."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("finalization_id"), F.col("o_orderstatus").alias("decision"), F.col("o_orderdate").alias("created_at"))
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("finalization_id")).select("session_id")
    events = t("events").select(F.col("user_id").alias("session_id"))
    out = sessions.session_view(t("customer").select(F.col("c_custkey").alias("session_id")), lines, events, orders, events.limit(0))
    return out.select("session_id", "finalizations", "proposals", "events", F.col("latest.finalization_id").alias("finalization_id"))


_SCORES = """s AS (SELECT conv_id, turn, length(text) % 5 + 1 AS f, (length(text) // 5) % 5 + 1 AS m, (length(text) // 7) % 5 + 1 AS w, turn % 5 + 1 AS j, text LIKE '%?%' AS claims FROM conversations),
g AS (SELECT *, f <= 2 OR m <= 2 OR claims AS flagged, NOT claims AND f >= 4 AND m >= 4 AS passed FROM s)"""


def _scores(spark, sf_dir):
    c, n = table(spark, sf_dir, "conversations"), F.length("text")
    at = lambda d: (F.floor(n / d) % 5 + 1).cast("int")
    claims = F.when(F.col("text").contains("?"), F.array(F.lit("a claim"))).otherwise(F.array().cast("array<string>"))
    rows = c.select("conv_id", "turn", at(1).alias("faithfulness"), at(5).alias("meaning_preservation"), at(7).alias("writing_quality"), (F.col("turn") % 5 + 1).cast("int").alias("job_relevance"), claims.alias("unsupported_claims"))
    return evaluation.judged(rows)


@query(f"WITH {_SCORES} SELECT conv_id, turn, flagged, passed FROM g")
def judged_edits(spark, sf_dir):
    return _scores(spark, sf_dir).select("conv_id", "turn", "flagged", "passed")


@query(f"WITH {_SCORES} SELECT count(*) AS judged_edits, round(avg(CAST(passed AS INTEGER)), 4) AS pass_share, round(avg(f), 2) AS faithfulness, round(avg(m), 2) AS meaning_preservation, round(avg(w), 2) AS writing_quality, round(avg(j), 2) AS job_relevance FROM g")
def judge_live_run(spark, sf_dir):
    return evaluation.judge_live(_scores(spark, sf_dir))


@query(f"""WITH {_SCORES}, k AS (SELECT conv_id % 2 = 0 AS fabricated, CASE WHEN turn <> 4 THEN flagged END AS flagged FROM g)
SELECT count(*) AS cases, count(*) FILTER (flagged IS NULL) AS errors, round(count(*) FILTER (flagged = fabricated) / greatest(1, count(*)), 4) AS score,
  round(count(*) FILTER (flagged AND fabricated) / greatest(1, count(*) FILTER (flagged IS NOT NULL AND fabricated)), 4) AS recall,
  round(count(*) FILTER (flagged AND NOT fabricated) / greatest(1, count(*) FILTER (flagged IS NOT NULL AND NOT fabricated)), 4) AS false_alarm_rate FROM k""")
def judge_calibration(spark, sf_dir):
    """Errors count as wrong in the score, and not at all in recall and false alarms."""
    rows = _scores(spark, sf_dir).select((F.col("conv_id") % 2 == 0).alias("fabricated"), F.when(F.col("turn") != 4, F.col("flagged")).alias("flagged"))
    return evaluation.judge_calibration(rows).select("cases", "errors", "score", "recall", "false_alarm_rate")


@query("""WITH r AS (SELECT CASE WHEN quality = 1 THEN 'accept' WHEN toxic = 1 THEN 'unsupported_term' ELSE 'too_long' END AS expected,
  CASE WHEN n_chars >= 400 THEN 'accept' WHEN n_chars >= 300 THEN 'accept_confirm' WHEN n_chars >= 100 THEN 'unsupported_term' ELSE 'too_long' END AS actual, toxic = 1 AS claim FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS cases, round(count(*) FILTER (expected = actual) / count(*), 4) AS agreement, round(count(*) FILTER (claim AND actual <> 'accept') / greatest(1, count(*) FILTER (claim)), 4) AS claim_block_rate,
  round(count(*) FILTER (expected = 'accept' AND actual NOT IN ('accept', 'accept_confirm')) / greatest(1, count(*) FILTER (expected = 'accept')), 4) AS false_rejection_rate FROM r""")
def labelled_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    expected = F.when(F.col("quality") == 1, "accept").when(F.col("toxic") == 1, "unsupported_term").otherwise("too_long")
    n = F.col("n_chars")
    actual = F.when(n >= 400, "accept").when(n >= 300, "accept_confirm").when(n >= 100, "unsupported_term").otherwise("too_long")
    out = evaluation.labelled_metrics(rows.select(expected.alias("expected"), actual.alias("actual"), (F.col("toxic") == 1).alias("claim")))
    return out.select("cases", "agreement", "claim_block_rate", "false_rejection_rate")


@query("""WITH a AS (SELECT event_type, event_id % 5 > 0 AS valid, event_id % 7 AS proposed, event_id % 3 AS accepted, value FROM events)
SELECT count(*) AS runs, round(count(*) FILTER (valid) / count(*), 4) AS valid_rate, CAST(sum(proposed) AS BIGINT) AS proposed, CAST(sum(accepted) AS BIGINT) AS accepted, round(sum(accepted) / sum(proposed), 4) AS acceptance_rate,
  list_sort(list(value))[count(value) // 2 + 1] AS latency_ms FROM a""")
def live_run_metrics(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select((i % 5 > 0).alias("valid"), (i % 7).alias("proposed"), (i % 3).alias("accepted"), F.col("value").alias("latency_ms"))
    return evaluation.live_metrics(rows)


@query("""WITH p AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[^ \\t\\n\\r]+'), lambda t: trim(t, '()[]{}"''`,;:!?.')), lambda t: regexp_matches(t, '[A-Za-z0-9][-/][A-Za-z0-9]')))) AS t FROM documents),
  q AS (SELECT doc_id, regexp_replace(lower(t), '[^a-z0-9+#]', '', 'g') AS key, list_filter(regexp_split_to_array(t, '[-/]'), lambda x: regexp_matches(lower(x), '[a-z0-9+#]')) AS parts FROM p)
  SELECT DISTINCT doc_id, key, array_to_string(parts, '|') AS parts, len(list_filter(parts, lambda x: regexp_matches(x, '[\\p{Nd}\\p{Lu}+#]'))) AS named FROM q WHERE len(parts) > 1""")
def compound_terms(spark, sf_dir):
    """Words joined by hyphens or strokes, with their parts, and how many of these look like names."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.compound_parts(F.col("text"))).alias("c"))
    return found.select("doc_id", "c.key", F.array_join("c.parts", "|").alias("parts"), F.size(F.filter("c.parts", T.looks_named)).cast("long").alias("named")).distinct()


@query(f"WITH {BLOCKS} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY ord) FILTER (text <> '')) AS text_hash, count(*) AS paragraphs, count(*) FILTER (trim(text) <> '') AS editable_paragraphs FROM blocks GROUP BY doc_id")
def full_texts(spark, sf_dir):
    """Each document's text joined again from its blocks, with the summary of its paragraphs."""
    b = B.blocks(table(spark, sf_dir, "documents"))
    line = F.when(F.col("text") != "", F.struct("ord", "text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n")
    out = b.groupBy("doc_id").agg(F.sha2(whole, 256).alias("h"), F.count(line).alias("n"), F.count("*").alias("paragraphs"), F.count_if("editable").alias("editable_paragraphs"))
    return out.select("doc_id", F.when(F.col("n") > 0, F.col("h")).alias("text_hash"), "paragraphs", "editable_paragraphs")


@query("""SELECT event_id, '<redacted:' || length(props) || ' chars>' AS text, '<redacted:' || length(event_type) || ' chars>' AS prompt, event_type AS step, CAST(user_id AS VARCHAR) AS who FROM events""")
def redacted_records(spark, sf_dir):
    """Log records with nested fields and a map, content keys replaced wherever they stand."""
    e = table(spark, sf_dir, "events")
    data = F.create_map(F.lit("prompt"), F.col("event_type"), F.lit("step"), F.col("event_type"))
    rows = stores.redacted_log(e.select("event_id", F.struct(F.col("props").alias("text"), F.struct(F.col("user_id").cast("string").alias("who")).alias("of")).alias("fields"), data.alias("data")))
    return rows.select("event_id", F.col("fields.text").alias("text"), F.col("data")["prompt"].alias("prompt"), F.col("data")["step"].alias("step"), F.col("fields.of.who").alias("who"))


_PROMPT = "<job>{job}</job>\n<resume>{resume}</resume>"


@query("""SELECT conv_id, turn, '<job>' || CASE WHEN role = 'user' THEN '(none)' ELSE role END || '</job>' || chr(10) || '<resume>' || replace(text || '</resume>', '</', '<' || chr(8203) || '/') || '</resume>' || CASE WHEN turn > 2 THEN ' (cut)' ELSE '' END AS prompt FROM conversations""")
def rendered_prompts(spark, sf_dir):
    """Turns as untrusted text in a template: none of them can close its delimiter."""
    c = table(spark, sf_dir, "conversations")
    job = F.when(F.col("role") == "user", " ").otherwise(F.col("role"))
    return c.select("conv_id", "turn", T.prompt(_PROMPT, F.col("turn") > 2, " (cut)", job=job, resume=F.concat("text", F.lit("</resume>"))).alias("prompt"))
