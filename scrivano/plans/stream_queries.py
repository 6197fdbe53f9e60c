"""Streams run to the end of their input: sessions as state, steps of runs, an event store, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import edit_rules as R
from ..operators import observed, sessions, upload_rules
from ..sources import event_store, package_source
from ..sources.tables import scratch, stored, table
from ..streaming import progress, session_state
from .record_queries import _FOLD, _KINDS, LEASE
from .text_queries import GREEDY

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _events(spark, sf_dir):
    # A pattern, as the stream source takes no single file's path.
    return progress.events(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema, None)


def _drained(stream, spark, mode: str):
    """What a stream has put out once its input is read, by way of the event store."""
    folder = scratch(spark)
    event_store.appended(stream, folder, mode).awaitTermination()
    return event_store.latest(spark, folder, stream.schema) if mode == "complete" else event_store.stored(spark, folder, stream.schema)


@query(f"""{_FOLD}, timed AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)
SELECT s AS session_id, n, result, status, revision, lease FROM f JOIN timed ON event_id = n WHERE t <= (SELECT max(t) - INTERVAL 1 HOUR FROM timed)""")
def session_stream(spark, sf_dir):
    """Every session's requests folded as a stream: those that the watermark has passed."""
    e = _events(spark, sf_dir)
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first"))
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS)).cast("int"))
    requests = e.join(first, "user_id").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("n"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
        F.when(F.col("event_id") == F.col("first"), "create").otherwise(kind).alias("request"), (F.col("event_id") % 4).alias("expected"),
        F.when(F.col("event_id") % 3 == 0, "FAIL").otherwise("PASS").alias("decision"),
    )
    with session_state.provider(spark):
        out = _drained(session_state.outcomes(requests, LEASE), spark, "append")
    return out.where("n IS NOT NULL")


@query("""WITH s AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS started, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id)
SELECT s.user_id, started, event_type AS step, s.event_id, n FROM s JOIN events e ON e.event_id = s.event_id""")
def steps_reached(spark, sf_dir):
    """Each user's latest step as a running aggregate of a stream, put out whole with each batch."""
    return _drained(progress.steps_reached(_events(spark, sf_dir)), spark, "complete")


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY ALL")
def event_store_view(spark, sf_dir):
    """All events appended to a store in two runs, a snapshot of counts taken between them, and the view folded from the snapshot and what came since."""
    events, folder = table(spark, sf_dir, "events"), scratch(spark)
    view = event_store.View(("user_id", "event_type"), (F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")), {"n": F.sum, "first_event": F.min, "last_event": F.max})
    event_store.append(events.where("event_type IN ('view', 'click')"), folder, 0)
    event_store.snapshot(spark, folder, view, events.schema)
    event_store.append(events.where("event_type NOT IN ('view', 'click')"), folder, 1)
    event_store.append(events.where("event_type NOT IN ('view', 'click')"), folder, 1)  # a batch that is run again
    return event_store.folded(spark, folder, view, events.schema)


@query("""SELECT doc_id, part, octet_length(encode(body)) AS size, sha256(body) AS digest FROM (
  SELECT doc_id, 'text.txt' AS part, coalesce(text, '') AS body FROM documents
  UNION ALL SELECT doc_id, 'about.xml', '<about lang="' || coalesce(lang, '') || '"/>' FROM documents) d""")
def package_members(spark, sf_dir):
    """Every document written as a package of three members by the sink, two of which are read again by the source."""
    d = table(spark, sf_dir, "documents")
    member = lambda n, part, body: F.struct(F.lit(n).alias("ord"), F.lit(part).alias("part"), F.coalesce(body, F.lit("")).cast("binary").alias("content"))
    about = F.concat(F.lit('<about lang="'), F.coalesce("lang", F.lit("")), F.lit('"/>'))
    parts = d.select(F.col("doc_id").cast("string").alias("path"), F.inline(F.array(member(0, "about.xml", about), member(1, "media/picture.bin", F.repeat("text", 3)), member(2, "text.txt", F.col("text")))))
    folder = scratch(spark)
    package_source.write(parts, folder)
    found = package_source.members(spark, folder, ["text.txt"], [".xml"])
    return found.select(F.col("path").cast("long").alias("doc_id"), "part", F.col("actual").alias("size"), F.sha2("content", 256).alias("digest"))


@query(f"""WITH {GREEDY} SELECT step, what, CAST(value AS BIGINT) AS value FROM (
  SELECT 'read' AS step, 'rows' AS what, count(*) AS value FROM documents UNION ALL SELECT 'read', 'characters', sum(length(text)) FROM documents
  UNION ALL SELECT 'blocks', 'rows', count(*) FROM blocks UNION ALL SELECT 'blocks', 'editable', count(*) FILTER (trim(text) <> '') FROM blocks
  UNION ALL SELECT 'edits', 'rows', count(*) FROM edits UNION ALL SELECT 'taken', 'rows', count(*) FROM taken) x""")
def observed_counts(spark, sf_dir):
    """What passes each step from documents to edits taken, counted while the one action runs that stores them."""
    told = []
    steps = observed.Steps(lambda name, counts: told.append((name, counts)))
    d = steps.step(table(spark, sf_dir, "documents"), "read", characters=F.sum(F.length("text")))
    b = steps.step(B.blocks(d), "blocks", editable=F.count_if("editable"))
    taken = steps.step(R.greedy(steps.step(B.edits(b), "edits")), "taken")
    stored(taken)
    steps.done()
    return observed.as_table(spark, told)


@query("""SELECT o_custkey AS session_id, o_orderkey AS n, o_orderkey AS edit_id, 'loc_' || o_orderpriority AS location_id, o_orderstatus AS original_text, upper(o_orderpriority) AS new_text FROM orders WHERE o_orderstatus <> 'F'""")
def edit_specs(spark, sf_dir):
    """Accepted edits of each session with what their proposals say; one that no proposal has would end the query."""
    o = table(spark, sf_dir, "orders")
    own = [F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("edit_id")]
    proposals = o.select(*own, F.concat(F.lit("loc_"), "o_orderpriority").alias("location_id"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("o_orderstatus").alias("original"), F.upper("o_orderpriority").alias("proposed"))
    wanted = o.where("o_orderstatus <> 'F'").select(*own, F.col("o_orderkey").alias("n"))
    return sessions.edit_specs(wanted, proposals).select("session_id", "n", "edit_id", "location_id", "original_text", "new_text")


@query("""WITH f AS (SELECT doc_id, text AS job, string_split(text, chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, CASE WHEN trim(coalesce(job, '')) = '' THEN 'job_description' WHEN length(job) > 20000 THEN 'job_description' WHEN length(ls[1]) > 300 THEN 'company_details' WHEN length(ls[len(ls)]) > 200 THEN 'candidate_notes' END AS field,
  length(job) > 20000 AS long FROM f)
SELECT doc_id, 'input_too_long' AS code, field, CASE field WHEN 'job_description' THEN CASE WHEN long THEN 20000 END WHEN 'company_details' THEN 300 ELSE 200 END AS "limit" FROM g WHERE field IS NOT NULL""")
def input_faults(spark, sf_dir):
    """Documents as the texts that come with an upload: the whole text, its first and its last line, against limits."""
    lines = F.split("text", "\n", -1)
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("job_description"), F.get(lines, F.lit(0)).alias("company_details"), F.element_at(lines, -1).alias("candidate_notes"))
    fault = upload_rules.input_fault({"job_description": 20_000, "company_details": 300, "candidate_notes": 200})
    return d.select("doc_id", fault.alias("f")).where("f IS NOT NULL").select("doc_id", "f.*")
