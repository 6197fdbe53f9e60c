"""Sessions as folds over their events: states, leases, revisions, progress, retention.

An event is a request; whether it takes effect depends on what those before it left behind, so a
session's events are folded in order.  The fold is one aggregate over a session's sorted array: a
session is one user's work on one document and has some hundreds of events.  Its log of results is copied with
each of them, which takes seconds at ten thousand (tested); streaming.session_state keeps no log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a session, and the steps of an analysis in order with their labels.
ANALYZING, FAILED, REVIEW, FINALIZING, FINALIZED = "analyzing", "analysis_failed", "awaiting_review", "finalizing", "finalized"
STEPS = (
    ("read_resume", "Reading your resume"), ("ask_model", "Asking the AI model for suggestions"), ("check_evidence", "Checking each suggestion against your resume"),
    ("estimate_coverage", "Estimating keyword coverage for the job"), ("save", "Preparing your review"),
)
#: What a request may be.
REQUESTS = ("create", "claim", "complete", "fail", "decide", "begin", "finish", "abort")
STATE = "struct<status:string,revision:bigint,lease:double,log:array<struct<n:bigint,result:string>>>"


def folded(requests: DataFrame, lease: float = 300.0) -> DataFrame:
    """session_id, status, revision, lease, log: the state after a session's requests, and what became of each.

    requests: session_id, n (their order), at (seconds), request (of REQUESTS), expected (a revision, for decide and
    begin), decision (for finish).  Results: ok, not_found, invalid_state, stale_review, busy, ignored.
    """

    def step(s: Column, e: Column) -> Column:
        status, revision, until, at = s["status"], s["revision"], s["lease"], e["at"]
        is_ = lambda name: e["request"] == name
        free = until.isNull() | (until < at)
        stale = ~revision.eqNullSafe(e["expected"])
        result = (
            F.when(is_("create"), F.when(status.isNull(), "ok").otherwise("invalid_state"))
            .when(status.isNull(), "not_found")
            .when(is_("claim"), F.when((status == FAILED) | (status == ANALYZING) & free, "ok").otherwise("busy"))
            .when(is_("complete"), F.when(status == ANALYZING, "ok").otherwise("invalid_state"))
            .when(is_("fail"), F.when(status == ANALYZING, "ok").otherwise("ignored"))
            .when(is_("decide"), F.when(~status.isin(REVIEW, FINALIZED), "invalid_state").when(stale, "stale_review").otherwise("ok"))
            .when(is_("begin"), F.when(stale, "stale_review").when((status == FINALIZING) & (F.coalesce(until, F.lit(0.0)) > at), "busy").when(~status.isin(REVIEW, FINALIZED, FINALIZING), "invalid_state").otherwise("ok"))
            .when(is_("finish"), "ok")
            .when(is_("abort"), F.when(status == FINALIZING, "ok").otherwise("ignored"))
            .otherwise("invalid_state")
        )

        def after(r: Column) -> Column:
            ok = r == "ok"
            new = (
                F.when(is_("create") | is_("claim"), ANALYZING).when(is_("complete") | is_("decide") | is_("abort"), REVIEW).when(is_("fail"), FAILED)
                .when(is_("begin"), FINALIZING).when(is_("finish"), F.when(e["decision"] == "FAIL", REVIEW).otherwise(FINALIZED))
            )
            return F.struct(
                F.when(ok, new).otherwise(status).alias("status"),
                F.when(ok & is_("create"), F.lit(0).cast("long")).when(ok & (is_("complete") | is_("decide")), revision + 1).otherwise(revision).alias("revision"),
                F.when(ok & (is_("claim") | is_("begin")), at + lease).when(ok & ~is_("decide"), F.lit(None)).otherwise(until).alias("lease"),
                F.array_append(s["log"], F.struct(e["n"].alias("n"), r.alias("result"))).alias("log"),
            )

        return F.get(F.transform(F.array(result), after), F.lit(0))

    item = F.struct(F.col("n").cast("long").alias("n"), F.col("at").cast("double").alias("at"), "request", F.col("expected").cast("long").alias("expected"), "decision")
    start = F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (("status", "string"), ("revision", "long"), ("lease", "double"))), F.array().cast("array<struct<n:bigint,result:string>>").alias("log"))
    state = F.aggregate(F.array_sort(F.collect_list(item)), start, step)
    return requests.groupBy("session_id").agg(state.alias("s")).select("session_id", "s.*")


def outcomes(folds: DataFrame) -> DataFrame:
    """session_id, n, result of each request."""
    return folds.select("session_id", F.explode("log").alias("l")).select("session_id", "l.*")


def progress(events: DataFrame, statuses: DataFrame) -> DataFrame:
    """session_id, started_at, step, label, state, detail, step_started_at: the steps of the latest run of sessions that analyze or failed.

    events: session_id, n, at, event, step, detail.  A step keeps its first time and its latest detail; the furthest
    step reached is active, or failed; those before it are done.
    """
    started = events.where("event = 'analysis_started'").groupBy("session_id").agg(F.max("n").alias("from"), F.max_by("at", "n").alias("started_at"))
    started = started.join(statuses.where(F.col("status").isin(ANALYZING, FAILED)).select("session_id", "status"), "session_id")
    place = F.array_position(F.array(*(F.lit(s) for s, _ in STEPS)), F.col("step")).cast("int") - 1
    reached = events.where("event = 'analysis_progress'").withColumn("place", place).where("place >= 0").join(started, "session_id").where("n > from")
    by_step = reached.groupBy("session_id", "place").agg(F.min_by("at", "n").alias("step_started_at"), F.max_by("detail", "n").alias("detail"))
    current = by_step.groupBy("session_id").agg(F.max("place").alias("current"))
    domain = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(s).alias("step"), F.lit(label).alias("label")) for i, (s, label) in enumerate(STEPS)))
    every = started.join(current, "session_id", "left").select("session_id", "status", "started_at", F.coalesce("current", F.lit(0)).alias("current"), F.inline(domain))
    state = F.when(F.col("place") < F.col("current"), "done").when(F.col("place") > F.col("current"), "pending").when(F.col("status") == FAILED, "failed").otherwise("active")
    return every.join(by_step, ["session_id", "place"], "left").select("session_id", "started_at", "place", "step", "label", state.alias("state"), "detail", "step_started_at")


def replaced_proposals(proposals: DataFrame) -> DataFrame:
    """The proposals of each session's last completed run, by position: a run's completion deletes those before it.

    proposals: session_id, run (null for one that never completed), position and others.
    """
    last = proposals.groupBy("session_id").agg(F.max("run").alias("run"))
    return proposals.join(last, ["session_id", "run"])


def decided(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposals with their latest decision (pending without one); decisions (session_id, edit_id, n, decision) of unknown edits take no effect."""
    last = decisions.groupBy("session_id", "edit_id").agg(F.max_by("decision", "n").alias("decision"))
    return proposals.join(last, ["session_id", "edit_id"], "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def decision_faults(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """session_id, request, edit_id, code: an edit that is named twice in one request, or that the session does not have."""
    twice = F.count("*").over(Window.partitionBy("session_id", "request", "edit_id")) > 1
    known = proposals.select("session_id", "edit_id", F.lit(True).alias("known")).distinct()
    code = F.when(F.col("twice"), "duplicate_item").when(F.col("known").isNull(), "not_found")
    return decisions.withColumn("twice", twice).join(known, ["session_id", "edit_id"], "left").select("session_id", "request", "edit_id", code.alias("code")).where("code is not null").distinct()


def accepted_set_keys(accepted: DataFrame) -> DataFrame:
    """session_id, key of the set of accepted edits (session_id, version, edit_id, new_text), whatever their order."""
    parts = F.array_sort(F.collect_list(F.concat("edit_id", F.lit(":"), F.sha2("new_text", 256))))
    return accepted.groupBy("session_id", "version").agg(F.sha2(F.concat("version", F.lit("#"), F.array_join(parts, "|")), 256).alias("key")).select("session_id", "key")


def reused(wanted: DataFrame, finalizations: DataFrame) -> DataFrame:
    """wanted (session_id, key) with finalization_id of the result that the same set had before, null where it must be computed."""
    first = finalizations.groupBy("session_id", "key").agg(F.min_by("finalization_id", F.struct("created_at", "finalization_id")).alias("finalization_id"))
    return wanted.join(first, ["session_id", "key"], "left")


def acknowledged(finalizations: DataFrame, requests: DataFrame) -> DataFrame:
    """session_id, finalization_id, result of requests to acknowledge: ok for results that ask for review, else invalid_state."""
    f = finalizations.select("session_id", "finalization_id", "decision")
    result = F.when(F.col("decision") == "REVIEW_REQUIRED", "ok").otherwise("invalid_state")
    return requests.join(f, ["session_id", "finalization_id"], "left").select("session_id", "finalization_id", result.alias("result"))


def download_state(latest: DataFrame) -> DataFrame:
    """latest with download: blocked, finalize_again, acknowledge or ready, of decision, is_current and acknowledged_at."""
    rule = F.when(F.col("decision") == "FAIL", "blocked").when(~F.col("is_current"), "finalize_again").when((F.col("decision") == "REVIEW_REQUIRED") & F.col("acknowledged_at").isNull(), "acknowledge").otherwise("ready")
    return latest.withColumn("download", rule)


def purged(rows: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """rows of a table with session_id without those of expired sessions (session_id, expires_at)."""
    return rows.join(sessions.where(F.col("expires_at") < now).select("session_id"), "session_id", "left_anti")


def session_view(sessions: DataFrame, proposals: DataFrame, events: DataFrame, finalizations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row a session with counts of what belongs to it, and its latest finalization: each table is counted by key before the join."""
    n = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    latest = finalizations.groupBy("session_id").agg(F.count("*").alias("finalizations"), F.max_by(F.struct("finalization_id", "decision"), F.struct("created_at", "finalization_id")).alias("latest"))
    out = sessions
    for t in (n(proposals, "proposals"), n(events, "events"), n(artifacts, "artifacts"), latest):
        out = out.join(t, "session_id", "left")
    return out.na.fill(0, ["proposals", "events", "artifacts", "finalizations"])


def edit_specs(wanted: DataFrame, proposals: DataFrame) -> DataFrame:
    """session_id, n, edit_id, location_id, start, end, original_text, new_text of wanted edits (session_id, n, edit_id); an edit that its
    session does not have ends the query with an error that names it."""
    own = proposals.select("session_id", "edit_id", "location_id", "start", "end", F.col("original").alias("original_text"), F.col("proposed").alias("new_text"), F.lit(True).alias("known"))
    both = wanted.select("session_id", "n", "edit_id").join(own, ["session_id", "edit_id"], "left")
    unknown = F.raise_error(F.concat(F.lit("unknown edit "), F.coalesce(F.col("edit_id").cast("string"), F.lit("null"))))
    sure = F.when(F.col("known"), F.col("location_id")).otherwise(unknown.cast("string"))
    return both.select("session_id", "n", "edit_id", sure.alias("location_id"), "start", "end", "original_text", "new_text")
