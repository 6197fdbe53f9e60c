"""Relational plans: DataFrame operations in Spark, and for each a DuckDB statement written on its own.

The driver's tables stand in for logs, decisions and findings; see README.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation
from ..sources.tables import table

#: DuckDB statements; {name} stands for the table's view.
STATEMENTS = {
    # Latest finalization: newest first, ties by the later key.
    "latest_finalization": """
        SELECT o_custkey, o_orderkey, o_orderstatus FROM (
          SELECT o_custkey, o_orderkey, o_orderstatus,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {orders}) t
        WHERE r = 1""",
    # Best attempt: longest reply, fewest question marks, earliest turn.
    "best_attempt": """
        SELECT conv_id, turn, valid FROM (
          SELECT conv_id, turn, valid, row_number() OVER (PARTITION BY conv_id ORDER BY valid DESC, rejected, turn) AS r FROM (
            SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS valid, length(text) - length(replace(text, '?', '')) AS rejected FROM {conversations}) a) t
        WHERE r = 1""",
    # Counts by status with zero for what does not occur.
    "decision_counts_zero_filled": """
        SELECT d.status, coalesce(c.n, 0) AS n FROM (
          SELECT 'F' AS status UNION ALL SELECT 'O' UNION ALL SELECT 'P' UNION ALL SELECT 'X') d
        LEFT JOIN (SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY o_orderstatus) c ON d.status = c.status""",
    # Sessions: state after the last event that decides it.
    "session_state": """
        SELECT user_id, event_type AS state, n_events FROM (
          SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n_events,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) t
        WHERE r = 1""",
    # Stale revisions: an event that expects a revision other than the session's current one.
    "stale_revision_rejects": """
        SELECT event_id, user_id, CAST(revision AS BIGINT) AS revision FROM (
          SELECT event_id, user_id, event_id % 7 AS expected,
                 sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS revision
          FROM {events}) t
        WHERE revision IS NOT NULL AND revision % 7 <> expected""",
    # Progress of the latest run: events since the last signup, first time and count of each step.
    "analysis_progress": """
        SELECT e.user_id, e.event_type AS step, min(e.event_id) AS first_event, count(*) AS n FROM {events} e
        JOIN (SELECT user_id, max(event_id) AS started FROM {events} WHERE event_type = 'signup' GROUP BY user_id) s
          ON e.user_id = s.user_id AND e.event_id > s.started
        GROUP BY e.user_id, e.event_type""",
    "idempotent_dedup": """
        SELECT user_id, event_type, min(event_id) AS event_id FROM {events} GROUP BY user_id, event_type""",
    "expired_sessions": """
        SELECT user_id, count(*) AS n_events FROM {events} GROUP BY user_id
        HAVING max(ts) < (SELECT max(ts) - INTERVAL '1' HOUR FROM {events})""",
    # Upper median: the element at n div 2, not interpolated.
    "upper_median_by_group": """
        SELECT event_type, value AS upper_median FROM (
          SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r,
                 count(*) OVER (PARTITION BY event_type) AS n FROM {events}) t
        WHERE r = CAST(floor(n / 2) AS BIGINT) + 1""",
    # Agreement of a rule with labels, as counts.
    "label_agreement": """
        SELECT l.quality, count(*) AS n, sum(CASE WHEN d.n_chars >= 60 THEN 1 ELSE 0 END) AS accepted,
               sum(CASE WHEN (d.n_chars >= 60) = (l.quality = 1) THEN 1 ELSE 0 END) AS agreed
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY l.quality""",
    "judge_metrics": """
        SELECT count(*) AS n, sum(CASE WHEN toxic = 1 AND flagged = 1 THEN 1 ELSE 0 END) AS hits,
               sum(CASE WHEN toxic = 0 AND flagged = 1 THEN 1 ELSE 0 END) AS false_alarms, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS positives
        FROM (SELECT l.toxic, CASE WHEN d.text LIKE '%pathetic%' OR d.text LIKE '%moron%' OR d.text LIKE '%loser%' THEN 1 ELSE 0 END AS flagged
              FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id) t""",
    # 3 x 3 x 3 thresholds: detections and false alarms of each.
    "threshold_sweep": """
        SELECT a.a, b.b, c.c, sum(CASE WHEN e.value > a.a AND e.event_id % 10 >= b.b AND e.user_id % 10 >= c.c THEN 1 ELSE 0 END) AS flagged, count(*) AS n
        FROM {events} e
        CROSS JOIN (SELECT 10 AS a UNION ALL SELECT 50 UNION ALL SELECT 100) a
        CROSS JOIN (SELECT 2 AS b UNION ALL SELECT 4 UNION ALL SELECT 6) b
        CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 3 UNION ALL SELECT 5) c
        GROUP BY a.a, b.b, c.c""",
    # Gate status: any error fails, any warning asks for review; no findings pass.
    "gate_status": """
        SELECT o.o_orderkey AS case_id, CASE coalesce(max(f.rank), 0) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS status, count(f.rank) AS findings
        FROM {orders} o LEFT JOIN (
          SELECT l_orderkey, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 2 WHEN l_discount > 0.09 THEN 1 END AS rank FROM {lineitem}
          WHERE l_returnflag = 'R' AND l_quantity > 45 OR l_discount > 0.09) f ON o.o_orderkey = f.l_orderkey
        GROUP BY o.o_orderkey""",
    # Decision over three gates of a case.
    "delivery_decision": """
        SELECT l_orderkey AS case_id, CASE WHEN max(a) + max(b) > 0 THEN 'FAIL' WHEN max(c) = 1 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS decision
        FROM (SELECT l_orderkey, CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END AS a, CASE WHEN l_tax > 0.075 AND l_returnflag = 'R' THEN 1 ELSE 0 END AS b,
                     CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS c FROM {lineitem}) t
        GROUP BY l_orderkey""",
    # Two versions of a package: parts added, removed, changed.
    "part_diff": """
        SELECT coalesce(a.k, b.k) AS part, CASE WHEN a.k IS NULL THEN 'part_added' WHEN b.k IS NULL THEN 'part_removed' ELSE 'unexpected_part_change' END AS code
        FROM (SELECT p_partkey AS k, p_size AS v FROM {part} WHERE p_partkey % 50 <> 1) a
        FULL OUTER JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 40 = 3 THEN p_size + 1 ELSE p_size END AS v FROM {part} WHERE p_partkey % 60 <> 2) b ON a.k = b.k
        WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""",
    "accepted_without_verdict": """
        SELECT o.o_orderkey FROM {orders} o LEFT ANTI JOIN (SELECT l_orderkey FROM {lineitem} WHERE l_linestatus = 'F') l ON o.o_orderkey = l.l_orderkey""",
    "accepted_and_rejected": """
        SELECT o.o_orderkey FROM {orders} o LEFT SEMI JOIN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'O'""",
    # Equal sizes as bags, both sides counted.
    "graphics_bag": """
        SELECT coalesce(a.w, b.w) AS size, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after
        FROM (SELECT p_size AS w, count(*) AS n FROM {part} GROUP BY p_size) a
        FULL OUTER JOIN (SELECT p_size AS w, count(*) AS n FROM {part} WHERE p_partkey % 17 <> 0 GROUP BY p_size) b ON a.w = b.w
        WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "redacted_log_view": """
        SELECT event_id, event_type, concat('<redacted:', CAST(length(props) AS VARCHAR(20)), ' chars>') AS props FROM {events}""",
    # Items that name a part outside the context given, with the reason; the others pass.
    "context_split": """
        SELECT l.l_orderkey, l.l_linenumber, CASE WHEN c.p_partkey IS NULL THEN 'not_in_context' END AS code
        FROM {lineitem} l LEFT JOIN (SELECT p_partkey FROM {part} WHERE p_size <= 25) c ON l.l_partkey = c.p_partkey""",
    # Lease: a claim takes a session unless the one before it is younger than five minutes.
    "lease_conflicts": """
        SELECT event_id, user_id FROM (
          SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events} WHERE event_type = 'click') t
        WHERE before IS NOT NULL AND ts < before + INTERVAL '5' MINUTE""",
    # First artifact of a kind: the earliest, ties by id.
    "first_of_kind": """
        SELECT user_id, event_type, event_id FROM (
          SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM {events}) t
        WHERE r = 1""",
    # Usage sums, null if zero.
    "usage_sums": """
        SELECT user_id, nullif(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0) AS errors, nullif(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 0) AS views
        FROM {events} GROUP BY user_id""",
    # Rejections by reason, and the share of each judgement, null without any.
    "rejection_histogram": """
        SELECT code_ AS code, count(*) AS n FROM (
          SELECT CASE WHEN l_quantity > 40 THEN 'over_limit' WHEN l_discount = 0 THEN 'no_change' WHEN l_returnflag = 'R' THEN 'duplicate_proposal' END AS code_ FROM {lineitem}) t
        WHERE code_ IS NOT NULL GROUP BY code_""",
    # Positional comparison of two versions: properties that differ, nulls being equal to nulls.
    "paired_property_changes": """
        SELECT a.o_orderkey, CASE WHEN a.s IS DISTINCT FROM b.s THEN 'status' ELSE 'priority' END AS property
        FROM (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM {orders}) a
        JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 1 THEN NULL ELSE o_orderstatus END AS s,
                     CASE WHEN o_orderkey % 37 = 1 THEN 'X' ELSE o_orderpriority END AS p FROM {orders}) b ON a.o_orderkey = b.o_orderkey
        WHERE a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p""",
    "duplicate_sources": """
        SELECT text, count(*) AS n FROM {documents} GROUP BY text HAVING count(*) > 1""",
}


QUERIES: dict = {}


def plan(*names: str):
    """Register a function of the named tables under its own name."""

    def keep(f):
        def run(spark, sf_dir):
            return f(*(table(spark, sf_dir, n) for n in names))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        return f

    return keep


def latest(df: DataFrame, keys: list[str], order: list, *kept: str) -> DataFrame:
    """The first row of each group in an order, of columns kept: an aggregate, so no group is sorted."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("r")).select(*keys, "r.*")


def _count_if(c):
    return F.count_if(F.coalesce(c, F.lit(False)))


@plan("orders")
def latest_finalization(o):
    first = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return first.select("o_custkey", "r.*")


@plan("conversations")
def best_attempt(c):
    marks = F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))
    rows = c.select("conv_id", "turn", F.length("text").cast("long").alias("valid"), marks.alias("rejected"))
    return latest(rows, ["conv_id"], [-F.col("valid"), F.col("rejected"), F.col("turn")], "turn", "valid")


@plan("orders")
def decision_counts_zero_filled(o):
    n = o.groupBy().pivot("o_orderstatus", ["F", "O", "P", "X"]).agg(F.count(F.lit(1)))
    return n.select(F.inline(F.array(*(F.struct(F.lit(x).alias("status"), F.coalesce(F.col(x), F.lit(0)).alias("n")) for x in "FOPX"))))


@plan("events")
def session_state(e):
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))


@plan("events")
def stale_revision_rejects(e):
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = e.withColumn("revision", F.sum((F.col("event_type") == "purchase").cast("long")).over(before))
    return rows.where((F.col("revision") % 7) != (F.col("event_id") % 7)).select("event_id", "user_id", "revision")


@plan("events")
def analysis_progress(e):
    signup = F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(Window.partitionBy("user_id"))
    run = e.withColumn("started", signup).where("event_id > started")
    return run.groupBy("user_id", F.col("event_type").alias("step")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@plan("events")
def idempotent_dedup(e):
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@plan("events")
def expired_sessions(e):
    by = e.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("ts").alias("last"))
    now = by.agg(F.max("last").alias("now"))  # one row, from the groups
    return by.join(F.broadcast(now)).where(F.expr("last < now - INTERVAL '1' HOUR")).select("user_id", "n_events")


@plan("events")
def upper_median_by_group(e):
    return evaluation.upper_medians(e, "event_type", "value")


@plan("labels", "documents")
def label_agreement(l, d):
    rows = l.join(d.select("doc_id", "n_chars"), "doc_id").withColumn("yes", F.col("n_chars") >= 60)
    return rows.groupBy("quality").agg(F.count("*").alias("n"), _count_if(F.col("yes")).alias("accepted"), _count_if(F.col("yes") == (F.col("quality") == 1)).alias("agreed"))


@plan("labels", "documents")
def judge_metrics(l, d):
    rows = l.join(d.select("doc_id", "text"), "doc_id").withColumn("flagged", F.col("text").rlike("pathetic|moron|loser"))
    toxic = F.col("toxic") == 1
    return rows.agg(F.count("*").alias("n"), _count_if(toxic & F.col("flagged")).alias("hits"), _count_if((F.col("toxic") == 0) & F.col("flagged")).alias("false_alarms"), _count_if(toxic).alias("positives"))


@plan("events")
def threshold_sweep(e):
    steps = lambda name, *values: F.explode(F.array(*map(F.lit, values))).alias(name)
    # rows are counted by what the thresholds can tell apart before they meet the 27 settings
    kinds = e.groupBy((F.when(F.col("value") > 100, 100).when(F.col("value") > 50, 50).when(F.col("value") > 10, 10).otherwise(0)).alias("v"), (F.col("event_id") % 10).alias("i"), (F.col("user_id") % 10).alias("u")).agg(F.count("*").alias("k"))
    settings = kinds.select("*", steps("a", 10, 50, 100)).select("*", steps("b", 2, 4, 6)).select("*", steps("c", 1, 3, 5))
    hit = (F.col("v") >= F.col("a")) & (F.col("i") >= F.col("b")) & (F.col("u") >= F.col("c"))
    return settings.groupBy("a", "b", "c").agg(F.sum(F.when(hit, F.col("k")).otherwise(0)).alias("flagged"), F.sum("k").alias("n"))


@plan("orders", "lineitem")
def gate_status(o, l):
    rank = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), 2).when(F.col("l_discount") > 0.09, 1)
    found = l.select(F.col("l_orderkey").alias("case_id"), rank.alias("rank")).where("rank is not null").groupBy("case_id").agg(F.max("rank").alias("worst"), F.count("*").alias("findings"))
    every = o.select(F.col("o_orderkey").alias("case_id")).join(found, "case_id", "left")
    status = F.when(F.col("worst") == 2, "FAIL").when(F.col("worst") == 1, "REVIEW_REQUIRED").otherwise("PASS")
    return every.select("case_id", status.alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"))


@plan("lineitem")
def delivery_decision(l):
    fails = (F.col("l_quantity") > 49) | (F.col("l_tax") > 0.075) & (F.col("l_returnflag") == "R")
    by = l.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.bool_or(fails).alias("fail"), F.bool_or(F.col("l_discount") > 0.08).alias("review"))
    return by.select("case_id", F.when(F.col("fail"), "FAIL").when(F.col("review"), "REVIEW_REQUIRED").otherwise("PASS").alias("decision"))


@plan("part")
def part_diff(p):
    k = F.col("p_partkey")
    a = p.where(k % 50 != 1).select(k.alias("part"), F.col("p_size").alias("a"))
    b = p.where(k % 60 != 2).select(k.alias("part"), (F.col("p_size") + (k % 40 == 3).cast("int")).alias("b"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "part", "full")
    code = F.when(F.col("in_a").isNull(), "part_added").when(F.col("in_b").isNull(), "part_removed").when(F.col("a") != F.col("b"), "unexpected_part_change")
    return both.select("part", code.alias("code")).where("code is not null")


@plan("orders", "lineitem")
def accepted_without_verdict(o, l):
    return o.join(l.where("l_linestatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@plan("orders", "lineitem")
def accepted_and_rejected(o, l):
    return o.where("o_orderstatus = 'O'").join(l.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@plan("part")
def graphics_bag(p):
    n = p.groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n_before"), F.count_if(F.col("p_partkey") % 17 != 0).alias("n_after"))
    return n.where("n_before <> n_after")


@plan("events")
def redacted_log_view(e):
    return e.select("event_id", "event_type", F.format_string("<redacted:%d chars>", F.length("props")).alias("props"))


@plan("lineitem", "part")
def context_split(l, p):
    known = p.where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    inside = l.join(known, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", F.lit(None).cast("string").alias("code"))
    outside = l.join(known, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", F.lit("not_in_context").alias("code"))
    return inside.unionByName(outside)


@plan("events")
def lease_conflicts(e):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.where("event_type = 'click'").withColumn("before", before).where("ts < before + INTERVAL '5' MINUTE").select("event_id", "user_id")


@plan("events")
def first_of_kind(e):
    return e.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@plan("events")
def usage_sums(e):
    n = lambda kind: F.nullif(F.count_if(F.col("event_type") == kind), F.lit(0))
    return e.groupBy("user_id").agg(n("error").alias("errors"), n("view").alias("views"))


@plan("lineitem")
def rejection_histogram(l):
    code = F.when(F.col("l_quantity") > 40, "over_limit").when(F.col("l_discount") == 0, "no_change").when(F.col("l_returnflag") == "R", "duplicate_proposal")
    return l.select(code.alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n"))


@plan("orders")
def paired_property_changes(o):
    k = F.col("o_orderkey")
    after = o.select("o_orderkey", F.when(k % 31 != 1, F.col("o_orderstatus")).alias("s"), F.when(k % 37 == 1, "X").otherwise(F.col("o_orderpriority")).alias("p"))
    both = o.join(after, "o_orderkey")
    change = F.when(~F.col("o_orderstatus").eqNullSafe(F.col("s")), "status").when(~F.col("o_orderpriority").eqNullSafe(F.col("p")), "priority")
    return both.select("o_orderkey", change.alias("property")).where("property is not null")


@plan("documents")
def duplicate_sources(d):
    # texts are counted by digest; only those that repeat go on, and copies become one before they are dealt out
    marked = d.where("text IS NOT NULL").select("text", F.sha2("text", 256).alias("digest"))
    twice = marked.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    return marked.join(twice.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("n")).select("text", "n")


def _duck(sql: str) -> str:
    sql = re.sub(r"\{(\w+)\}", r"\1", sql)
    return sql.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")


ORACLE_SQL = {k: _duck(s) for k, s in STATEMENTS.items()}
assert QUERIES.keys() == ORACLE_SQL.keys()
