"""Counts of running plans, edits that no session has, and rules on what comes with an upload."""

import time

import pytest
from pyspark.sql import functions as F

from scrivano.operators import observed, sessions, upload_rules


def test_steps_of_an_action(spark):
    told = []
    steps = observed.Steps(lambda name, counts: told.append((name, counts)))
    d = steps.step(spark.range(0, 1000, 1, 7), "read", top=F.max("id"))
    d = steps.step(d.where("id % 3 = 0"), "kept")
    d = steps.step(d.groupBy((F.col("id") % 5).alias("k")).count(), "groups", total=F.sum("count"))
    before = spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession.active().sparkContext().dagScheduler().nextJobId()
    assert len(d.collect()) == 5
    jobs = spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession.active().sparkContext().dagScheduler().nextJobId()
    steps.done()
    assert told == [("read", {"rows": 1000, "top": 999}), ("kept", {"rows": 334}), ("groups", {"rows": 5, "total": 334})]
    assert jobs - before <= 2  # the action's own
    steps.done()
    assert len(told) == 3
    assert {tuple(r) for r in observed.as_table(spark, told).collect()} == {("read", "rows", 1000), ("read", "top", 999), ("kept", "rows", 334), ("groups", "rows", 5), ("groups", "total", 334)}


def test_steps_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(10 * (i + 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    told = []
    listener = observed.Batches(lambda name, counts: told.append((name, counts)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = observed.step_of_stream(stream.where("id < 15"), "small", top=F.max("id"))
        q = out.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        for _ in range(100):
            if len(told) >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(c["rows"] for n, c in told if n == "small" and c["rows"]) == [10, 15, 15] and {c["batch"] for _, c in told} >= {0, 1, 2}


def test_unknown_edits_end_the_query(spark):
    proposals = spark.createDataFrame([("a", "e1", "l1", 0, 2, "x", "y"), ("b", "e2", "l2", 1, 3, "p", "q")], "session_id string, edit_id string, location_id string, start int, end int, original string, proposed string")
    ask = lambda *rows: sessions.edit_specs(spark.createDataFrame(list(rows), "session_id string, n int, edit_id string"), proposals)
    assert [tuple(r) for r in ask(("a", 0, "e1"), ("b", 1, "e2")).orderBy("n").collect()] == [("a", 0, "e1", "l1", 0, 2, "x", "y"), ("b", 1, "e2", "l2", 1, 3, "p", "q")]
    for row in (("a", 0, "e2"), ("c", 0, "e1"), ("a", 0, None)):
        with pytest.raises(Exception, match="unknown edit"):
            ask(("a", 0, "e1"), row).collect()


def test_input_rules(spark):
    rows = [("job", "", None), ("j" * 20_000, "c" * 5_000, "n" * 5_000), ("  \n", "c" * 9_000, ""), (None, None, None), ("j" * 20_001, "c" * 9_000, ""), ("j", "c" * 5_001, "n" * 6_000), ("j", "", "n" * 5_001)]
    d = spark.createDataFrame(rows, "job_description string, company_details string, candidate_notes string")
    got = [r[0] and tuple(r[0]) for r in d.select(upload_rules.input_fault()).collect()]
    blank, of = ("input_too_long", "job_description", None), lambda f, n: ("input_too_long", f, n)
    assert got == [None, None, blank, blank, of("job_description", 20_000), of("company_details", 5_000), of("candidate_notes", 5_000)]


def test_documents_without_editable_text(spark):
    rows = [("a", True, " "), ("a", True, "x"), ("b", True, " "), ("b", False, "x"), ("c", True, None)]
    got = upload_rules.without_editable_text(spark.createDataFrame(rows, "path string, editable boolean, text string")).collect()
    assert {tuple(r) for r in got} == {("b", "no_editable_text"), ("c", "no_editable_text")}
