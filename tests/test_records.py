"""Sessions, progress, evaluation, stores and text functions on small cases."""

import base64
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from scrivano.functions import text as T
from scrivano.operators import evaluation, replies, sessions, tokens, upload_rules
from scrivano.plans import catalogue
from scrivano.sources import stores, tables


def test_session_guards(spark):
    steps = [
        ("create", None, "ok"), ("claim", None, "ok"), ("claim", None, "busy"), ("decide", 0, "invalid_state"), ("complete", None, "ok"), ("decide", 0, "stale_review"), ("decide", 1, "ok"), ("begin", 1, "stale_review"),
        ("begin", 2, "ok"), ("begin", 2, "busy"), ("abort", None, "ok"), ("abort", None, "ignored"), ("begin", 2, "ok"), ("finish", None, "ok"), ("claim", None, "busy"), ("fail", None, "ignored"), ("complete", None, "invalid_state"),
        ("create", None, "invalid_state"), ("what", None, "invalid_state"),
    ]
    rows = [("a", i, float(i), r, e, "PASS") for i, (r, e, _) in enumerate(steps)] + [("b", 0, 0.0, "decide", 0, None), ("c", 0, 0.0, "create", None, None), ("c", 1, 0.0, "claim", None, None), ("c", 2, 500.0, "claim", None, None), ("c", 3, 501.0, "fail", None, None), ("c", 4, 502.0, "claim", None, None)]
    f = sessions.folded(spark.createDataFrame(rows, "session_id string, n int, at double, request string, expected int, decision string"))
    out = {(r.session_id, r.n): r.result for r in sessions.outcomes(f).collect()}
    assert [out["a", i] for i in range(len(steps))] == [s[2] for s in steps]
    assert out["b", 0] == "not_found" and [out["c", i] for i in range(5)] == ["ok"] * 5
    ends = {r.session_id: (r.status, r.revision) for r in f.collect()}
    assert ends == {"a": ("finalized", 2), "b": (None, None), "c": ("analyzing", 0)}


def test_progress_states(spark):
    e = [("a", 0, 10, "analysis_started", None, None), ("a", 1, 11, "analysis_progress", "save", "old"), ("a", 2, 20, "analysis_started", None, None), ("a", 3, 21, "analysis_progress", "read_resume", "x"),
         ("a", 4, 22, "analysis_progress", "ask_model", "first"), ("a", 5, 23, "analysis_progress", "ask_model", "again"), ("a", 6, 24, "analysis_progress", "nonsense", "y"), ("b", 0, 1, "analysis_started", None, None), ("c", 0, 1, "analysis_started", None, None)]
    events = spark.createDataFrame(e, "session_id string, n int, at int, event string, step string, detail string")
    status = spark.createDataFrame([("a", "analysis_failed"), ("b", "analyzing"), ("c", "finalized")], "session_id string, status string")
    got = sessions.progress(events, status).orderBy("session_id", "place").collect()
    assert [(r.state, r.detail, r.step_started_at) for r in got[:5]] == [("done", "x", 21), ("failed", "again", 22), ("pending", None, None), ("pending", None, None), ("pending", None, None)]
    assert [r.state for r in got[5:]] == ["active", "pending", "pending", "pending", "pending"] and {r.started_at for r in got} == {20, 1}


def test_decisions_and_retention(spark):
    p = spark.createDataFrame([("a", 1, 0, "e0"), ("a", 2, 0, "e1"), ("a", 2, 1, "e2"), ("b", None, 0, "e9")], "session_id string, run int, position int, edit_id string")
    kept = sessions.replaced_proposals(p)
    assert sorted(r.edit_id for r in kept.collect()) == ["e1", "e2"]
    d = spark.createDataFrame([("a", "e1", 1, "accepted", 7), ("a", "e1", 2, "rejected", 8), ("a", "zz", 3, "accepted", 8), ("a", "e2", 4, "accepted", 9), ("a", "e2", 5, "rejected", 9)], "session_id string, edit_id string, n int, decision string, request int")
    assert {r.edit_id: r.decision for r in sessions.decided(kept, d.where("n < 4")).collect()} == {"e1": "rejected", "e2": "pending"}
    assert {(r.request, r.edit_id, r.code) for r in sessions.decision_faults(d, kept).collect()} == {(8, "zz", "not_found"), (9, "e2", "duplicate_item")}
    s = spark.createDataFrame([("a", 5), ("b", 50)], "session_id string, expires_at int")
    assert {r.session_id for r in sessions.purged(p, s, F.lit(10)).collect()} == {"b"}
    keys = sessions.accepted_set_keys(spark.createDataFrame([("a", "v", "e1", "x"), ("a", "v", "e2", "y"), ("b", "v", "e2", "y"), ("b", "v", "e1", "x")], "session_id string, version string, edit_id string, new_text string")).collect()
    assert len({r.key for r in keys}) == 1 and len(keys) == 2
    f = spark.createDataFrame([("a", keys[0].key, "f2", 2, "PASS"), ("a", keys[0].key, "f1", 1, "REVIEW_REQUIRED")], "session_id string, key string, finalization_id string, created_at int, decision string")
    assert {r.session_id: r.finalization_id for r in sessions.reused(spark.createDataFrame(keys), f).collect()} == {"a": "f1", "b": None}
    asked = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("a", "f3")], "session_id string, finalization_id string")
    assert {r.finalization_id: r.result for r in sessions.acknowledged(f, asked).collect()} == {"f1": "ok", "f2": "invalid_state", "f3": "invalid_state"}


def test_evaluation(spark):
    rows = [("accept", "accept", False), ("accept_confirm", "too_long", False), ("unsupported_term", "accept_confirm", True), ("unsupported_term", "accept", True)]
    got = evaluation.labelled_metrics(spark.createDataFrame(rows, "expected string, actual string, claim boolean")).first()
    assert (got.cases, got.agreement, got.claim_block_rate, got.false_rejection_rate) == (4, 0.25, 0.5, 0.5)
    cases = spark.createDataFrame([(1, "d", "alpha", "beta"), (2, "d", "one", "a"), (3, "d", "", "x"), (4, "d", "common", "x"), (5, "d", "aaa", "aa")], "case_id int, document string, locator string, original string")
    b = spark.createDataFrame([("d", "alpha beta"), ("d", "one a a common"), ("d", "common x"), ("d", "aaa")], "document string, text string")
    assert [r.case_id for r in evaluation.calibration_cases(cases, b).orderBy("case_id").collect()] == [1, 5]
    s = spark.createDataFrame([(4, 4, 3, 3, []), (5, 5, 5, 5, ["c"]), (2, 5, 5, 5, None), (3, 4, 4, 4, None)], "faithfulness int, meaning_preservation int, writing_quality int, job_relevance int, unsupported_claims array<string>")
    assert [(r.flagged, r.passed) for r in evaluation.judged(s).collect()] == [(False, True), (True, False), (True, False), (False, False)]
    assert evaluation.judge_live(evaluation.judged(s).limit(0)).first().pass_share is None
    v = spark.createDataFrame([("a", x) for x in (5.0, 1.0, 1.0, 9.0)] + [("b", 2.0), ("c", None)], "g string, v double")
    assert {r.g: r.upper_median for r in evaluation.upper_medians(v, "g", "v").collect()} == {"a": 5.0, "b": 2.0}
    rng = random.Random(2)
    rows = [(g, None if rng.random() < 0.1 else float(rng.choice([3, rng.randrange(50), rng.randrange(100_000)]))) for g in ("x", "y", "z") for _ in range({"x": 1, "y": 2500, "z": 2501}[g])]
    held = {g: sorted(x for h, x in rows if h == g and x is not None) for g in ("x", "y", "z")}
    assert {r.g: r.upper_median for r in evaluation.upper_medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()} == {g: x[len(x) // 2] for g, x in held.items() if x}
    plan = evaluation.live_metrics(spark.createDataFrame([(True, 1, 1, 2.0)], "valid boolean, proposed int, accepted int, latency_ms double"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert [r[0] for r in spark.createDataFrame([(0.9,), (0.2,), (None,)], "s double").select(evaluation.passes_threshold(F.col("s"), 0.5)).collect()] == [True, False, False]
    d = evaluation.detections(spark.createDataFrame([(1, True, True), (1, True, False), (1, False, True), (1, False, False)], "k int, faulty boolean, flagged boolean"), ["k"]).first()
    assert (d.tp, d.fn, d.fp, d.tn, d.miss_rate, d.false_alarm_rate) == (1, 1, 1, 1, 0.5, 0.5)


def test_stores(spark, tmp_path):
    a = spark.createDataFrame([("s", "a1", "original", bytearray(b"x")), ("s", "a2", "index", bytearray(b"yy"))], "session_id string, artifact_id string, kind string, content binary")
    stores.put_artifacts(a, f"{tmp_path}/store")
    assert all(r.sound for r in stores.get_artifacts(spark, f"{tmp_path}/store").collect())
    stores.put_artifacts(a.limit(1), f"{tmp_path}/bad")
    bad = spark.read.parquet(f"{tmp_path}/bad").withColumn("content", F.lit(bytearray(b"z")))
    bad.write.parquet(f"{tmp_path}/bad2")
    assert [r.sound for r in stores.get_artifacts(spark, f"{tmp_path}/bad2").collect()] == [False]
    (tmp_path / "set.json").write_text(json.dumps({"dataset_version": "1", "cases": [{"id": "c1", "expected": "accept"}, {"id": "c2", "expected": "too_long"}]}, indent=1))
    assert [(r.dataset_version, r.id) for r in stores.labelled_cases(spark, f"{tmp_path}/set.json", "id:string,expected:string").collect()] == [("1", "c1"), ("1", "c2")]
    assert [r.error for r in stores.scripted_replies(spark, [("a", None), (None, "timeout")]).orderBy("n").collect()] == [None, "timeout"]
    log = spark.createDataFrame([(("abc", ["q"], {"prompt": "hello", "k": "v"}),)], "data struct<text:string,evidence:array<string>,more:map<string,string>>")
    r = stores.redacted_log(log).first().data
    assert (r.text, r.evidence, r.more) == ("<redacted:3 chars>", "<redacted>", {"prompt": "<redacted:5 chars>", "k": "v"})
    stores.write_report(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/report")
    assert json.loads(spark.read.text(f"{tmp_path}/report").first()[0]) == {"a": 1, "b": None}


def test_text_functions(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(c).first()[0]
    c = F.col("c0")
    assert [(x.key, x.parts) for x in one(T.compound_parts(c), "a (Kubernetes-based), x- 2M/day and/or")] == [("kubernetesbased", ["Kubernetes", "based"]), ("2mday", ["2M", "day"]), ("andor", ["and", "or"])]
    assert one(T.token_keys(c), "C++ c++ -- Go!") == ["c++", "go"] and one(T.normalized_space(c), " a  b\n") == "a b"
    assert one(T.prompt("<a>{x}</a>{y}", x=c, y=F.lit(" ")), "</a>") == "<a><​/a></a>(none)"
    assert [one(T.download_name(c, "_new.docx", "file"), n) for n in ("cv.final.docx", "", ".docx", "x" * 120 + ".doc")] == ["cv.final_new.docx", "file_new.docx", ".docx_new.docx", "x" * 100 + "_new.docx"]
    long = "Alpha beta2 " * 8000
    assert one(T.named_terms(c), long) == ["beta2", "Alpha"]  # bound once: in time that grows with the text


def test_no_name_is_registered_twice(spark):
    with pytest.raises(ValueError):
        catalogue.merged({"a": 1}, {"a": 2})
    assert tables.stored(spark.range(2)).count() == 2
    tables.clear_scratch(spark)
    assert not tables._LIVE


def test_tokens(spark):
    """The library's keyed digest; forged, cut, late and odd tokens."""
    for secret in (b"k", b"long" * 40):
        df = spark.createDataFrame([("s1", "a1", 100), ("sé", "a?>", 100)], "s string, a string, e long")
        rows = df.select("s", "a", tokens.signed(F.col("s"), F.col("a"), F.col("e"), secret).alias("t")).collect()
        for r in rows:
            body, sig = r.t.split(".")
            raw = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
            assert json.loads(raw) == {"artifact": r.a, "exp": 100, "session": r.s}
            assert base64.urlsafe_b64encode(hmac.new(secret, raw, "sha256").digest()).rstrip(b"=").decode() == sig
    t = rows[0].t
    odd = [(t, 100), (t, 101), (t[:-2] + "xx", 1), ("e30." + t.split(".")[1], 1), ("nonsense", 1), ("", 1), (None, 1), ("a.b.c", 1)]
    got = spark.createDataFrame(odd, "t string, now long").select(tokens.checked(F.col("t"), F.col("now"), b"long" * 40).alias("c")).collect()
    assert [r.c.fault for r in got] == [None, "expired", "bad_signature", "bad_signature", "malformed", "malformed", "malformed", "malformed"]
    assert (got[0].c.session, got[0].c.artifact, got[1].c.session) == ("s1", "a1", None)


def test_retries_and_names(spark):
    rows = [("a", 1, 503, None), ("a", 2, None, "timeout"), ("a", 3, 200, None), ("b", 1, 400, None), ("b", 2, 200, None), ("c", 1, 429, None), ("c", 2, 500, None), ("c", 3, 500, None), ("c", 4, 200, None)]
    got = {r.request: (r.tries, r.status, r.waited) for r in replies.outcomes(spark.createDataFrame(rows, "request string, n int, status int, error string")).collect()}
    assert got == {"a": (3, 200, 1.5), "b": (1, 400, 0.0), "c": (3, 500, 1.5)}
    names = spark.createDataFrame([("a/b\\cafe\u0301.docx",), (None,), ("x\u200b  y.docx",)], "n string")
    assert [r[0] for r in names.select(upload_rules.safe_file_name(F.col("n"))).collect()] == ["caf\u00e9.docx", "resume.docx", "x y.docx"]
