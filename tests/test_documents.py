"""Diffs, layout, replies and streams on small inputs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from scrivano.functions.diff import TOKEN, word_diff
from scrivano.operators import blocks, layout, replies, salient
from scrivano.streaming import progress

SF = "/root/testdata/sf0.001"


def longest(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, v in enumerate(x):
        for j, w in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if v == w else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_word_diff(spark):
    pairs = [("Led a team of 5.", "Led the team of 6!"), ("", "new"), ("same", "same"), ("é ü", "é  ü"), ("a b c d", "d a b c"), ("x", "")]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", word_diff(F.col("a"), F.col("b")).alias("d"))
    for r in d.collect():
        assert "".join(p.text for p in r.d if p.op != "insert") == r.a and "".join(p.text for p in r.d if p.op != "delete") == r.b
        assert sum(len(re.findall(TOKEN, p.text)) for p in r.d if p.op == "equal") == longest(re.findall(TOKEN, r.a), re.findall(TOKEN, r.b))
        assert all(p.op != q.op and (p.op, q.op) != ("insert", "delete") for p, q in zip(r.d, r.d[1:]))


WORDS = "case string, ord int, text string, page int, x0 double, top double, size double, font string, color string, marked boolean"


def page(case, change=lambda i, w: w):
    base = [[case, i, f"w{i}", 0, 50.0 * (i % 4), 12.0 * (i // 4), 10.0, "AB+Serif", "black", i == 6] for i in range(12)]
    return [change(i, w) for i, w in enumerate(base)]


def put(at, col, value):
    return lambda i, w: [*w[:col], value(w[col]), *w[col + 1 :]] if at(i) else w


CHANGES = {
    "same": (lambda i, w: w, {}),
    "subset": (put(lambda i: True, 7, lambda f: "CD+Serif"), {}),
    "font": (put(lambda i: i == 3, 7, lambda f: "Sans"), {"font_changed": 1}),
    "color": (put(lambda i: i < 2, 8, lambda f: "red"), {"text_color_changed": 2}),
    "reflow": (put(lambda i: i > 7, 5, lambda t: t + 12), {"vertical_reflow": 4}),
    "early": (put(lambda i: i < 4, 5, lambda t: t + 2), {"shift_before_edit": 4}),
    "paged": (put(lambda i: i > 7, 3, lambda p: 1), {"page_flow_changed": 4}),
    "wrapped": (put(lambda i: i == 11, 4, lambda x: x + 9), {"vertical_reflow": 1, "line_wrap_changed": 1}),
    "texts": (put(lambda i: i == 5, 2, lambda t: "other"), {"context_text_render_mismatch": 2}),
}


def test_layout_findings(spark):
    before = spark.createDataFrame([w for c in CHANGES for w in page(c)], WORDS)
    after = spark.createDataFrame([w for c, (f, _) in CHANGES.items() for w in page(c, f)], WORDS)
    pairs = layout.aligned(before, after)
    got = {c: {} for c in CHANGES}
    for r in layout.word_findings(pairs, layout.first_marked(before)).collect():
        got[r.case][r.code] = r.n
    assert got == {c: want for c, (_, want) in CHANGES.items()}
    assert {(r.case, r.page): r["shift"] for r in layout.page_shifts(pairs).collect()} == {("reflow", 0): 12.0, ("early", 0): 2.0}
    assert {r.lines for r in layout.marked_lines(before).collect()} == {1}


ITEM = {"location_id": "loc_1", "original_text": "a", "proposed_text": "b", "edit_type": "grammar", "reason": "r", "supporting_evidence": [{"location_id": "loc_1", "quote": "q"}], "confidence": 0.5}


@pytest.mark.parametrize(
    "change, code",
    [({}, None), ({"confidence": None}, None), ({"confidence": 2}, "schema_invalid"), ({"edit_type": "other"}, "schema_invalid"), ({"original_text": ""}, "schema_invalid"), ({"reason": "r" * 501}, "schema_invalid"), ({"supporting_evidence": []}, "schema_invalid"), ({"supporting_evidence": None}, "schema_invalid")],
)
def test_reply_items(spark, change, code):
    text = json.dumps({"proposals": [ITEM | change, ITEM]})
    rows = [(1, text), (2, f"<think>hm {{}}</think>```json\n{text}\n```"), (3, "no JSON"), (4, json.dumps({"proposals": []}))]
    got = [(r.id, r.pos, r.code) for r in replies.items(spark.createDataFrame(rows, "id int, reply string")).orderBy("id", "pos").collect()]
    assert got == [(1, 0, code), (1, 1, None), (2, 0, code), (2, 1, None), (3, None, "reply_invalid")]


def read(spark, *texts):
    rows = replies.items(spark.createDataFrame(list(enumerate(texts)), "id int, reply string")).collect()
    return {(r.id, r.pos): (r.code, [f"{p.path}: {p.problem}" for p in r.problems]) for r in rows}


def test_replies_in_what_surrounds_them(spark):
    """Prose and braces about the object, signs after it, texts with braces and quotes in it, and what is no reply."""
    odd = ITEM | {"original_text": 'a } { "quoted\\" \n \U0001f600 \\\\'}
    text = json.dumps({"alignment_summary": "", "proposals": [odd]})
    good = [text, f"Here it is: {text} {{hope}} that", f"{text}<|im_end|>", f"```\n{text}\n```", f"``` {text} ```", f"<think>{{</think> a <think>}}</think>\n {text}", json.dumps({"proposals": [odd]}, ensure_ascii=False)]
    assert read(spark, *good) == {(i, 0): (None, []) for i in range(len(good))}
    bad = ["no JSON", "[1]", '{"proposals": 3}', '{"proposals": [] ', f"[{text}]", "{'proposals': []}", '{"a": } ' + text, None, "", "{"]
    assert read(spark, *bad) == {(i, None): ("reply_invalid", []) for i in range(len(bad))}
    assert read(spark, "{}", 'none: {"proposals": []} of them') == {}
    long = json.dumps({"proposals": [ITEM | {"original_text": "\\n\"{" * 100} for _ in range(70)]})
    assert list(read(spark, "so: " + long * 3)) == [(0, i) for i in range(replies.MOST)]


def test_problems_by_path(spark):
    batch = {
        "gaps_without_evidence": ["g"],
        "proposals": [
            "text", {}, ITEM | {"reason": 4, "note": 1}, ITEM | {"supporting_evidence": [{"location_id": "l" * 41, "quote": ""}, 3, {"quote": "q", "more": 1}]}, ITEM | {"supporting_evidence": [{}] * 5},
            ITEM | {"confidence": "0.5"}, ITEM | {"confidence": "x"}, ITEM | {"confidence": -1}, ITEM | {"confidence": []}, ITEM | {"edit_type": None, "original_text": None},
        ],
    }
    got = {k[1]: v[1] for k, v in read(spark, json.dumps(batch)).items()}
    at = lambda i, *told: [f"proposals.{i}.{t}" for t in told]
    assert got == {
        0: ["proposals.0: model_type"], 1: at(1, *(f"{f}: missing" for f in replies.FIELDS[:-1])), 2: at(2, "reason: string_type", "note: extra_forbidden"),
        3: at(3, "supporting_evidence.0.location_id: string_too_long", "supporting_evidence.0.quote: string_too_short", "supporting_evidence.1: model_type", "supporting_evidence.2.location_id: missing", "supporting_evidence.2.more: extra_forbidden"),
        4: at(4, "supporting_evidence: too_long"), 5: [], 6: at(6, "confidence: float_parsing"), 7: at(7, "confidence: greater_than_equal"), 8: at(8, "confidence: float_type"), 9: at(9, "original_text: string_type", "edit_type: enum"),
    }
    own = [{"alignment_summary": 3}, {"alignment_summary": "a" * 1501}, {"gaps_without_evidence": ["a", 1]}, {"gaps_without_evidence": ["a"] * 21}, {"more": 1, "proposals": [ITEM]}]
    told = ["alignment_summary: string_type", "alignment_summary: string_too_long", "gaps_without_evidence.1: string_type", "gaps_without_evidence: too_long", "more: extra_forbidden"]
    assert read(spark, *map(json.dumps, own)) == {(i, None): ("schema_invalid", [t]) for i, t in enumerate(told)}


@pytest.fixture(scope="module")
def stream_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(4, "event_id").write.mode("overwrite").parquet(d)
    return d


def run(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_stream_agrees_with_batch(spark, stream_dir, tmp_path):
    batch = spark.read.parquet(stream_dir)
    live = progress.events(spark, stream_dir, batch.schema)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(run(progress.steps_reached(live), "complete", "steps", tmp_path / "a")) == rows(progress.steps_reached(batch))
    assert rows(run(progress.activity(live), "complete", "active", tmp_path / "b")) == rows(progress.activity(batch))
    once = run(progress.completed_once(live, delay="10000 days"), "append", "once", tmp_path / "c")
    assert once.count() == batch.select("user_id", "event_type").distinct().count()


def test_page_findings_and_marker(spark):
    pages = lambda rows: spark.createDataFrame(rows, "case string, page int, width double, height double, images int, graphics int, words array<struct<x0:double,x1:double,bottom:double>>")
    good, wide = [(0.0, 100.4, 200.5)], [(-0.4, 100.6, 10.0), (-0.6, 5.0, 5.0), (0.0, 5.0, 200.6)]
    before = pages([("same", 0, 100.0, 200.0, 0, 0, good), ("blank", 0, 100.0, 200.0, 0, 0, good), ("wide", 0, 100.0, 200.0, 0, 0, good)])
    after = pages([("same", 0, 100.0, 200.0, 0, 0, good), ("blank", 0, 100.0, 200.0, 0, 0, good), ("blank", 1, 100.0, 200.0, 0, 0, []), ("wide", 0, 100.0, 200.0, 0, 0, wide)])
    got = {(r.case, r.code): r.n for r in layout.page_findings(before, after).collect()}
    assert got == {("blank", "page_count_changed"): 1, ("blank", "blank_page_introduced"): 1, ("wide", "text_outside_page"): 3}
    colors = spark.createDataFrame([([1.0, 0.0, 1.0],), ([0.97, 0.0, 1.0],), ([1.0, 0.0],), (None,)], "c array<double>")
    assert [r[0] for r in colors.select(layout.is_marker(F.col("c"))).collect()] == [True, False, False, False]


def test_located(spark):
    b = spark.createDataFrame([(1, "one two", "a"), (1, "two three", "b"), (2, "one", "c")], "doc_id int, text string, location_id string")
    wanted = spark.createDataFrame([(1, "one"), (1, "two"), (2, "zzz"), (3, "one")], "doc_id int, locator string")
    got = {(r.doc_id, r.locator): (r.n, r.location_id) for r in blocks.located(wanted, b).collect()}
    assert got == {(1, "one"): (1, "a"), (1, "two"): (2, None), (2, "zzz"): (0, None), (3, "one"): (0, None)}


def test_salient_terms(spark):
    text = "Senior Engineer. Kubernetes is key. We use PostgreSQL, PostgreSQL and C++. Docker helps; postgresql pipelines and pipelines, platform platform platform"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "i int, text string")
    rows = salient.salient_terms(df, "i").orderBy("rank").collect()
    assert [r.term for r in rows] == ["PostgreSQL", "C++", "Engineer", "Kubernetes", "Docker", "platform", "pipelines"]
    assert {r.i for r in rows} == {1} and len(salient.salient_terms(df, "i", limit=2).collect()) == 2
