"""Context lines against the JSON library; sections by headings, capitals and bold runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scrivano.operators import context, package_index, structure
from scrivano.sources import packages as P

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_json_strings(spark):
    texts = ["", "plain", 'a "b" \\ / c', "\u2028 é \U0001f600 \x7f", "".join(map(chr, range(300))), "\\\\n\n\t\x00\x1f", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(context.json_string(F.col("t"))).collect()]
    assert got == [json.dumps(t, ensure_ascii=False) for t in texts]


BLOCK = "path string, rank int, ord int, location_id string, section string, container string, editable boolean, text string"


def cut(blocks, budget):
    lines, used = [], 0
    for b in blocks:
        if not (b[7] or "").strip():
            continue
        line = json.dumps({"id": b[3], "section": b[4], "where": b[5], "editable": b[6], "text": b[7]}, ensure_ascii=False)
        if used + len(line) > budget:
            return lines, True
        lines.append(line)
        used += len(line) + 1
    return lines, False


@pytest.mark.parametrize("budget", [0, 90, 400, 1000, 100_000])
def test_budget(spark, budget):
    rng = random.Random(budget)
    word = lambda n: "".join(rng.choice('ab "\\é\n\U0001f600 ') for _ in range(rng.randrange(n)))
    rows = [(f"d{d}", r, o, f"loc_{d}{r}{o}", rng.choice([None, "S\"1"]), rng.choice(["body", "header"]), rng.random() < 0.5, rng.choice([word(60), word(4), "", " \u00a0\n", None])) for d in range(8) for r in range(2) for o in range(6)]
    mixed = rng.sample(rows, len(rows))
    out = context.shown(spark.createDataFrame(mixed, BLOCK), budget)
    got = {r.path: (r.context.split('\n{"id"'), r.truncated) for r in context.contexts(out).collect()}
    for d in range(8):
        lines, truncated = cut([r for r in rows if r[0] == f"d{d}"], budget)
        if lines:
            assert ('\n{"id"'.join(got[f"d{d}"][0]), got[f"d{d}"][1]) == ("\n".join(lines), truncated)
        else:
            assert f"d{d}" not in got


def test_labels(spark):
    rows = [
        ("SKILLS", None, False, False, "SKILLS"), ("Skills", None, False, False, None), ("Skills", None, False, True, "Skills"), ("Skills", 2, True, False, "Skills"), ("SKILLS", None, True, True, None),
        (" \u00a0A B ", None, False, False, "A B"), ("X", None, False, True, None), ("1 2", None, False, True, None), ("one two three four five", None, False, True, "one two three four five"), ("one two three four five 6", None, False, True, None),
        ("Z" * 41, None, False, False, None), ("h" * 90, 0, False, False, "h" * 60), (" ", 1, False, True, None), (None, 1, False, False, None),
    ]
    d = spark.createDataFrame(rows, "t string, level int, item boolean, bold boolean, want string")
    assert [r[0] for r in d.select(structure.section_label(*map(F.col, ("t", "level", "item", "bold")))).collect()] == [r[4] for r in rows]


def test_sections_of_blocks(spark):
    p = lambda t, bold="", more="": f'<w:p>{more}<w:r>{bold and f"<w:rPr>{bold}</w:rPr>"}<w:t>{t}</w:t></w:r></w:p>'
    half = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>half</w:t></w:r><w:r><w:t> bold</w:t></w:r></w:p>'
    blank = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Two</w:t></w:r><w:r><w:t xml:space="preserve"> </w:t></w:r></w:p>'
    body = p("first") + p("ONE") + p("text") + half + p("not", '<w:b w:val="0"/>') + p("Bold", "<w:b/>") + p("Item", "<w:b/>", "<w:pPr><w:numPr/></w:pPr>") + blank + p("last")
    doc = f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'
    types = f'<Types xmlns="{P.CONTENT_TYPES}"><Override PartName="/word/document.xml" ContentType="{P.WORDPROCESSING}document.main+xml"/><Override PartName="/word/header1.xml" ContentType="{P.WORDPROCESSING}header+xml"/></Types>'
    root = f'<Relationships xmlns="{P.PKG_REL}"><Relationship Id="r1" Type="{P.REL_PREFIX}officeDocument" Target="word/document.xml"/></Relationships>'
    rels = f'<Relationships xmlns="{P.PKG_REL}"><Relationship Id="a" Type="{P.REL_PREFIX}header" Target="header1.xml"/></Relationships>'
    head = f'<w:hdr xmlns:w="{W}">{p("HEAD")}</w:hdr>'
    members = {"[Content_Types].xml": types, "_rels/.rels": root, "word/document.xml": doc, "word/_rels/document.xml.rels": rels, "word/header1.xml": head}
    parts = spark.createDataFrame([("f", i, n, True, bytearray(b.encode())) for i, (n, b) in enumerate(members.items())], "path string, ord int, part string, xml_ok boolean, content binary")
    blocks = package_index.index(spark.createDataFrame([("f", bytearray(b"x"))], "path string, content binary"), parts, sections=True)
    got = [(r.text, r.section) for r in blocks.orderBy("rank", "ord").collect()]
    assert got == [("first", None), ("ONE", "ONE"), ("text", "ONE"), ("half bold", "ONE"), ("not", "ONE"), ("Bold", "Bold"), ("Item", "Bold"), ("Two ", "Two"), ("last", "Two"), ("HEAD", "header")]
