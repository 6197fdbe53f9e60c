"""What the plans over packages and layouts read, deal out and store: each thing once."""

import pytest
from pyspark.sql import functions as F

from scrivano.operators import faults, package_index, segments, structure
from scrivano.plans import catalogue, package_queries
from scrivano.sources import packages, tables
from scrivano.sources.tables import stored

SF = "/root/testdata/sf0.001"


def test_one_reading_gives_what_the_single_ones_give(spark):
    data = faults.sample("Led a team\nShort\n\nImproved <it> & more")
    files = stored(spark.createDataFrame([("p", bytearray(data))], "path string, content binary"))
    parts = stored(packages.members(files))
    blocks = package_index.index(files, parts)
    main = parts.where("part = 'word/document.xml'")
    key = ["path", "part", "ord"]
    marks = package_index.markup(main)
    props = structure.properties(main, structure.styles(parts))
    alone = segments.paragraphs(main).drop("reason", "container").join(props, key).join(structure.run_stats(main), key).join(marks, key)
    pick = lambda d: {r.ord: r for r in d.select(*sorted(alone.columns)).collect()}
    assert pick(blocks) == pick(alone) and len(pick(blocks)) == 10
    assert {r.around for r in blocks.collect()} == {r.digest for r in marks.where("ord = -1").collect()}


def test_names_attributes_texts_and_places_count():
    from xml.etree import ElementTree

    of = lambda x: structure.canonical(ElementTree.fromstring(x))
    assert of('<a xmlns:p="u" p:x="1" y="2"><p:b/>t</a>') == of('<a xmlns:q="u" y="2" q:x="1"><q:b></q:b>t</a>')
    different = ["<a><b/>t</a>", "<a>t<b/></a>", "<a><b>t</b></a>", '<a x="t"><b/></a>', "<a><b><c/></b></a>", "<a><b/><c/></a>", '<a x="1" y=""/>', '<a x="" y="1"/>', '<a xmlns="u"/>', "<a/>"]
    assert len({of(x) for x in different}) == len(different)
    assert of("<a><b>t</b>rest</a>") != of("<a><b>t</b></a>") and structure.canonical(ElementTree.fromstring("<a><b>t</b>rest</a>")[0]) == of("<b>t</b>")


def test_documents_of_one_file_are_dealt_out(spark, monkeypatch):
    class Seen(Exception):
        pass

    def samples(docs, *_):
        raise Seen(docs.rdd.getNumPartitions())

    monkeypatch.setattr(faults, "samples", samples)
    with pytest.raises(Seen) as seen:
        package_queries.delivered(spark, SF)
    assert seen.value.args[0] == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_edits_alone_inject_no_faults(spark, monkeypatch):
    def faulty(files):
        raise AssertionError("faults are not asked for")

    monkeypatch.setattr(faults, "faulty", faulty)
    assert package_queries.edited_packages(spark, SF).count() > 0


def test_words_are_not_shuffled(spark):
    """Texts are dealt out by document, before they become words; windows and counts take them as they lie."""
    plan = catalogue.QUERIES["layout_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = [x.split("Exchange hashpartitioning(")[1] for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
    assert len(keys) <= 3 and all(k.startswith("case#") and "," not in k.split(", ENSURE")[0].split(", REPARTITION")[0].removesuffix(", 4)") for k in keys), keys


def test_discarded_tables_are_gone(spark):
    import os

    kept, gone = (tables.stored(spark.range(9)) for _ in range(2))
    tables.discard(gone)
    assert kept.count() == 9 and not os.path.exists(gone._scratch.removeprefix("file://")) and gone._scratch not in tables._LIVE


def test_one_scan_gives_what_members_give(spark):
    data = faults.sample("Led a team\nShort\n\nImproved <it> & more")
    files = stored(spark.createDataFrame([("p", bytearray(data)), ("cut", bytearray(data[: len(data) // 2]))], "path string, content binary"))
    scanned, parts = stored(package_index.scan(files)), stored(packages.members(files))
    rows = lambda d: sorted(map(repr, d.select(*sorted(d.columns)).collect()))
    for of in (packages.relationships, packages.content_types, structure.styles, lambda m: package_index.index(files, m), lambda m: m.select("path", "ord", "part", "fault", "xml_ok")):
        assert rows(of(scanned)) == rows(of(parts)) and rows(of(parts))
    tags = lambda m: {(r.path, r.part): (sorted(map(tuple, r.tags)), r.sections) for r in structure.shapes(m).collect()}
    assert tags(scanned) == tags(parts)


def test_neither_contents_nor_paragraphs_stay(spark):
    """Once both sides' blocks are stored, no scratch table holds the packages' bytes or the paragraphs they came from."""
    before = set(tables._LIVE)
    package_queries._gated(spark, SF)
    held = {c for path in set(tables._LIVE) - before for c in spark.read.parquet(path).columns if not (c == "content" and spark.read.parquet(path).where("length(content) > 8").isEmpty())}
    assert not held & {"content", "paragraphs"} and "segments" in held


def test_rejected_edit_of_a_block_that_no_accepted_one_touches(spark):
    """A rejected edit that was put in all the same is found where nothing else of the block was accepted."""
    from scrivano.operators import gates

    make = lambda text: stored(spark.createDataFrame([("p", bytearray(faults.sample(text)))], "path string, content binary"))
    sides = [package_index.index(f, stored(package_index.scan(f))) for f in (make("Led a team\nOther"), make("Led a team\nOther words"))]
    spec = "path string, edit_id string, location_id string, start int, end int, original string, new_text string"
    at = sides[0].where("ord = 2").first().location_id
    rejected = spark.createDataFrame([("p", "e", at, 0, 5, "Other", "Other words")], spec)
    found = gates.content(*sides, rejected.limit(0), rejected, spark.createDataFrame([], "path string, text string"))
    assert {r.code for r in found.collect()} == {"unintended_text_change", "rejected_edit_present"}


def test_stored_tables_are_not_broadcast(spark):
    """Their files are so small that Spark would send tables of gigabytes to the driver."""
    big = stored(spark.range(1000).select("id", F.lit("x").alias("same")))
    plan = lambda d: big.groupBy("id").count().join(d, "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(big) and "BroadcastExchange" not in plan(spark.range(5))
