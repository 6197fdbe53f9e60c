"""Packages as a data source: what is read, how files are dealt out, and writes that break."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrivano.sources import package_source, packages

MEDIA = os.urandom(300_000)


def package(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.docx").write_bytes(package(**{"word/media/a.png": MEDIA, "word/document.xml": f"<a>{i}</a>", "word/header1.xml": "<b>", "docProps/": b"", "word/media/b.png": MEDIA}))
    (tmp_path / "bad.docx").write_bytes(b"no package")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.docx").write_bytes(b"")
    return str(tmp_path)


def test_rows_are_those_of_the_scan(spark, folder):
    files = spark.read.format("binaryFile").load(f"{folder}/*.docx").select(F.substring_index("path", "/", -1).alias("path"), "content")
    want = packages.members(files)
    got = package_source.members(spark, folder)
    assert got.columns == ["path", *want.columns[1:]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert package_source.members(spark, f"file://{folder}").count() == 31


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, *n):
        got = super().read(*n)
        self.read_bytes += len(got)
        return got


def test_media_are_not_read():
    wanted = package_source.Wanted(("word/document.xml",))
    file = Counting(package(**{"word/media/a.png": MEDIA, "word/document.xml": "<a/>", "word/media/b.png": MEDIA}))
    rows = list(package_source.wanted_rows(file, wanted, packages.MAX_UNCOMPRESSED, True))
    assert [(r[0], r[1], r[9]) for r in rows] == [(1, "word/document.xml", b"<a/>")]
    assert file.read_bytes < 3_000
    file = Counting(file.getvalue())
    listed = list(package_source.wanted_rows(file, package_source.Wanted(), packages.MAX_UNCOMPRESSED, False))
    assert [(r[1], r[4], r[9]) for r in listed] == [("word/media/a.png", 300_000, None), ("word/document.xml", 4, None), ("word/media/b.png", 300_000, None)]
    assert file.read_bytes < 3_000
    file = Counting(file.getvalue())
    assert len(list(package_source.wanted_rows(file, package_source.Wanted(), packages.MAX_UNCOMPRESSED, True))) == 3 and file.read_bytes > 600_000


def test_names_and_filters(spark, folder):
    """A name asked for narrows the read; filters are Spark's, on one table again and again."""
    one = package_source.members(spark, folder, ["word/document.xml"])
    want = {(f"{i}.docx", f"<a>{i}</a>".encode()) for i in range(6)}
    assert {(r.path, r.content and bytes(r.content)) for r in one.collect()} == want | {("bad.docx", None)}
    assert {(r.path, bytes(r.content)) for r in one.where("fault IS NULL").collect()} == want
    assert {r.part for r in package_source.members(spark, folder, ["word/media/a.png"], [".xml"]).where("part IS NOT NULL").collect()} == {"word/document.xml", "word/header1.xml", "word/media/a.png"}
    m = package_source.members(spark, folder)
    for f in ("part = 'word/document.xml'", "part IN ('word/document.xml', 'none')", "part LIKE '%.xml' AND part LIKE 'word/d%'", "part = 'word/document.xml' AND ord = 1"):
        assert {(r.path, bytes(r.content)) for r in m.where(f).collect()} == want
    assert {r.part for r in m.where("part LIKE '%.xml' OR ord = 0").collect()} == {"word/document.xml", "word/header1.xml", "word/media/a.png"}


def test_partitions_by_bytes(spark, folder):
    reader = lambda n: package_source.PackageReader(StructType.fromDDL(package_source.SCHEMA), {"path": folder, "partitionBytes": n})
    size = os.path.getsize(f"{folder}/0.docx")
    assert [len(p.paths) for p in reader(1).partitions()] == [1] * 7
    assert [len(p.paths) for p in reader(2 * size).partitions()] == [2, 2, 2, 1]
    assert [len(p.paths) for p in reader(100 * size).partitions()] == [7]
    assert package_source.members(spark, folder, partitionBytes=size).rdd.getNumPartitions() == 7


def test_empty_folder(spark, tmp_path):
    assert package_source.members(spark, str(tmp_path)).count() == 0


PARTS = "path string, ord int, part string, content binary"


def rows(names):
    return [(n, i, p, f"{n}{p}".encode()) for n in names for i, p in enumerate(("z.xml", "a.xml"))]


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "out")
    os.mkdir(folder)
    package_source.write(spark.createDataFrame(rows(f"p{i}" for i in range(40)), PARTS).repartition(7), folder)
    got = package_source.members(spark, folder).select("path", "ord", "part", "content").collect()
    assert sorted((r.path, r.ord, r.part, bytes(r.content)) for r in got) == sorted(rows(f"p{i}" for i in range(40)))
    package_source.write(spark.createDataFrame(rows(["q"]), PARTS), folder)
    assert package_source.members(spark, folder).where("part = 'a.xml'").count() == 41
    package_source.write(spark.createDataFrame(rows(["r"]), PARTS), folder, "overwrite")
    assert {r.path for r in package_source.members(spark, folder).collect()} == {"r"}
    assert len(os.listdir(folder)) == 1


@pytest.mark.parametrize("bad", [("../x", 0, "a", b""), (None, 0, "a", b""), ("p3", 9, "a.xml", b""), ("p3", 9, None, b"")])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    os.mkdir(folder)
    package_source.write(spark.createDataFrame(rows(["old"]), PARTS), folder)
    with pytest.raises(Exception, match="not the name of one"):
        package_source.write(spark.createDataFrame([*rows(f"p{i}" for i in range(20)), bad], PARTS).repartition(5), folder, "overwrite")
    assert {r.path for r in package_source.members(spark, folder).collect()} == {"old"}
    assert len(os.listdir(folder)) == 1


def test_an_attempt_that_was_run_again_does_not_count(tmp_path):
    """Two attempts of a task: only the one that Spark commits stays."""
    import pyarrow as pa

    folder = str(tmp_path)
    w = package_source.PackageWriter({"path": folder}, False)
    batch = lambda: iter([pa.RecordBatch.from_pydict({"path": ["p", "p"], "part": ["a", "b"], "content": [b"1", b"2"]})])
    w.write(batch())
    w.commit([w.write(batch()), None])
    assert [len(files) for _, _, files in os.walk(folder)] == [0, 0, 1]
