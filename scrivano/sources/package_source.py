"""Packages as a data source: member rows read from ZIP files in place, and packages written all or none.

Reading: files are dealt to partitions by their bytes.  Of a file only the central directory is read and the members
whose names are asked for, each by its place in the file; media that nobody asks for are never read.  Names are options
of the read: Spark 4.1 can hand filters to a Python source, but a table read twice keeps the first query's filters where
the second has none to hand over, and loses rows (seen in our tests), so filters are left to Spark.
Writing: a task writes whole packages under a folder of its attempt, the driver keeps the attempts that Spark commits
and gives their folder its name in one step; what a failed job wrote is deleted.

Files are opened by pyarrow's file systems from the workers, so a folder must be one that these and all executors reach
(a shared mount, or a store whose URI pyarrow knows); sources.packages reads by Spark's own readers what they alone reach.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .packages import MAX_UNCOMPRESSED, MEMBERS, _read, sound_xml

FORMAT = "scrivano-packages"
SCHEMA = f"path string, {MEMBERS}"
#: Bytes of files of a partition, and of members' contents of an Arrow batch.
PARTITION_BYTES, BATCH_BYTES, BATCH_ROWS = 32 << 20, 8 << 20, 1024


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path on it."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return pafs.LocalFileSystem(), uri


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(0)
        self.paths = paths


@dataclass(frozen=True)
class Wanted:
    """Which members are asked for: those of these names and those that end so; all, if neither is given."""

    names: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()

    def has(self, part: str) -> bool:
        return not (self.names or self.ends) or part in self.names or part.endswith(self.ends)


def wanted_rows(file, wanted: Wanted, most: int, contents: bool) -> Iterator[tuple]:
    """A tuple of MEMBERS for each wanted member; file is open for reading and seeking.  A file that is no ZIP gives one row with ord -1."""
    try:
        z = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, zipfile.LargeZipFile, ValueError):
        yield -1, None, False, False, 0, 0, 0, "bad_zip", None, None
        return
    room = most
    for i, info in enumerate(z.infolist()):
        if wanted.has(info.filename):
            body = fault = xml = None
            if contents:
                body, fault = (b"", None) if info.is_dir() or room < 0 else _read(z, info, room)
                room -= len(body)
                xml = sound_xml(body) if info.filename.endswith((".xml", ".rels")) else None
            yield i, info.filename, info.is_dir(), bool(info.flag_bits & 1), info.file_size, info.compress_size, len(body or b""), fault, xml, body


class PackageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.schema, self.root = schema, options["path"]
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.most = int(options.get("mostuncompressed", MAX_UNCOMPRESSED))
        self.contents = options.get("contents", "true").lower() != "false"
        self.wanted = Wanted(*(tuple(json.loads(options.get(k, "[]"))) for k in ("names", "ends")))

    def partitions(self) -> list[Files]:
        fs, root = opened(self.root)
        found = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File]
        shown = sorted((i for i in found if not any(p.startswith(("_", ".")) for p in i.path.removeprefix(root).split("/"))), key=lambda i: i.path)
        out: list[list[str]] = []
        room = 0
        for i in shown:
            if not out or i.size > room:
                out.append([])
                room = max(self.size, i.size)
            out[-1].append(i.path)
            room -= i.size
        return [Files(tuple(x)) for x in out] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        kind = to_arrow_schema(self.schema)
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for row in wanted_rows(file, self.wanted, self.most, self.contents):
                    rows.append((path.rsplit("/", 1)[-1], *row))
                    size += row[6]
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(rows, kind)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, kind)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


@dataclass
class Attempt(WriterCommitMessage):
    name: str
    packages: int


class PackageWriter(DataSourceArrowWriter):
    """Rows of path, part and content; those of one path come to one task next to each other."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, root = opened(self.root)
        name = uuid.uuid4().hex
        folder = f"{root}/_job-{self.job}/{name}"
        fs.create_dir(folder, recursive=True)
        done: set[str] = set()
        path, out, z = None, None, None

        def close() -> None:
            if z is not None:
                z.close()
                out.close()

        try:
            for b in iterator:
                for own, part, content in zip(*(b.column(c).to_pylist() for c in ("path", "part", "content")), strict=True):
                    if z is None or own != path:
                        close()
                        z = None
                        if not own or "/" in own or own.startswith((".", "_")) or own in done:
                            raise ValueError(f"not the name of one package: {own!r}")
                        done.add(own)
                        path, out = own, fs.open_output_stream(f"{folder}/{own}")
                        z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    if not part or part in z.NameToInfo:
                        raise ValueError(f"{own}: not the name of one member: {part!r}")
                    z.writestr(zipfile.ZipInfo(part), content or b"", zipfile.ZIP_DEFLATED)
        finally:
            close()
        return Attempt(name, len(done))

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, root = opened(self.root)
        job, kept = f"{root}/_job-{self.job}", {m.name for m in messages if m}
        before = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.startswith("packages-")]
        for i in fs.get_file_info(pafs.FileSelector(job, allow_not_found=True)):
            if i.base_name not in kept:  # of a task that was run again
                fs.delete_dir(i.path)
        if kept:
            fs.move(job, f"{root}/packages-{self.job}")
        for path in before if self.overwrite else ():
            fs.delete_dir(path)

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, root = opened(self.root)
        if fs.get_file_info(f"{root}/_job-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_job-{self.job}")


class PackageSource(DataSource):
    """Options: path; names and ends (JSON lists of members' names and endings); partitionBytes; mostUncompressed (of a package); contents (false: the central directory alone)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PackageReader:
        return PackageReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(dict(self.options), overwrite)


def members(spark: SparkSession, path: str, names: Iterable[str] = (), ends: Iterable[str] = (), **options) -> DataFrame:
    """SCHEMA: the members of all packages under a folder, those of these names or endings only if any are given."""
    spark.dataSource.register(PackageSource)
    return spark.read.format(FORMAT).options(names=json.dumps([*names]), ends=json.dumps([*ends]), **options).load(path)


def write(parts: DataFrame, path: str, mode: str = "append", order: Callable[[], list] | None = None) -> None:
    """parts (path, ord, part, content) as packages under a folder: all of them, or nothing where one fails.

    A package is written by one task from its rows in order; names are plain file names, and unique.
    """
    parts.sparkSession.dataSource.register(PackageSource)
    rows = parts.repartition("path").sortWithinPartitions("path", *(order() if order else ["ord"]))
    rows.select("path", "part", F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode(mode).save(path)
