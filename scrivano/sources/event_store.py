"""An append-only store of events in batches, and views folded from a snapshot and what came since.

A batch is a folder named by its number, written under another name and then given its own; a batch that is run again
replaces itself by the same rows, so nothing is stored twice whatever fails and is retried.  A view is an aggregate by
key; its snapshot names the last batch that it holds, and reading a view folds the snapshot's rows with the aggregates of
later batches alone.  Readers see whole batches only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

BATCH = re.compile(r"batch=(\d+)$")
SNAPSHOT = re.compile(r"view=(\d+)$")


def _names(spark: SparkSession, folder: str, kind: re.Pattern) -> list[tuple[int, str]]:
    """Numbers and paths of a folder's batches or snapshots, in order."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    paths = (str(s.getPath()) for s in fs.listStatus(at))
    return sorted((int(m[1]), p) for p in paths if (m := kind.search(p)))


def _put(df: DataFrame, folder: str, name: str) -> None:
    """Write a folder under a passing name, then give it its own: it is there whole or not at all."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    passing, own = path(f"{folder}/_{name}"), path(f"{folder}/{name}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(str(passing))
    fs = own.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(own):
        fs.delete(own, True)
    if not fs.rename(passing, own):
        raise OSError(f"{passing} could not be named {own}")


def append(events: DataFrame, folder: str, batch: int) -> None:
    """Store events as a batch.  A batch that is there already is replaced, so running it again changes nothing."""
    _put(events, folder, f"batch={batch:012d}")


def appended(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """A running query that stores each micro-batch under its number, until all that is there has been read."""
    writer = stream.writeStream.foreachBatch(lambda df, n: append(df, folder, n)).outputMode(mode)
    return writer.option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()


def _read(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stored(spark: SparkSession, folder: str, schema: StructType, after: int = -1) -> DataFrame:
    """The events of all batches later than one."""
    return _read(spark, [p for n, p in _names(spark, folder, BATCH) if n > after], schema)


def latest(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The last batch alone: for streams that put out all their rows with each batch."""
    return _read(spark, [p for _, p in _names(spark, folder, BATCH)][-1:], schema)


@dataclass(frozen=True)
class View:
    """keys; aggregates of events, each with a name; and by name how two of its values become one."""

    keys: tuple[str, ...]
    of: tuple[Column, ...]
    merge: dict[str, Callable[[str], Column]]

    def over(self, events: DataFrame) -> DataFrame:
        return events.groupBy(*self.keys).agg(*self.of)

    def merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(*(f(c).alias(c) for c, f in self.merge.items()))


def folded(spark: SparkSession, folder: str, view: View, schema: StructType) -> DataFrame:
    """The view over all events, from its last snapshot and the batches since."""
    shots = _names(spark, folder, SNAPSHOT)
    after = shots[-1][0] if shots else -1
    since = view.over(stored(spark, folder, schema, after))
    return view.merged(since.unionByName(_read(spark, [shots[-1][1]], since.schema))) if shots else since


def snapshot(spark: SparkSession, folder: str, view: View, schema: StructType) -> int:
    """Keep the view as it is; returns the last batch that it holds, -1 if there is none."""
    batches = _names(spark, folder, BATCH)
    if not batches:
        return -1
    last = batches[-1][0]
    if last not in (n for n, _ in _names(spark, folder, SNAPSHOT)):
        _put(folded(spark, folder, view, schema), folder, f"view={last:012d}")
    return last
