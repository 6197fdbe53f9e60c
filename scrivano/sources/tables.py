"""Tables of a directory."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of scratch tables made by this process.
_LIVE: list[str] = []


def scratch(spark) -> str:
    """A new folder in the shared folder of the cluster; a temporary one only on a single machine that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scrivano-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/scrivano-{uuid.uuid4().hex}"
    _LIVE.append(path)
    return path


#: Spark's switch that deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, small: bool = False) -> DataFrame:
    """df written to the shared folder and read again, where several consumers would compute it each.

    Files are compressed so well that Spark takes a table of gigabytes for one of a few MB and sends it to the driver and all
    executors for a join; so joins with it are merge joins, unless it is known to be small whatever the input.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out = out if small else out.hint("merge")
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _LIVE.remove(df._scratch)


#: Rows, and bytes of the last field, that one Arrow batch of each() holds.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def _weight(row: tuple) -> int:
    return len(row[-1]) if isinstance(row[-1], bytes) else 0


def each(df: DataFrame, kind: str, of: Callable, weight: Callable = _weight) -> DataFrame:
    """A row for each tuple of kind that of(value of df's last column) yields, beside the other columns of its row.

    weight(tuple): the bytes it counts as.
    """
    fields = StructType.fromDDL(kind)
    schema = to_arrow_schema(fields)

    def run(batches):
        for b in batches:
            kept = pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1])

            def batch(at, rows, kept=kept):
                columns = zip(*rows)
                made = [pa.array(c, t) for c, t in zip(columns, schema.types)]
                return pa.RecordBatch.from_arrays([*kept.take(pa.array(at)).columns, *made], names=[*kept.schema.names, *schema.names])

            at, rows, size = [], [], 0
            for i, value in enumerate(b.column(b.num_columns - 1)):
                for r in of(value.as_py()):
                    at.append(i)
                    rows.append(r)
                    size += weight(r)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch(at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield batch(at, rows)

    return df.mapInArrow(run, StructType([*df.schema.fields[:-1], *fields.fields]))


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables, once the results that read them have been used."""
    sc = spark.sparkContext
    while _LIVE:
        path = sc._jvm.org.apache.hadoop.fs.Path(_LIVE.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
