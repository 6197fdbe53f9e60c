"""Shared helpers: table reading, scratch tables, word expressions, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the six ASCII white-space characters that separate words.
WHITE = "\t\n\x0b\f\r "
#: Records, and bytes, per Arrow batch handed to a Python worker: many long texts in a row stay bounded.
ARROW_ROWS = 256
ARROW_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the scratch tables that this process has written and not deleted.
_LIVE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on a single machine, where none is named, a temporary one.

    Executors of a cluster don't see each other's folders, so without a shared one this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scrivano-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Spark's switch that deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again.  The shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/scrivano-{uuid.uuid4().hex}"
    _LIVE.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    if path in _LIVE:
        _LIVE.remove(path)


def discard(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def scratch_mark() -> int:
    return len(_LIVE)


def discard_since(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Delete the scratch tables written since the mark but those kept.

    An operator's result may read its scratch tables until it has been used; then its caller calls this.
    """
    stay = {getattr(df, "_scratch", None) for df in kept}
    for path in _LIVE[mark:]:
        if path not in stay:
            _delete(spark, path)


def fresh(taken, name: str) -> str:
    """A column name like name that none of those taken has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its name as it stands, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame) -> Column:
    """All of df's columns as one struct, so that helper columns beside it clash with none of them."""
    return F.struct(*(column(c) for c in df.columns))


def rows_of(df: DataFrame, names: list[str], row: str = "row") -> DataFrame:
    """The structs of row_of as columns again."""
    return df.select(*(F.col(row).getField(c).alias(c) for c in names))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds.  A lower number of records that the session has stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def as_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string").cast("binary"), F.lit(bytearray()))


def words(text: Column) -> Column:
    """Array of the runs of characters other than ASCII white space; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Copies of one row that a single task makes at a time.
RUN = 1024


def repeated(df: DataFrame, n: Column) -> DataFrame:
    """Each row n times.  Rows asked for very often are first dealt out in runs."""
    names = df.columns
    asked = df.select(row_of(df).alias("row"), n.cast("long").alias("n")).where("n > 0")
    many = asked.where(f"n > {RUN}").withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
    many = many.withColumn("n", F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN)).repartition(F.col("run"), F.xxhash64("n"))
    both = asked.where(f"n <= {RUN}").unionByName(many.select("row", "n"))
    return rows_of(both.select("row", F.explode(F.expr("sequence(1L, n)")).alias("i")), names)


def pick(df: DataFrame, plan: DataFrame, key: str | Column, text_col: str) -> DataFrame:
    """Rows of df as often as plan says, with df's columns.

    plan (id, k, n, copies) has one row for each kept pair of key and text key, the number n of df's
    rows with that pair, and the number of rows that shall come out for it in all.
    """
    names, key = df.columns, column(key) if isinstance(key, str) else key
    d = df.select(row_of(df).alias("row"), key.alias("id"), text_key(column(text_col)).alias("k"))
    p = plan.select(F.col("id").alias("p_id"), F.col("k").alias("p_k"), F.col("n").cast("long").alias("rows"), F.col("copies").cast("long").alias("copies")).where("copies > 0")
    joined = d.join(p, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("k") == F.col("p_k")))
    single = joined.where("rows = 1").select("row", "copies")
    once = repeated(single, F.col("copies")).select("row")
    # Rows alike in key and text: alike rows collapse, then variants share the copies by running sums.
    alike = joined.where("rows > 1").groupBy("row", "id", "k", "rows", "copies").agg(F.count("*").alias("same"))
    order = Window.partitionBy("id", "k").orderBy("row")
    alike = alike.withColumn("upto", F.sum("same").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.expr("(copies * upto) div rows - (copies * (upto - same)) div rows")
    return rows_of(once.unionByName(repeated(alike.select("row", share.alias("share")), F.col("share")).select("row")), names)
