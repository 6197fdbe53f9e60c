"""Stores: artifacts held by digest, labelled sets, replies, reports and redacted logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

#: Keys whose values are content.
CONTENT_KEYS = (
    "text original_text proposed_text resume_text job_description company_details candidate_notes candidate_name prompt response evidence file_name"
).split()


def put_artifacts(artifacts: DataFrame, path: str) -> None:
    """Write session_id, artifact_id, kind, content with digest and size, in a folder for each kind."""
    rows = artifacts.withColumns({"sha256": F.sha2("content", 256), "size": F.length("content").cast("long")})
    rows.write.mode("append").partitionBy("kind").parquet(path)


def get_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """The artifacts, each with sound: whether its bytes still have the digest they were stored with."""
    return spark.read.parquet(path).withColumn("sound", (F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("size")))


def labelled_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A labelled set: a JSON document with a list of cases, one row each, with the set's version."""
    whole = spark.read.option("multiLine", True).schema(f"dataset_version string, cases array<struct<{schema}>>").json(path)
    return whole.select("dataset_version", F.explode("cases").alias("c")).select("dataset_version", "c.*")


def scripted_replies(spark: SparkSession, replies: list[tuple[str | None, str | None]]) -> DataFrame:
    """n, reply, error: canned replies in order; one of both is null."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(replies)], "n int, reply string, error string")


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _redacted(value: Column, kind, key: str | None) -> Column:
    if key in CONTENT_KEYS:
        text = F.format_string("<redacted:%d chars>", F.length(value)) if isinstance(kind, StringType) else F.lit("<redacted>")
        return F.when(value.isNotNull(), text)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(_redacted(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields)))
    if isinstance(kind, MapType) and isinstance(kind.valueType, StringType):
        return F.transform_values(value, lambda k, v: F.when(k.isin(*CONTENT_KEYS) & v.isNotNull(), F.format_string("<redacted:%d chars>", F.length(v))).otherwise(v))
    return value


def redacted_log(records: DataFrame) -> DataFrame:
    """Log records with the values of content keys replaced by their lengths, inside structs and maps too."""
    return records.select(*(_redacted(F.col(f.name), f.dataType, f.name).alias(f.name) for f in records.schema.fields))


def truncated_problems(problems: Column, most: int = 10) -> Column:
    """The problems that a model is asked again about, by a fixed number."""
    return F.slice(problems, 1, most)
