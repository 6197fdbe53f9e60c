"""Blocks: one row per line of a document, with stable ids; and edits generated on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, ord, text, version, text_hash, location_id, editable."""
    lines = docs.select("doc_id", F.sha2("text", 256).alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    out = lines.withColumn("text_hash", F.substring(F.sha2("text", 256), 1, 16))
    key = F.concat_ws("|", "version", F.lit("body"), F.concat(F.lit("p["), "ord", F.lit("]")), "text_hash")
    return out.withColumn("location_id", F.concat(F.lit("loc_"), F.substring(F.sha2(key, 256), 1, 16))).withColumn("editable", F.btrim("text") != "")


def edits(b: DataFrame) -> DataFrame:
    """Two edits for a block whose second word has room for both (three characters): the word replaced, and a range inside it."""
    words = F.split("text", " ", 3)  # the first two, and the rest as it is
    w0, w1 = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    kind = F.col("ord") % 6
    new = F.when(kind == 0, F.concat(w1, w1)).when(kind == 1, F.concat(w1, F.lit(" 25%"))).when(kind == 2, F.concat(F.lit("led "), w1)).when(kind == 3, F.concat(w1, F.lit(" see www.example.com"))).when(kind == 4, F.repeat(F.concat(w1, F.lit(" ")), 40)).otherwise(w1)
    start = F.length(w0) + 1
    first = F.struct(F.lit(0).alias("n"), start.alias("start"), (start + F.length(w1)).alias("end"), w1.alias("original"), new.alias("proposed"), F.when(F.col("ord") % 4 != 0, (F.col("ord") % 10) / 10.0).alias("confidence"))
    second = F.struct(F.lit(1).alias("n"), (start + 1).alias("start"), (start + 3).alias("end"), F.substring("text", F.length(w0) + 3, F.lit(2)).alias("original"), F.lit("Q7").alias("proposed"), F.lit(0.35).alias("confidence"))
    usable = b.where((F.size(words) >= 2) & (F.length(w1) >= 3))
    return usable.select("doc_id", "ord", "text", F.explode(F.array(first, second)).alias("e")).select("doc_id", "ord", "text", "e.*")


def located(locators: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, locator, n, location_id: the block of the same document whose text contains the locator, null unless it is the only one."""
    held = F.count_if(F.coalesce(F.col("text").contains(F.col("locator")), F.lit(False)))
    only = F.max(F.when(F.col("text").contains(F.col("locator")), F.col("location_id")))
    found = locators.select("doc_id", "locator").distinct().join(b.select("doc_id", "text", "location_id"), "doc_id", "left").groupBy("doc_id", "locator").agg(held.alias("n"), only.alias("location_id"))
    return found.withColumn("location_id", F.when(F.col("n") == 1, F.col("location_id")))
