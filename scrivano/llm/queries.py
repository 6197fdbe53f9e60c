"""Queries opN_<name>: the operators, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, host_words, html_text, lexical, licenses, mixing, ogg, pii, quality, secrets, sharding, simhash
from .common import read


def tokenizer() -> str:
    """Where the tokenizer file lies; the driver reads it, executors get it by broadcast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.rated(read(spark, sf_dir, "documents")).select("doc_id", *names, "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.describe(read(spark, sf_dir, "documents"))


def document_path():
    """Documents have no paths: source, language and runs of ids stand in for a tree."""
    part = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    run = lambda n: F.coalesce((F.floor(F.col("doc_id") / n)).cast("string"), F.lit("none"))
    return F.concat_ws("/", part("source"), part("lang"), run(10_000), run(100), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), document_path()).select("doc_id", "licence", "origin", "score", "licensed_by")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = host_words.lexicon(read(spark, sf_dir, "documents"))
    return host_words.judged(read(spark, sf_dir, "pages"), counts).select("page_id", "host", "path", "rule", "verdict")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup, op2_html_extraction, op3_source_mixing, op4_sharding, op5_bpe_roundtrip,
        op6_quality_rules, op7_pii, op8_secret_scan, op9_ogg_media, op10_license_scan,
        op11_url_filter, op12_lexical_search, op13_filter_audit,
    )
}
