"""From documents to tokens: quality rules, near-duplicates, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next stage's docs.  All but the last return the columns of
documents; the last has one row per document taken, with its token ids.

Defined results of the stages: a null text is an empty one, so the rules reject it; nulls in other columns stay, a null
source is a source of its own, a null id comes after all others.  Repeated rows are documents each; of a group of
near-duplicates, repeated rows among them, the one with the smallest id stays, then the one with the smallest text key.
Texts are read whole, whatever their length.  Other columns pass through, but for the last stage; an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.llm import bpe, mixing, pii, quality, simhash
from scrivano.llm.common import discard_since, read, scratch_mark, written
from scrivano.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.rated(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have Jaccard similarity 0.8 or more: the one with the smallest id."""
    return simhash.deduplicated(docs, jaccard=(4, 5))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced and n_chars counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids and n_tokens."""
    out = bpe.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer())
    return out.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("bpe_encoding", encode),
]

#: SQL has no XXH64 shingles and components, cube method or BPE: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mark = scratch_mark()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        discard_since(spark, mark, docs)  # the stage before, and what this one wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
