"""Text functions and edit rules on strings made for them."""

import pytest
from pyspark.sql import functions as F

from scrivano.functions import text as T
from scrivano.operators import edit_rules as R


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, claims",
    [("5%6", {"5%", "6"}), ("$1,200", {"$1200"}), ("4.50 percent", {"4.5%"}), ("v1.2", set()), ("Three of 10K", {"three", "10k"}), ("100 and 2.0", {"100", "2"})],
)
def test_numeric_claims(spark, text, claims):
    assert set(one(spark, T.numeric_claims(F.col("t")), t=text)) == claims


def test_named_terms(spark):
    got = one(spark, T.named_terms(F.col("t")), t="We use FastAPI and Node.js. Then Berlin and C++, (AWS).")
    # an inner ".x" keeps the last dot, and a bracket before a dot stays
    assert set(got) == {"FastAPI", "Node.js.", "Berlin", "C++", "AWS)"}


def test_prefix_stems_match_more_than_verbs(spark):
    assert one(spark, T.introduced_verbs(F.col("a"), F.col("b"), F.lit("")), a="did work", b="ledger work") == ["ledger"]


@pytest.mark.parametrize("text, needle, status", [("aaa", "aa", "ambiguous_target"), ("abc", "b", "unique"), ("abc", "x", "target_not_found"), ("abc", "", "empty_target")])
def test_overlapping_search(spark, text, needle, status):
    assert one(spark, R.locate_status(F.col("t"), F.col("n")), t=text, n=needle) == status


def test_greedy_takes_touching_not_overlapping(spark):
    rows = [(1, 0, "abcdef", 0, 0, 2, "Q", 0.9), (1, 0, "abcdef", 1, 1, 3, "R", 0.8), (1, 0, "abcdef", 2, 2, 4, "S", None), (1, 0, "abcdef", 3, 4, 6, "XY", 0.1)]
    e = spark.createDataFrame(rows, "doc_id long, ord int, text string, n int, start int, end int, proposed string, confidence double")
    got = R.applied(R.greedy(e)).first()
    assert (got["new_text"], got["n_applied"]) == ("QSXY", 3)


@pytest.mark.parametrize("text, link", [("tion.aiçtion.", True), ("ai çdev.io", True), ("see example.com", True), ("example.comç", True), ("example.coms", False), ("x_example.com_", False), ("no link", False)])
def test_links_end_where_ascii_words_do(spark, text, link):
    """As in the SQL: a letter that is not ASCII ends a word, whatever Java's version makes of it."""
    assert one(spark, F.col("t").rlike(R.LINK_JAVA), t=text) == link


def test_units_end_where_ascii_words_do(spark):
    assert set(one(spark, T.numeric_claims(F.col("t")), t="5 kç 7 percenté 8 kg 9x")) == {"5k", "7%", "8", "9x"}
