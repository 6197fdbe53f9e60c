"""Terms inside texts against a check of every pair, and what the plan makes of it."""

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.operators import substrings
from scrivano.plans import document_queries

SF = "/root/testdata/sf0.001"


def nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab-é\U0001f600\n$.") for _ in range(n))
    texts = [(i, word(rng.choice([0, 1, 3, 20, 200]))) for i in range(80)] + [(5, "a second text of one id"), (90, None), (None, "ab" * 9), (91, "")]
    terms = [word(rng.choice([1, 2, 3, 4, 5, 9])) for _ in range(60)] + [None, "", "text of", "ab", "ab", texts[7][1] or "x"]
    t, q = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    got = [tuple(r) for r in substrings.containing(t, q).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, x) for i, s in texts for x in terms if i is not None and s and x and x in s}
    assert substrings.containing(t, q.where("false")).count() == 0
    assert substrings.containing(t.where("false"), q).count() == 0


def test_a_term_longer_than_any_text(spark):
    t = spark.createDataFrame([(1, "aaaa")], "id long, text string")
    assert substrings.containing(t, spark.createDataFrame([("a" * 5000,), ("aaaa",)], "term string")).collect() == [(1, "aaaa")]


def test_few_pairs_meet(spark):
    """Each text has common parts and one of its own: what meets is near what comes out, not all texts by all terms."""
    t = spark.createDataFrame([(i, f"a common beginning {i:05d}x and a common end") for i in range(2000)], "id long, text string")
    q = spark.createDataFrame([(f"beginning {i:05d}x and",) for i in range(0, 4000, 10)], "term string")
    met = substrings.candidates(t, q, DataFrame.cache)
    out = substrings.containing(t, q)
    assert out.count() == 200 and met.count() <= 4000  # of 800,000


def test_coverage_has_no_nested_loop(spark):
    plan = nodes(document_queries.coverage_estimate(spark, SF)) + nodes(document_queries.phrases_held(spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grams(spark):
    d = spark.createDataFrame([("abcab\n",), ("ab",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(substrings.grams(F.col("t"), 3)).collect()] == [["abc", "bca", "cab", "ab\n"], [], [], None]
