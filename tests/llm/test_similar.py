"""The pipeline's near-duplicates against brute-force Jaccard over all pairs."""

import random

from similar_pairs import brute

import corpus_pipeline
from scrivano.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_is_brute_force_jaccard(spark):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for n in (5, 9, 12, 30, 80, 300):
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        texts += [base, base[1:], [w.upper() for w in base], base + passage]
        for cuts in (1, 1, 2, 3, 5, 8):  # on both sides of 0.8
            t = list(base)
            for _ in range(cuts):
                t[rng.randrange(n)] = f"x{rng.randrange(9999)}"
            texts.append(t)
    chain = [f"c{i}" for i in range(60)]
    texts += [chain[i : i + 40] for i in range(0, 12, 3)] + [["one"], ["One"], [], ["a", "b"]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " \n")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], SCHEMA).repartition(5)
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    want = brute(docs)
    assert sorted(r.doc_id for r in got) == sorted(want) and len(want) < len(docs) - 10


def test_stage_on_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_two_words_changed_is_one_group(spark):
    """Far more than three bits apart, at Jaccard 0.9."""
    base = [f"w{i}" for i in range(200)]
    other = base[:50] + ["x"] + base[51:150] + ["y"] + base[151:]
    df = spark.createDataFrame([(1, " ".join(base), "en", "s", 1), (2, " ".join(other), "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()] == [1]
    assert similar.similar(*(similar.shingles(" ".join(t).encode()) for t in (base, other)))


def test_scratch_tables_take_half_of_the_texts_at_most(spark, monkeypatch):
    """Sets of hashes take more disk than their texts, and nothing shortens them."""
    from pathlib import Path

    rng, sizes, written = random.Random(3), [], similar.written
    bases = [[f"w{rng.randrange(4000)}" for _ in range(300)] for _ in range(60)]
    texts = [" ".join(t) for b in bases for t in (b, b[:150] + ["x"] + b[151:])]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).coalesce(1)

    def seen(frame):
        out = written(frame)
        sizes.append(sum(p.stat().st_size for p in Path(out._scratch.removeprefix("file://")).glob("*.parquet") if "grams" in out.columns or {"raw", "node"} <= set(out.columns)))
        return out

    monkeypatch.setattr(similar, "written", seen)
    assert corpus_pipeline.near_duplicates(spark, df, "").count() == 60
    assert 0 < max(sizes) < sum(map(len, texts)) / 2  # near copies shorten both


def test_parities_differ_in_no_more_bits_than_sets():
    rng = random.Random(5)
    for n in (1, 3, 40, 300, 2000):
        base = [f"w{rng.randrange(900)}" for _ in range(n + 4)]
        for cuts in (0, 1, 4, n // 2, n):
            other = [f"x{rng.randrange(900)}" if i < cuts else w for i, w in enumerate(base)]
            a, b = (similar.shingles(" ".join(t).encode()) for t in (base, other))
            bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(similar.parity(a), similar.parity(b), strict=True))
            assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (bits > 0 or cuts == 0 or n > 300)
    assert similar.parity(similar.shingles(b"")) == [0] * similar.PARITIES


def tables(spark, texts, least=similar.LEAST):
    """What shows() and apart() are given: raw texts, nodes with parities, counts of buckets."""
    from scrivano.llm.common import written

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    raw = df.selectExpr("id", "0L AS k", "cast(text AS binary) AS raw")
    both = written(raw.mapInArrow(similar._nodes, "id long, k long, node long, fp long, parity array<long>, bucket int, n long"))
    return raw.select("raw"), both.where("bucket IS NULL"), both.where("bucket IS NOT NULL").select("bucket", "n")


def test_hubs_of_hot_shingles(spark, monkeypatch):
    """Salted or not, the same shingles with the same hubs."""
    base = [f"w{i}" for i in range(20)]
    texts = [" ".join([*base[:3], f"a{i % 5}", *base[4:15], f"b{i // 5}", *base[16:]]) for i in range(60)] + ["one shingle of five"] * 3
    got = []
    for share in (1, 256):
        monkeypatch.setattr(similar, "HOT_SHARE", share)
        raw, _, buckets = tables(spark, texts)
        held, kept = similar.shows(raw, buckets)
        assert (kept[0].where("salt > 0").count() > 0) == (share > 1)
        got.append(sorted((r.gram, r.node, r.n, r.at, tuple(r.hub)) for r in held.collect()))
    assert got[0] == got[1] and got[0]


def apart(spark, texts, found):
    raw, nodes, buckets = tables(spark, texts)
    held, _ = similar.shows(raw, buckets)
    return {tuple(r) for r in similar.apart(held, found, nodes.select("node", "parity")).collect()}


def test_a_family_does_not_meet_itself(spark):
    """All of one component but one text apart: the pairs are of that text alone, and no pair is lost."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:50], f"x{i}", *base[51:]]) for i in range(40)]
    names = [similar.node(similar.shingles(t.encode())) for t in texts]
    lone = names[-1]
    joined = spark.createDataFrame([(n, min(names[:-1])) for n in names[:-1]], "node long, root long")
    assert apart(spark, texts, joined) == {(min(n, lone), max(n, lone)) for n in names[:-1]}
    # nothing joined yet: all pairs
    assert apart(spark, texts, spark.createDataFrame([], "node long, root long")) == {(min(a, b), max(a, b)) for i, a in enumerate(names) for b in names[:i]}


def test_sizes_that_may_be_alike_are_one_step_apart(spark):
    from pyspark.sql import functions as F

    rows = [(a, b) for a in range(1, 400) for b in range(a, min(a * 5 // 4, 500) + 1) if 5 * a >= 4 * b]
    d = spark.createDataFrame(rows, "a int, b int").select((similar._step("b", similar.LEAST) - similar._step("a", similar.LEAST)).alias("d"))
    assert d.agg(F.max("d"), F.min("d")).first() == (1, 0)
