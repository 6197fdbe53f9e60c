"""Documents compared in their row against the same ones as rows of words."""

import random

import numpy as np
import pytest

from scrivano.operators import calibration, layout, layout_rows
from scrivano.plans import layout_queries

WORD = "case int, ord int, text string, page int, x0 double, top double, size double, font string, color string, marked boolean"
FONTS, COLORS = ("AB+Serif", "CD+Serif", "Sans", None, ""), ("black", "red", None)


def side(rng, texts, spread):
    n = len(texts)
    number = lambda most: np.array([rng.randrange(most) for _ in range(n)], np.int64)
    off = np.array([rng.choice((0, 0, 0, *spread)) for _ in range(n)], float)
    ords = np.arange(n)
    return layout_rows.Words(texts, np.array([rng.random() < 0.1 for _ in range(n)], bool), ords // 30 + number(20) // 19, ords % 5 * 50 + off, ords // 5 * 12.0 + off[::-1] / 10, 10 + number(3) * 0.1, number(len(FONTS)), number(len(COLORS)), FONTS, COLORS)


def rows(case, w):
    cells = zip(w.page.tolist(), w.x0.tolist(), w.top.tolist(), w.size.tolist(), [FONTS[i] for i in w.font], [COLORS[i] for i in w.color], w.marked.tolist())
    return [(case, i, t, *c) for i, (t, c) in enumerate(zip(w.text, cells))]


@pytest.fixture(scope="module")
def cases():
    rng, out = random.Random(8), {}
    for case in range(30):
        texts = [rng.choice("abcde") if rng.random() < 0.5 else f"w{rng.randrange(99)}" for _ in range(rng.randrange(70))]
        other = [t for t in texts if rng.random() < 0.95] + ["new"] * (case % 3)
        if case % 4 == 0:
            other = texts  # nothing but places differs
        out[case] = side(rng, texts, (0.3, 0.75, 1.6)), side(rng, other, (0.3, 0.76, 1.6) if case % 5 else (0.2,))
    return out


def test_rows_of_a_document_tell_what_rows_of_words_do(spark, cases):
    before, after = (spark.createDataFrame([r for c, both in cases.items() for r in rows(c, both[k])], WORD) for k in (0, 1))
    pairs, first = layout.aligned(before, after).cache(), layout.first_marked(before)
    got = lambda of: sorted((c, *r) for c, both in cases.items() for r in of(*both))
    want = lambda df: sorted(map(tuple, df.collect()))
    assert got(layout_rows.word_findings) == want(layout.word_findings(pairs, first).unionByName(layout.edited_lines(before, after)))
    assert got(layout_rows.reflow_tops) == want(layout.reflow_tops(pairs))
    key = lambda r: (r[0], str(r[1]), r[2])
    told = [(c, *r) for c, both in cases.items() for r in layout_rows.deviations(*both)]
    assert sorted(told, key=key) == sorted(map(tuple, calibration.deviations(pairs, first).collect()), key=key)
    assert len({r[1] for r in got(layout_rows.word_findings)}) >= 6


def test_a_deviation_of_a_threshold_is_no_more_than_it():
    """451.7 - 450.2 is more than 1.5 in binary fractions."""
    none = np.zeros(2, np.int64)
    a, b = (layout_rows.Words(["a", "b"], none > 0, none, np.array(x), none * 1.0, none * 1.0, none, none, ("f",), ("k",)) for x in ([0.0, 450.0], [0.2, 451.7]))
    assert list(layout_rows.deviations(a, b)) == [(1.7, 1.5)]


def test_words_pass_no_shuffle(spark):
    """As words and windows over their lines, texts filled the disk with what sorts spilled."""
    docs = spark.createDataFrame([(1, "a b c, letters a"), (2, None)], "doc_id long, text string")
    found = layout_queries._short(docs, "code string, severity string, n long", layout_rows.word_findings)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert {r.case for r in found.collect()} == {1}
