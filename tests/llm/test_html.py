"""Main text of pages: contract cases, counting held against two plain passes, broken and hostile markup."""

import collections
import random
import re
import time
from html.parser import HTMLParser

import pytest

from scrivano.llm import html_text as H

SCHEMA = "page_id long, url string, html string"


def text(html):
    return H.text_of(H.parse(html))


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>x <b>bo</b>ld<br>y&amp;z<p>t<ul><li>1<li>2</ul>", "x bold y&z t 1 2"),
        ("<article><p>a</p><div class='search-results'><p>core text</p></div><p class='related-work'>more</p></article>", "a core text more"),
        ("<article><p>a</p><div class='comment-list'>c</div><div class=comments><p>c</p></div><div class='ad-slot'>c</div><p>b</article>", "a b"),
        ("<p title=\"a>Hello</p>", "Hello"), ("<a title=\"x>y\">z</a>", "z"), ("<p>if a < b and c</p>", "if a < b and c"),
        ("<script>var t='</p>';</script>q<style>p{}</style>", "q"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("", ""), ("<title>x", ""),
        ("<nav>n</nav><main><h1>T</h1><form>f</form>m</main><footer>f</footer>", "T m"), ("<p>a<!-- c > --> b</p>", "a b"), ("a &#233; &nope;", "a é &nope;"),
    ],
)
def test_cases(html, want):
    assert text(html) == want


@pytest.mark.parametrize("html", ["<a " * 700_000, "<a b=\">\" " * 200_000, "<div>" * 300_000 + "</x>" * 300_000, "<p>" + "<div>" * 300_000, "<ul>" + "<div><li></li>" * 100_000, "<table><tr>" + "<td><b>" * 150_000, "<a b=\"" * 300_000, "<!--" * 500_000])
def test_hostile_markup_takes_seconds(html):
    began = time.time()
    root = H.parse(html)
    H.hashed(root)
    H.text_of(root)
    assert time.time() - began < 40


class Plain(HTMLParser):
    """Blocks of well-formed pages as (place, serialised subtree, text) by the standard library's parser."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.blocks = [], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, dict(attrs).get("class"), []))

    def handle_data(self, data):
        if data.strip():
            self.stack[-1][2].append(data)

    def handle_endtag(self, tag):
        name, cls, parts = self.stack.pop()
        if self.stack:
            self.stack[-1][2].append((name, cls, parts))
        else:
            self.root = (name, cls, parts)


def subtree(node):
    return (node[0], tuple(subtree(p) if isinstance(p, tuple) else p for p in node[2]))


def all_of(node):
    yield node
    for p in node[2]:
        if isinstance(p, tuple):
            yield from all_of(p)


def kept_text(node, drop_out, drop_in, within=False):
    within = within or node[0] == "article"
    out = []
    for p in node[2]:
        if isinstance(p, str):
            out.append(p)
        elif p[0] != "article" and subtree(p) in (drop_in if within else drop_out) or p[1] == "ad" or p[0] in ("nav", "footer"):
            continue
        else:
            out.append(kept_text(p, drop_out, drop_in, within))
    return " ".join(" ".join(out).split())


def brute(pages):
    """Text of each page: two passes over plain trees."""
    trees = {i: Plain(html).root for i, _, html in pages}
    article = {i: next(n for n in all_of(t) if n[0] == "article") for i, t in trees.items()}
    host = {i: re.match("http://([^/]+)", url)[1] for i, url, _ in pages}
    mains = {i: kept_text(article[i], (), (), True) for i in trees}
    seen, total = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in trees.items():
        total[host[i]].add(mains[i])
        for n in all_of(t):
            if n[0] not in ("html", "body", "article"):
                seen[host[i], subtree(n)].add(mains[i])
    out = {}
    for i in trees:
        n = len(total[host[i]])
        drop_out = {k for (h, k), m in seen.items() if h == host[i] and len(m) >= 3 and len(m) >= 0.1 * n}
        drop_in = {k for (h, k), m in seen.items() if h == host[i] and len(m) >= 5 and len(m) >= 0.5 * n}
        out[i] = kept_text(article[i], drop_out, drop_in, True)
    return out


def pages():
    """Hosts with furniture that no name marks, inside articles too, passages of prose shared by a few articles, and republished pages."""
    rng, out = random.Random(3), []
    for h, n in (("a.example", 40), ("b.example", 12), ("c.example", 2)):
        shared = [f"<p>Shared passage {k} of {h} in prose.</p>" for k in range(4)]
        for k in range(n):
            body = [f"<p>{' '.join(rng.choice('alpha beta gamma delta eps'.split()) for _ in range(rng.randint(3, 12)))} {k}.</p>" for _ in range(rng.randint(1, 5))]
            if k % 5 == 0:
                body.append(rng.choice(shared))
            inner = "<div><div>Send this page on</div><p>by post</p></div>" if k % 4 else ""
            html = f"<html><body><nav><li>{k}</li></nav><div><p>Top of {h}</p></div><article><h1>Title {k}</h1>{inner}{''.join(body)}<div class='ad'>buy {k}</div></article><section>Legal text of {h}</section><footer>f{k}</footer></body></html>"
            out.append((len(out), f"http://{h}/{k}", html))
    first = out[0][2]
    return [*out, *((100 + k, f"http://a.example/copy{k}", first) for k in range(30))]


def test_counting_is_the_two_plain_passes(spark):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(rows)
    for most in (1 << 16, 0):  # by broadcast, and salted
        got = {r.page_id: r for r in H.extract(df, most=most).collect()}
        assert {i: r.text for i, r in got.items()} == want
        assert all(r.n_chars == len(r.text) for r in got.values()) and sum(r.template_chars > 0 for r in got.values()) > len(rows) / 2
    without = {r.page_id: r.text for r in H.extract(df, use_templates=False).collect()}
    assert sum(without[i] != want[i] for i in want) > len(rows) / 3  # the counts decide
    assert any("Shared passage" in t for t in want.values()) and not any("Send this page" in t for i, t in want.items() if i < 40)


def test_odd_rows(spark):
    body = "<html><head><title>t</title></head><body><div class='promo-strip'>x</div><div>Same top</div><article><h1>T{0}</h1><p>A&amp;B <b>bo</b>ld {0}<p>two<div class=comments><p>c</p></div></article><footer>f</footer>"
    rows = [(i, "http://h.example/a", body.format(i)) for i in range(4)] + [(9, None, None), (None, "x", ""), (10, "http://h.example/b", "<p>plain<div>Same top</div>"), (3, "http://h.example/a", body.format(3))]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("host", "salt", "templates", "id", "hash", "text", "of", "s"):
        df = df.selectExpr("*", f"'extra' AS {c}")
    got = H.extract(df).collect()
    assert [r.page_id for r in got].count(3) == 2 and len(got) == len(rows)
    by = {r.page_id: (r.text, r.n_chars) for r in got}
    assert by[3] == ("T3 A&B bold 3 two", 17) and by[9] == ("", 0) and by[None] == ("", 0)
    assert by[10] == ("plain", 5)  # the recurring block went by its count


def test_counts_change_no_page_of_the_table_for_the_worse(spark):
    """On the driver's pages what recurs is furniture: the article's text is what names alone would leave."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a, b = ({r.page_id: r.text for r in H.extract(df, use_templates=u).collect()} for u in (True, False))
    assert a == b and all(a.values())
