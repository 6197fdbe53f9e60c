"""Main text of web pages: site template removal by counting element subtrees per host.

First pass: each page is parsed and every block element's subtree gets a hash of its tags and text.
Spark counts, for each host and hash, the pages with different main texts that have it; a page that
repeats another page's article counts once, so a republished article is no template.  Second pass:
subtrees that recur are deleted from the whole tree before anything else is looked at.  Outside an
article, TEMPLATE_PAGES pages and TEMPLATE_SHARE of the host's are enough.  Inside one, where passages
of prose may recur too, it takes ARTICLE_PAGES pages and ARTICLE_SHARE of them: what stands in half of a
host's different articles is its furniture, whatever its tag or class name is.

What does not recur goes by the standard's names: navigation, asides, forms, scripts and the like, and
elements of which a class name, id or role says nothing but that they are furniture ("ad-slot",
"comments"; not "search-results" or "related-work").  What is left is the text.

Templates of a host are few: each is on TEMPLATE_SHARE of its pages at least.  They reach the pages
by a broadcast while all of them are at most BROADCAST_HASHES, else by a join salted by page.

Markup.  A quote that is never closed ends with its tag.  A tag that is never closed, or a comment, takes
the rest of the page.  Elements nested deeper than DEPTH belong to the one at that depth.  Reading
takes time in proportion to the page's length.

Defined results: null or blank html gives the empty text; a url without a host belongs to the host
"" ; repeated pages get repeated results; broken markup is read as far as it goes, and an unclosed
element ends with its parent; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import column, small_batches, written

TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.1
ARTICLE_PAGES = 5
ARTICLE_SHARE = 0.5
#: Elements open at a time, as in browsers.
DEPTH = 512
BROADCAST_HASHES = 1 << 16
SALTS = 32

_names = lambda s: frozenset(s.split())
#: Groups of element names of the public HTML standard.
VOID = _names("area base br col embed hr img input link meta param source track wbr")
RAW = _names("script style textarea title xmp iframe noembed noframes noscript plaintext")
INLINE = _names("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr")
CONTENT = _names("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl blockquote pre table thead tbody tfoot tr td th figure figcaption caption")
HEADINGS = _names("h1 h2 h3 h4 h5 h6 hgroup")
DROPPED = _names("head script style title noscript template nav footer aside form button select option textarea input iframe object embed applet canvas svg math audio video dialog menu map noembed noframes xmp fieldset datalist output progress meter")
ENDS_P = _names("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul")
#: Elements that a start tag ends, up to the given ancestors.
SIBLINGS = {
    "li": (_names("li"), _names("ul ol menu")),
    "dt": (_names("dt dd"), _names("dl")),
    "dd": (_names("dt dd"), _names("dl")),
    "tr": (_names("tr td th"), _names("table")),
    "td": (_names("td th"), _names("table tr")),
    "th": (_names("td th"), _names("table tr")),
    "tbody": (_names("thead tbody tfoot tr td th"), _names("table")),
    "option": (_names("option"), _names("select")),
}
BARRIERS = _names("table td th article main section body html")
#: Words of class names, ids and roles of what is not the article.
BAD_WORDS = _names(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail footer footers masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended recommendations comment comments disqus replies respond pagination pager widget widgets search skip "
    "contentinfo complementary tablist form dialog alertdialog"
)
#: Words beside them in names of the same parts.
BESIDE = _names(
    "box boxes list lists wrap wrapper container section sections block blocks inner outer left right top bottom bar links link posts post articles slot unit "
    "area item items form button buttons header title text primary secondary main site page global mobile desktop sticky inline icons icon group panel module content body row col column"
)
GOOD_WORDS = _names("article articlebody content main post entry story")
WORD = re.compile(r"[a-z0-9]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a start tag.  A quote counts after an equals sign, and if it is closed.
TAG_END = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    __slots__ = ("tag", "parts", "bad", "good", "parent", "hash")

    def __init__(self, tag: str, parent: "Node | None", bad: bool = False, good: bool = False):
        self.tag, self.parent, self.bad, self.good, self.parts, self.hash = tag, parent, bad, good, [], 0


def _furniture(part: str) -> bool:
    """Whether a name says that its element is furniture, and nothing else."""
    found = WORD.findall(part)
    return not BAD_WORDS.isdisjoint(found) and all(w in BAD_WORDS or w in BESIDE or w.isdigit() for w in found)


def _judged(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether tag and attributes mark something other than the article, or the article."""
    if tag in DROPPED:
        return True, False
    if not raw or raw.isspace() or tag in ("html", "body"):
        return False, tag in ("article", "main")
    bad, good = False, tag in ("article", "main")
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            for part in value.split():
                if _furniture(part):
                    bad = True
                elif GOOD_WORDS.intersection(WORD.findall(part)) and name != "class" or part in GOOD_WORDS:
                    good = True
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            bad = True
        elif name == "aria-label" and value in ("advertisement", "breadcrumb", "comments"):
            bad = True
    return bad, good


class _Tree:
    """The open elements while a page is read.  Counts of them spare walks that would find nothing."""

    def __init__(self):
        self.root = self.here = Node("#root", None)
        self.depth, self.deeper = 0, 0
        self.open: Counter = Counter()
        self.scopes: list[Counter] = [Counter()]  # of the elements since each barrier

    def push(self, node: Node) -> None:
        self.here.parts.append(node)
        if self.depth == DEPTH:
            self.deeper += 1
            return
        self.here, self.depth = node, self.depth + 1
        self.open[node.tag] += 1
        self.scopes[-1][node.tag] += 1
        if node.tag in BARRIERS:
            self.scopes.append(Counter())

    def pop(self) -> None:
        node = self.here
        if node.tag in BARRIERS:
            self.scopes.pop()
        self.open[node.tag] -= 1
        self.scopes[-1][node.tag] -= 1
        self.here, self.depth = node.parent, self.depth - 1

    def close(self, node: Node) -> None:
        """End node and all that is open in it."""
        while self.here is not node:
            self.pop()
        self.pop()

    def nearest(self, tag: str) -> Node:
        node = self.here
        while node.tag != tag:
            node = node.parent
        return node

    def end(self, tag: str) -> None:
        if self.deeper:  # it ends one of those that were too deep
            self.deeper -= 1
        elif (self.scopes[-1] if tag == "p" or tag in INLINE else self.open)[tag] > 0:
            self.close(self.nearest(tag))

    def make_room(self, tag: str) -> None:
        """End what a start tag ends."""
        if tag in ENDS_P and self.scopes[-1]["p"] > 0:
            self.close(self.nearest("p"))
        if tag in SIBLINGS:
            ended, stop = SIBLINGS[tag]
            if any(self.open[t] > 0 for t in ended):
                node, outer = self.here, None
                while node is not self.root and node.tag not in stop:
                    if node.tag in ended:
                        outer = node
                    node = node.parent
                if outer:
                    self.close(outer)


def parse(source: str) -> Node:
    tree, at, end, quoted = _Tree(), 0, len(source), True

    def text(low: int, high: int) -> None:
        if high > low:
            part = source[low:high]
            tree.here.parts.append(entities.unescape(part) if "&" in part else part)

    def after(mark: str, start: int) -> int:
        found = source.find(mark, start)
        return end if found < 0 else found + len(mark)

    shown = 0  # where the text not yet kept begins
    while (at := source.find("<", at)) >= 0:
        low, c = at, source[at + 1 : at + 2]
        if c in ("!", "?"):
            text(shown, low)
            shown = at = after("-->", at + 2) if source.startswith("<!--", at) else after(">", at)
            continue
        m = NAME.match(source, at + 2 if c == "/" else at + 1)
        if not m:
            at += 1
            continue
        text(shown, low)
        tag = m[0].lower()
        if c == "/":
            shown = at = after(">", m.end())
            if tag == "br":
                tree.here.parts.append(" ")
            else:
                tree.end(tag)
            continue
        stop = TAG_END.match(source, m.end()) if quoted else None
        if not stop:  # no end outside quotes from here on, so none for later tags: they end at the next sign
            quoted = False
        shown = at = stop.end() if stop else after(">", m.end())
        raw = source[m.end() : at - 1]
        tree.make_room(tag)
        if tag in VOID:
            if tag not in ("wbr", "img"):
                tree.here.parts.append(" ")
            continue
        bad, good = _judged(tag, raw)
        node = Node(tag, tree.here, bad, good)
        if tag in RAW:
            tree.here.parts.append(node)
            stop = RAW_END[tag].search(source, at)
            shown = at = stop.end() if stop else end
        elif raw.endswith("/") and tag in ("svg", "path"):
            tree.here.parts.append(node)
        else:
            tree.push(node)
    text(shown, end)
    return tree.root


def _walk(root: Node):
    """Nodes, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    return reversed(order)


def hashed(root: Node) -> None:
    """Give each node the hash of its subtree, 0 for one without text."""
    for node in _walk(root):
        if node.tag in RAW:
            continue
        parts, any_text = [node.tag], False
        for p in node.parts:
            if isinstance(p, Node):
                if p.hash:
                    parts.append(f"\x01{p.hash}")
                    any_text = True
            elif w := p.split():
                parts.append("\x02" + " ".join(w))
                any_text = True
        if any_text:
            node.hash = xxhash.xxh64_intdigest("\x00".join(parts), 7) - (1 << 63)


def roots(root: Node) -> tuple[list[Node], bool]:
    """The elements that hold the article, and whether markup names them."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "good": []}
    stack = [root]
    while stack:
        node = stack.pop()
        if node.bad:
            continue
        if node.tag == "article":
            found["article"].append(node)
            continue
        if node.tag == "main":
            found["main"].append(node)
        elif node.good:
            found["good"].append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    for kind in ("article", "main"):
        if found[kind]:
            return found[kind], True
    if found["good"]:
        held = set(map(id, found["good"]))
        outer = []
        for n in found["good"]:
            p = n.parent
            while p is not None and id(p) not in held:
                p = p.parent
            if p is None:
                outer.append(n)
        return outer, True
    return [root], False


def pruned(root: Node, outside=frozenset(), inside=frozenset()) -> int:
    """Delete the subtrees whose hash is in outside, or, from an article on, in inside; how many characters of text went."""
    if not outside and not inside:
        return 0
    tops, named = roots(root)
    held = set(map(id, tops)) if named else set()
    above: set[int] = set()
    for node in tops if named else ():
        while node is not None and id(node) not in above:
            above.add(id(node))
            node = node.parent
    gone, stack = 0, [(root, False)]
    while stack:
        node, within = stack.pop()
        within = within or id(node) in held
        kept = []
        for p in node.parts:
            if isinstance(p, Node) and p.hash and p.tag not in INLINE and id(p) not in above and p.hash in (inside if within else outside):
                gone += size(p)
                kept.append(" ")
            else:
                kept.append(p)
                if isinstance(p, Node):
                    stack.append((p, within))
        node.parts = kept
    return gone


def size(node: Node) -> int:
    """Characters of text in a subtree, scripts and the like left out."""
    return sum(len(p) for n in _walk(node) if n.tag not in RAW for p in n.parts if isinstance(p, str) and not p.isspace())


def text_of(root: Node) -> str:
    tops, named = roots(root)
    out: list[str] = []
    for top in tops:
        # (node, inside a header of the article) or text
        stack: list = [(top, False)]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            node, header = item
            if node is not top:
                if node.bad:
                    out.append(" ")
                    continue
                if node.tag == "header":
                    if not named:
                        out.append(" ")
                        continue
                    header = True
                elif header and node.tag in HEADINGS:
                    header = False
            block = node.tag not in INLINE
            if block:
                stack.append(" ")
            for p in reversed(node.parts):
                if isinstance(p, Node):
                    stack.append((p, header))
                elif not header:
                    stack.append(p)
            if block:
                stack.append(" ")
        out.append(" ")
    return " ".join("".join(out).split())


def subtrees(root: Node) -> set[int]:
    return {n.hash for n in _walk(root) if n.hash and n.tag not in INLINE and n.tag not in ("#root", "html", "body", "head", "article", "main")}


def _source(df: DataFrame, url_col: str, html_col: str):
    host = F.lower(F.regexp_extract(F.coalesce(column(url_col), F.lit("")), HOST, 1))
    return host.alias("host"), F.coalesce(column(html_col), F.lit("")).alias("html")


def templates(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, hash, pages): subtrees on many pages of a host, counted by different main texts."""

    def run(batches):
        for b in batches:
            hosts, hashes, mains = [], [], []
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = parse(source)
                hashed(root)
                main = xxhash.xxh64_intdigest(text_of(root), 7) - (1 << 63)
                for h in (0, *subtrees(root)):  # 0 counts the host's pages
                    hosts.append(host)
                    hashes.append(h)
                    mains.append(main)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(mains, pa.int64())], names=["host", "hash", "main"])

    found = df.select(*_source(df, url_col, html_col)).mapInArrow(run, "host string, hash long, main long")
    # Distinct first, so that what many pages share is combined before it is counted by key.
    counts = written(found.distinct().groupBy("host", "hash").agg(F.count("*").alias("pages")).where(f"hash = 0 or pages >= {TEMPLATE_PAGES}"))
    # One host may have much of the table: its subtrees are dealt to SALTS tasks, and its total to each of them.
    total = counts.where("hash = 0").select("host", F.col("pages").alias("total"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = counts.where("hash <> 0").withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
    often = salted.join(total.hint("merge"), ["host", "salt"]).where(F.col("pages") >= TEMPLATE_SHARE * F.col("total"))
    inside = (F.col("pages") >= ARTICLE_PAGES) & (F.col("pages") >= ARTICLE_SHARE * F.col("total"))
    return often.select("host", "hash", "pages", inside.alias("inside"))


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", most: int = BROADCAST_HASHES, use_templates: bool = True) -> DataFrame:
    """One row per page: id_col, url, text, n_chars, template_chars (characters of text that went as templates).

    most: templates that may be broadcast.  use_templates=False leaves the counting out.
    """
    spark = df.sparkSession
    small_batches(spark)
    pages = df.select(column(id_col).alias("id"), column(url_col).alias("url"), *_source(df, url_col, html_col))
    none = F.lit(None).cast("array<struct<hash:bigint,inside:boolean>>").alias("templates")
    if use_templates:
        found = written(templates(df, url_col, html_col))
        lists = found.groupBy(F.col("host").alias("of")).agg(F.collect_list(F.struct("hash", "inside")).alias("templates"))
        if found.count() <= most:
            pages = pages.join(F.broadcast(lists), F.col("host") == F.col("of"), "left")
        else:
            pages = pages.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
            lists = lists.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            pages = pages.join(lists.hint("merge"), (F.col("host") == F.col("of")) & (F.col("salt") == F.col("s")), "left")
        pages = pages.select("id", "url", "html", "templates")
    else:
        pages = pages.select("id", "url", "html", none)

    def run(batches):
        known: dict = {}
        for b in batches:
            texts, went = [], []
            for source, drop in zip(b.column(2).to_pylist(), b.column(3)):
                root = parse(source)
                gone = 0
                if drop.is_valid:
                    hashes, flags = (drop.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    key = hashes.tobytes()
                    if key not in known:
                        known.clear()
                        known[key] = frozenset(hashes.tolist()), frozenset(hashes[flags].tolist())
                    hashed(root)
                    gone = pruned(root, *known[key])
                texts.append(text_of(root))
                went.append(gone)
            made = pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(went, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=[id_col, url_col, "text", "n_chars", "template_chars"])

    kinds = [StructField(c, pages.schema[k].dataType) for c, k in ((id_col, "id"), (url_col, "url"))]
    return pages.mapInArrow(run, StructType([*kinds, *StructType().add("text", "string").add("n_chars", "long").add("template_chars", "long").fields]))
