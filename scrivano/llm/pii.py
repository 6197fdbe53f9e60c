"""Personal data: base patterns, and disguised ones by offset-preserving deobfuscation.

Base spans come from the source text as it stands.  Then transducers rewrite the text: characters
that look like ASCII ones, other digits, full-width forms and invisible characters; spelled
digits; "at" and "dot" in words or brackets.  Each output character keeps the source range it came
from, so a span found in the rewritten text maps back to source characters.  Before each transducer
stands a cheap test that is true wherever the transducer would change anything.

"at" in a word is rewritten where a dot of the name after it is disguised too, or where what stands
before it looks like a name in an address: it holds a dot, sign or figure, or begins its line or
follows a sign or a word such as "mail", and is no common word ("look at example.com").

Kinds: email, ip, card, phone.  A span that the method adds and that overlaps a base span of its
kind is dropped; base spans stay.

Bounds of what is added, so that a pattern's time grows with the text alone: a local name in words has up to nine parts
of 64 characters, a domain whose dot stands as it is after "at" has up to nine labels, one with disguised dots up to
nine groups of nine; labels have up to 63 characters.  Longer disguises are not added.  Base spans have no such bounds.

Defined results: null text is the empty text and has no spans; repeated rows give repeated results;
texts are read whole, in time that grows with their length; an empty table gives an empty result;
columns named like the results are replaced, others stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, fresh, small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

#: Letters of other scripts that look like an ASCII character.
HOMOGLYPHS = dict(
    zip(
        "авеіјкмнорсѕтухԁһԛԝАВЕЅІЈКМНОРСТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ",
        "abeijkmhopcstyxdhqwABESIJKMHOPCTXABEZHIKMNOPTYXaivopu",
        strict=True,
    )
)
#: Dashes, dots, at and plus signs of other widths and scripts.
SIGNS = dict.fromkeys("‐‑‒–—−﹣", "-") | dict.fromkeys("․·。．｡﹒", ".") | dict.fromkeys("＠﹫", "@") | dict.fromkeys("＋﹢", "+") | dict.fromkeys("    　", " ")
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
#: Digits in words, 0 to 9, in the corpus's languages.
SPELLED = {
    w: str(k % 10)
    for group in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for k, w in enumerate(group.split())
}
ONE = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_ITEM = rf"(?:{ONE}|[0-9]|dot(?=[\s-]+(?:{ONE}|[0-9])))"
_GAP = r"(?:[\s,.-]|\((?=\w)|(?<=\w)\))+"
#: Digits in words, four at least, with figures between them; "plus" may lead, or a plus sign with figures.
SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:plus[\s,-]+)?{ONE}|\+[0-9]+)(?:{_GAP}{_ITEM}){{3,}}(?!\w)")
SPELLED_WORD = re.compile(rf"\b(?:{ONE}|plus|dot)\b|[0-9]|\+|[^\w+]+")
#: The first two items of SPELLED_RUN: without them there is none.
SPELLED_HINT = re.compile(rf"(?<!\w)(?:{ONE}|\+[0-9]+){_GAP}{_ITEM}")
AT = r"(?:at|arroba|chez|ät)"
DOT = r"(?:dot|punkt|punto|point|pkt)"
OPEN, SHUT = r"[\[({<]", r"[\])}>]"
BRACKETED = re.compile(rf"(?<!\s)\s*{OPEN}\s*(?:({AT}|@)|({DOT}|\.))\s*{SHUT}\s*", re.I)
#: A disguised dot, and the longest name of a label (fixed value of the domain name system: 63 characters).
_DOT = rf"(?:\s+{DOT}\s+|\s*{OPEN}\s*(?:{DOT}|\.)\s*{SHUT}\s*)"
_NAME = r"[A-Za-z0-9-]{1,63}"
_LOCAL = rf"(?<![\w.%+-])([A-Za-z0-9._%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,8}}?)"
_NOT_NAME = r"(?!(?:the|an?|this|that|it|le|la|les|der|die|das|el|los)\s)"
#: name at host dot domain, in words: "at" alone is a common word, so a dot is disguised as well.
IN_WORDS = re.compile(rf"{_LOCAL}\s+({AT})\s+{_NOT_NAME}({_NAME}(?:\.{_NAME}){{0,8}}(?:{_DOT}{_NAME}(?:\.{_NAME}){{0,8}}){{1,8}})(?!\w)", re.I)
HALF_WORDS = re.compile(rf"@({_NAME}(?:\.{_NAME}){{0,8}}(?:{_DOT}{_NAME}(?:\.{_NAME}){{0,8}}){{1,8}})(?!\w)", re.I)
#: name at host.domain, the dot as it is.
PLAIN_DOT = re.compile(rf"(?<![\w.%+-])([A-Za-z0-9._%+-]{{1,64}})\s+({AT})\s+(?:{_NAME}\.){{1,8}}[A-Za-z]{{2,24}}(?![\w-]|\.\w)", re.I)
#: Words before an address; words that stand before "at" in prose.
CUES = frozenset("mail email e-mail mailto write contact reach address adresse correo escribe schreib schreibe mailen to an à a me us or und and ou y o".split())
PROSE = frozenset(
    "look looks looked looking available find found here there us me you him her them live site visit online hosted published posted more info "
    "information details located based page pages read see seen shop store works working worked work employed engineer manager founder founded "
    "director ceo cto team staff student professor start starts started begin begins sign join register registered sold bought buy order check "
    "checked listed list described documented download downloads downloaded get go click support service services news archive home".split()
)
NUMBERS = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:\s+{DOT}\s+[0-9]{{1,3}}){{3}}(?![\w])", re.I)
A_DOT = re.compile(_DOT, re.I)
SPACED_SIGN = re.compile(r"(?<=[A-Za-z0-9])(?: +@ *| *@ +)(?=[A-Za-z0-9])")
#: Cheap tests on the lower-case text before the rewriting.
BRACKET_HINT = re.compile(rf"{OPEN}\s*(?:{AT}|{DOT}|@|\.)\s*{SHUT}")
DOT_HINT = re.compile(rf"{DOT}\s|{OPEN}\s*(?:{DOT}|\.)\s*{SHUT}")
AT_HINT = re.compile(rf"\s{AT}\s")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > free and LOCAL.match(text[low - 1]):
            low -= 1
        m = DOMAIN.match(text, at + 1) if low < at else None
        if m:
            free = m.end()
            out.append((low, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def base(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            d = re.sub("[ -]", "", m[0]) if 13 <= m.end() - m.start() <= 37 else ""
            if 13 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
    return out


def _glyphs() -> dict[str, str]:
    out = HOMOGLYPHS | SIGNS | dict.fromkeys(INVISIBLE, "")
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.decimal(c, None) is not None:
            out.setdefault(c, str(unicodedata.decimal(c)))
    for k in range(0xFF01, 0xFF5F):  # full-width forms of ! to ~
        out.setdefault(chr(k), chr(k - 0xFEE0))
    return out


GLYPHS = _glyphs()
ANY_GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")

LATIN_GLYPHS = [c for c in GLYPHS if ord(c) < 256]


def has_glyph(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not GLYPHS.keys().isdisjoint(set(text))
    return any(c in text for c in LATIN_GLYPHS)


class Tape:
    """A text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.low = text, np.arange(len(text), dtype=np.int64)
        self.high = self.low + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put a string in place of each range; ranges are in order and don't overlap."""
        parts, low, high, at = [], [], [], 0
        for a, b, put in edits:
            parts += [self.text[at:a], put]
            low.append(self.low[at:a])
            high.append(self.high[at:a])
            if b > a and put:
                low.append(np.full(len(put), self.low[a]))
                high.append(np.full(len(put), self.high[b - 1]))
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.low = np.concatenate([*low, self.low[at:]])
        self.high = np.concatenate([*high, self.high[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.low[a]), int(self.high[b - 1])


def _glyph_edits(text: str):
    return [(m.start(), m.end(), GLYPHS[m[0]]) for m in ANY_GLYPH.finditer(text)]


def _lower(text: str) -> str:
    """Lower case, character by character."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _spelled_edits(text: str):
    out, lower = [], _lower(text)
    for run in SPELLED_RUN.finditer(lower):
        if not any(c.isalpha() for c in run[0]):
            continue  # figures alone are no disguise
        for m in SPELLED_WORD.finditer(lower, *run.span()):
            w = m[0]
            put = SPELLED.get(w) or ("+" if w in ("plus", "+") else "." if w == "dot" else w if w.isdigit() else "")
            if put != w:
                out.append((*m.span(), put))
    return out


def _bracket_edits(text: str):
    return [(*m.span(), "@" if m[1] else ".") for m in BRACKETED.finditer(text)]


def _around(text: str, a: int, b: int) -> tuple[int, int]:
    """The range with the blanks on both sides."""
    while text[a - 1].isspace():
        a -= 1
    while text[b].isspace():
        b += 1
    return a, b


def _word_edits(text: str):
    out = []
    for m in IN_WORDS.finditer(text):
        dots = [(*d.span(), ".") for k in (1, 3) for d in A_DOT.finditer(text, *m.span(k))]
        out += sorted([*dots, (*_around(text, *m.span(2)), "@")])
    return out


def _names_someone(text: str, m: re.Match) -> bool:
    """Whether what stands before "at" looks like the name in an address."""
    local, low = m[1], m.start(1)
    if local.lower() in PROSE:
        return False
    if not local.isalpha():
        return any(c.isalpha() for c in local)
    line = text[max(0, low - 40) : low].rpartition("\n")[2].rstrip(" \t")
    last = re.search(r"[\w-]+$", line)
    return not line or line[-1] in ":;,(<[|=\"'" or last is not None and last[0].lower() in CUES


def _plain_dot_edits(text: str):
    return [(*_around(text, *m.span(2)), "@") for m in PLAIN_DOT.finditer(text) if _names_someone(text, m)]


def _half_edits(text: str):
    return [(*d.span(), ".") for m in HALF_WORDS.finditer(text) for d in A_DOT.finditer(text, *m.span(1))]


def _number_edits(text: str):
    return [(*d.span(), ".") for m in NUMBERS.finditer(text) for d in A_DOT.finditer(text, *m.span())]


def _sign_edits(text: str):
    """Blanks around an at sign that a name with a dot in it follows."""
    found = (m for m in SPACED_SIGN.finditer(text) if DOMAIN.match(text, m.end()))
    return [(*m.span(), "@") for m in found]


def disguised(text: str, always: bool = False) -> Tape | None:
    """The rewritten text, or None if there is nothing to rewrite.  always: leave out the cheap tests."""
    tape, now = None, text

    def apply(edits) -> None:
        nonlocal tape, now
        if edits:
            tape = tape or Tape(text)
            tape.rewrite(edits)
            now = tape.text

    if always or has_glyph(text):
        apply(_glyph_edits(now))
    lower = _lower(now)
    if always or SPELLED_HINT.search(lower):
        apply(_spelled_edits(now))
    dots = always or DOT_HINT.search(lower)
    if dots:
        apply(_word_edits(now))
    if always or BRACKET_HINT.search(lower):
        apply(_bracket_edits(now))
    if dots:
        apply(_half_edits(now))
        apply(_number_edits(now))
    if always or AT_HINT.search(lower):
        apply(_plain_dot_edits(now))
    if always or " @" in now or "@ " in now:
        apply(_sign_edits(now))
    return tape if now != text else None


#: Spelled phone numbers without a plus sign: digits that came from words.
BARE_PHONE = re.compile(r"(?<![0-9])[0-9]{9,15}(?![0-9])")


def apart(new: list[tuple[int, int]], *others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the spans new, in order, those that overlap none of the others nor one kept before; all lists are in order."""
    out, at, end = [], [0] * len(others), -1
    for a, b in new:
        free = a >= end
        for k, spans in enumerate(others):
            while at[k] < len(spans) and spans[at[k]][1] <= a:
                at[k] += 1
            free = free and (at[k] == len(spans) or spans[at[k]][0] >= b)
        if free:
            out.append((a, b))
            end = b
    return out


def spans(text: str, always: bool = False) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and all spans, by kind, each in order."""
    found = base(text)
    tape = disguised(text, always)
    if tape is None:
        return found, found
    more = {k: [tape.source(*s) for s in v] for k, v in base(tape.text).items()}
    bare = [tape.source(*m.span()) for m in BARE_PHONE.finditer(tape.text)]
    spelled = [(a, b) for a, b in bare if any(c.isalpha() for c in text[a:b])]
    more["phone"] = sorted(more["phone"] + apart(spelled, more["card"], more["phone"], more["ip"]))
    return found, {k: sorted(found[k] + apart(more[k], found[k])) for k in KINDS}


def joined(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def redacted(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with [KIND] in place of each span; of overlapping ones, the first and longest."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k in KINDS for a, b in found[k]), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def _mapped(df: DataFrame, text_col: str, row, out, keep_text: bool) -> DataFrame:
    small_batches(df.sparkSession)
    made = [o[0] for o in out]
    low = {m.lower() for m in made}
    names = [c for c in df.columns if c.lower() not in low and (keep_text or c != text_col)]
    sent = df.select(*map(column, names), F.coalesce(column(text_col).cast("string"), F.lit("")).alias(fresh(names, "read")))

    def run(batches):
        for b in batches:
            rows = [row(t) for t in b.column(len(names)).to_pylist()]
            cols = [pa.array([r[k] for r in rows], o[1]) for k, o in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *cols], names=[*names, *made])

    return sent.mapInArrow(run, StructType([*sent.schema.fields[:-1], *(f for o in out for f in StructType().add(o[0], o[2]).fields)]))


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without text_col, with counts of base spans, base_sha256 and spans."""

    def row(text: str) -> list:
        found, every = spans(text)
        return [*(len(found[k]) for k in KINDS), hashlib.sha256(joined(found).encode()).hexdigest(), joined(every)]

    out = [*((f"n_{k}", pa.int64(), "long") for k in KINDS), ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string")]
    return _mapped(df, text_col, row, out, keep_text=False)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with personal data in text_col replaced; null stays null."""
    clean = fresh(df.columns, "clean")
    made = _mapped(df, text_col, lambda t: [redacted(t, spans(t)[1])], [(clean, pa.string(), "string")], keep_text=True)
    new = F.when(column(text_col).isNotNull(), F.col(clean))
    return made.select(*(new.alias(c) if c == text_col else column(c) for c in df.columns))
