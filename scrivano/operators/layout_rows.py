"""What layout and calibration find of documents whose words fit a row: the same rules on columns of one document's words.

No word becomes a row, so nothing but findings leaves a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from . import alignment, calibration
from .layout import POSITION, SIZE


class Words(NamedTuple):
    """One side's words in order; font and color are places in fonts and colors; marked words are not compared."""

    text: list[str | None]
    marked: np.ndarray
    page: np.ndarray
    x0: np.ndarray
    top: np.ndarray
    size: np.ndarray
    font: np.ndarray
    color: np.ndarray
    fonts: tuple[str | None, ...]
    colors: tuple[str | None, ...]


class Pairs(NamedTuple):
    """Both sides of aligned words: their places, and of either side the fields that tell where they stand."""

    a: np.ndarray
    b: np.ndarray
    unmatched: int
    first: int | None  # the first edited word of the first side


def aligned(a: Words, b: Words) -> Pairs:
    """Words that are not marked, as layout.aligned() pairs them."""
    plain = [np.flatnonzero(~w.marked) for w in (a, b)]
    texts = [w.text if len(p) == len(w.text) else [w.text[i] for i in p.tolist()] for w, p in zip((a, b), plain)]
    i, j = np.array(alignment.anchored(*texts), np.int64).reshape(-1, 2).T
    edited = np.flatnonzero(a.marked)
    return Pairs(plain[0][i], plain[1][j], sum(map(len, plain)) - 2 * len(i), int(edited[0]) if len(edited) else None)


def _lines(page: np.ndarray, top: np.ndarray) -> np.ndarray:
    """A number for each word's line: its page and its top in tenths, halves to the even one."""
    return page.astype(np.int64) << 32 | np.rint(top * 10).astype(np.int64) & 0xFFFFFFFF


def _stay(a: Words, b: Words, p: Pairs, position: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, which are on one page, and which of these in one place."""
    page = a.page[p.a] == b.page[p.b]
    return page, page & (np.abs(a.x0[p.a] - b.x0[p.b]) <= position) & (np.abs(a.top[p.a] - b.top[p.b]) <= position)


def _apart(a: Words, b: Words, p: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, the number of their line, and how far they moved from the line's first pair; another page is infinitely far."""
    _, lead, line = np.unique(_lines(a.page[p.a], a.top[p.a]), return_index=True, return_inverse=True)
    lead = lead[line]
    xa, xb, top = a.x0[p.a], b.x0[p.b], b.top[p.b]
    shift = np.maximum(np.abs((xb - xb[lead]) - (xa - xa[lead])), np.abs(top - top[lead]))
    page = b.page[p.b]
    return line, np.where(page != page[lead], np.inf, shift)


def _other(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where values named by their places in a and b differ."""
    both = {v: k for k, v in enumerate(dict.fromkeys((*a, *b)))}
    return np.array([both[v] for v in a])[i] != np.array([both[v] for v in b])[j]


def _plain(fonts: tuple) -> tuple:
    return tuple(re.sub(r"^[^+]*\+", "", f or "") for f in fonts)


def word_findings(a: Words, b: Words, position: float = POSITION, size: float = SIZE) -> Iterator[tuple[str, str, int]]:
    """code, severity, n as of layout.word_findings() and layout.edited_lines()."""
    p = aligned(a, b)
    page, stable = _stay(a, b, p, position)
    line, apart = _apart(a, b, p)
    moved, pages = int((~stable).sum()), int((~page).sum())
    early = moved if p.first is None else int((~stable & (p.a < p.first)).sum())
    fonts = _other(_plain(a.fonts), _plain(b.fonts), a.font[p.a], b.font[p.b]) | (np.abs(a.size[p.a] - b.size[p.b]) > size)
    found = (
        ("context_text_render_mismatch", "warning", p.unmatched), ("font_changed", "warning", int(fonts.sum())), ("text_color_changed", "warning", int(_other(a.colors, b.colors, a.color[p.a], b.color[p.b]).sum())),
        ("shift_before_edit", "warning", early), ("page_flow_changed", "warning", pages), ("vertical_reflow", "info", 0 if pages or early else moved),
        ("line_wrap_changed", "warning", len(np.unique(line[apart > position]))),
    )
    yield from (f for f in found if f[2])
    before, after = (len(np.unique(_lines(w.page[w.marked], w.top[w.marked]))) for w in (a, b))
    if before != after:
        yield "edited_text_line_count_changed", "info", after


def reflow_tops(a: Words, b: Words, position: float = POSITION) -> Iterator[tuple[int, float]]:
    """page, top as of layout.reflow_tops()."""
    p = aligned(a, b)
    off = ~_stay(a, b, p, position)[1]
    pages, tops = (np.concatenate([f[0][p.a[off]], f[1][p.b[off]]]) for f in ((a.page, b.page), (a.top, b.top)))
    names, at = np.unique(pages, return_inverse=True)
    least = np.full(len(names), np.inf)
    np.minimum.at(least, at, tops)
    yield from zip(names.tolist(), least.tolist())


def deviations(a: Words, b: Words) -> Iterator[tuple[float | None, float]]:
    """early, wrapped as of calibration.deviations(); nothing without a pair."""
    p = aligned(a, b)
    if len(p.a):
        moved = np.maximum(np.abs(b.x0[p.b] - a.x0[p.a]), np.abs(b.top[p.b] - a.top[p.a]))
        moved = np.where(a.page[p.a] != b.page[p.b], np.inf, moved)
        before = moved if p.first is None else moved[p.a < p.first]
        yield round(float(before.max()), calibration.DIGITS) if len(before) else None, round(float(_apart(a, b, p)[1].max()), calibration.DIGITS)
