"""A longest common subsequence of two sequences, exactly: rows of the length table as bits of whole numbers."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: Bits of the table that are kept at once; beyond them the longer side is halved.
TABLE_BITS = 1 << 26


def _masks(y: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each element the places where y has it, as bits."""
    places: dict[Hashable, list[int]] = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(j)
    out = {}
    for v, at in places.items():
        bits = np.zeros(len(y), np.uint8)
        bits[at] = 1
        out[v] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _rows(x: Sequence[Hashable], y: Sequence[Hashable]):
    """After each element of x, the places of y at which the common length does not grow, as bits."""
    masks, full = _masks(y), (1 << len(y)) - 1
    row = full
    for v in x:
        if hit := masks.get(v, 0) & row:
            row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(x: Sequence[Hashable], y: Sequence[Hashable]) -> np.ndarray:
    """Common length of x with y[:j], for j from 0 to len(y)."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def matched(x: Sequence[Hashable], y: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, rising in both.  Elements that one side lacks are left out first."""
    i, j = shared(x, y)
    x, y = [x[k] for k in i], [y[k] for k in j]
    return list(zip(i, j)) if x == y else [(i[a], j[b]) for a, b in _matched(x, y)]


def shared(x: Sequence[Hashable], y: Sequence[Hashable]) -> tuple[list[int], list[int]]:
    """Places of the elements that the other side has too."""
    of_x, of_y = set(x), set(y)
    return [i for i, v in enumerate(x) if v in of_y], [j for j, v in enumerate(y) if v in of_x]


def _matched(x: list, y: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    work = [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= TABLE_BITS:
            rows = [-1, *_rows(x[a:b], y[c:d])]
            i, j = b - a, d - c
            while i and j:
                if rows[i] >> (j - 1) & 1:  # y's last element adds nothing
                    j -= 1
                elif not rows[i - 1] >> (j - 1) & 1:  # nor does x's
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
        elif b - a == 1:
            out += [(a, c + list(y[c:d]).index(x[a]))] if x[a] in y[c:d] else []
        else:
            mid = (a + b) // 2
            ahead, back = _lengths(x[a:mid], y[c:d]), _lengths(x[mid:b][::-1], y[c:d][::-1])[::-1]
            cut = c + int(np.argmax(ahead + back))
            work += [(a, mid, c, cut), (mid, b, cut, d)]
    return sorted(out)


def rising(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly rising subsequence."""
    import bisect

    tops: list[int] = []  # the least last value of a rising run of each length
    at: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        n = bisect.bisect_left(tops, v)
        tops[n : n + 1] = [v]
        at[n : n + 1] = [k]
        before.append(at[n - 1] if n else -1)
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]
