"""Groups by exact Jaccard similarity over all pairs."""

from fractions import Fraction


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """Smallest ids of the groups."""
    sets = {d: grams(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both, n = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and (not n or Fraction(both, n) >= Fraction(4, 5)):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d for d in sets if root(d) == d}
