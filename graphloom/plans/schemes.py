"""Multi-call re-ranking schemes as array compositions around a pluggable scorer.

A scorer takes an array of candidates and how many to return, and gives an array of
the best of them in order. It can be a column of parsed replies or any function of
arrays; the schemes only cut, join and fill lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Scorer = Callable[[Column, int], Column]


def _joined(*lists: Column) -> Column:
    return F.array_distinct(F.concat(*lists))


def base(score: Scorer, c: Column, depth: int = 50) -> Column:
    head = F.slice(c, 1, depth)
    return _joined(score(head, 10), head)


def cascade(score: Scorer, c: Column, depth: int = 100, size: int = 25, each: int = 8) -> Column:
    """The best of every chunk meet in a play-off."""
    head = F.slice(c, 1, depth)
    finalists = _joined(*(score(F.slice(head, i + 1, size), each) for i in range(0, depth, size)))
    return _joined(score(finalists, 10), finalists, head)


def window(score: Scorer, c: Column) -> Column:
    """From the tail to the head, the best ten carried along."""
    carry = None
    for start, length in ((51, 50), (21, 30), (1, 20)):
        segment = F.slice(c, start, length)
        carry = score(segment if carry is None else _joined(segment, carry), 10)
    return _joined(carry, F.slice(c, 1, 100))


def refine(score: Scorer, c: Column) -> Column:
    """The first ten once more, with those ranked 51 to 90."""
    first = score(F.slice(c, 1, 50), 10)
    second = score(_joined(first, F.slice(c, 51, 40)), 10)
    return _joined(second, first, F.slice(c, 1, 100))


def two_pass(score: Scorer, c: Column) -> Column:
    """Both halves, then the best of each."""
    a, b = score(F.slice(c, 1, 50), 10), score(F.slice(c, 51, 50), 10)
    return _joined(score(_joined(a, b), 10), a, F.slice(c, 1, 100))


def anchor(score: Scorer, c: Column, companions: Scorer | None = None) -> Column:
    """The best file, up to six companions of it, then the rest of the first answer."""
    head = F.slice(c, 1, 50)
    first = score(head, 10)
    best = F.slice(_joined(first, head), 1, 1)
    more = (companions or score)(F.array_except(head, best), 6)
    return _joined(best, more, first, c)


SCHEMES = {"base50": base, "base100": lambda s, c: base(s, c, 100), "cascade": cascade, "window": window, "refine2": refine, "twopass": two_pass, "anchor": anchor}
