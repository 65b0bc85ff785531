"""Checks of what a caller gives before any plan is made."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Shortest issue, least and most depth, characters of a revision besides letters and digits.
SHORTEST, LEAST_DEPTH, MOST_DEPTH, REVISION_SIGNS = 12, 10, 100, "^~-_/."


def clamped(depth: int | None, usual: int = 50) -> int:
    return max(LEAST_DEPTH, min(MOST_DEPTH, int(depth or usual)))


def checked_issue(text: str | None) -> str:
    if len(text := (text or "").strip()) < SHORTEST:
        raise ValueError("the issue is too short")
    return text


def checked_revision(rev: str | None) -> str:
    rev = (rev or "HEAD").strip()
    if not re.sub(f"[{re.escape(REVISION_SIGNS)}]", "", rev).isalnum():
        raise ValueError("not a revision")
    return rev


def long_enough(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= SHORTEST


def clamped_column(depth: Column, usual: int = 50) -> Column:
    """A null or zero depth is the usual one."""
    return F.greatest(F.lit(LEAST_DEPTH), F.least(F.lit(MOST_DEPTH), F.coalesce(F.nullif(depth, F.lit(0)), F.lit(usual))))
