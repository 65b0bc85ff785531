"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the score interval of k of n; (0, 0) without trials."""
    k, n = k.cast("double"), n.cast("double")
    m = F.when(n == 0, 1.0).otherwise(n)
    p, d = k / m, 1 + z * z / m
    centre, half = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    return F.when(n == 0, 0.0).otherwise(centre - half), F.when(n == 0, 0.0).otherwise(centre + half)


def mcnemar(a: Column, b: Column) -> Column:
    """Exact two-sided p of a against b discordant pairs: binomial tail in logarithms, 1 without any."""
    n, m = (a + b).cast("long"), F.least(a, b).cast("long")
    step = lambda s, j: F.struct((s["term"] + F.ln((n - j + 1).cast("double")) - F.ln(j.cast("double"))).alias("term"), (s["total"] + F.exp(s["term"] + F.ln((n - j + 1).cast("double")) - F.ln(j.cast("double")))).alias("total"))
    first = F.struct((-n * F.ln(F.lit(2.0))).alias("term"), F.exp(-n * F.ln(F.lit(2.0))).alias("total"))
    places = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<long>"))
    tail = F.aggregate(places, first, step, lambda s: s["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def upper_median(values: Column) -> Column:
    """The element at place floor(n / 2) of the sorted array, from 0."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def index_quantile(values: Column, q: float) -> Column:
    """The element at place floor(q * n) of the sorted array, from 0; not interpolated."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) * q) + 1).cast("int"))


def split_of(key: Column) -> Column:
    """dev or holdout by the parity of a key's hash."""
    return F.when(F.conv(F.right(F.sha1(key), F.lit(1)), 16, 10).cast("int") % 2 == 0, "dev").otherwise("holdout")
