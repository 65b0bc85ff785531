"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def give_back_memory() -> None:
    """Return what a fit has freed to the system: the driver goes on to other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps the memory for itself
        pass


def bounded_rows(rows: DataFrame, bound: int, *order: Column) -> DataFrame:
    """At most ``bound`` rows, chosen by hash: a threshold first, so no task sends more than its share.

    The rows must be few columns wide; which rows are chosen depends on their values alone.
    """
    total = rows.count()
    if total > bound:
        share = bound / total * 1.05
        rows = rows.filter(F.xxhash64(*order, F.lit(7)) < F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1))
    return rows.orderBy(F.xxhash64(*order, F.lit(7)), *order).limit(bound)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled documents for which ``keep`` (on doc_id) holds.

    The chosen ids (bounded, so safe to broadcast) meet the documents without moving any text.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return documents.select("doc_id", "text").join(F.broadcast(bounded_rows(chosen, bound, F.col("doc_id"))), "doc_id")
