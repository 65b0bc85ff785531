"""An index of one revision: what localize and impact need, as tables that can be stored and loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.text import term_counts
from graphloom.operators import history
from graphloom.sources import logs

TABLES = ("files", "pairs", "priors", "static", "terms")
#: Most files of a commit that counts.
BULK = 30


def build_index(commits: DataFrame, changes: DataFrame, parents: DataFrame, tree: DataFrame, blobs: DataFrame, static: DataFrame, base: str, head: DataFrame | None = None, bulk: int = BULK) -> dict[str, DataFrame]:
    """The tables of an index: files of the tree, co-change pairs, priors, static edges, term counts.

    ``tree`` has file, path, blob; ``blobs`` has blob, content; ``head`` (sha) is the
    revision: its history is what it reaches. Without one every commit up to ``base`` counts.
    """
    if head is not None:
        commits = history.reachable(commits, parents, head)
    live = history.alive_changes(changes, commits, tree, base, bulk, dated_only=head is not None)
    texts = logs.file_texts(tree, logs.blob_texts(tree, blobs))
    return {"files": tree, "pairs": history.cochange_pairs(live), "priors": history.priors(live), "static": static, "terms": term_counts(texts, "file")}


def overview(index: dict[str, DataFrame], top: int = 40) -> DataFrame:
    """file, path, total, degree of the files with most co-change: what an index is shown by."""
    total = history.involvement(index["pairs"])
    edges = history.symmetric(index["static"]).groupBy(F.col("src").alias("file")).agg(F.countDistinct("dst").alias("degree"))
    shown = index["files"].join(total, "file").join(edges, "file", "left").select("file", "path", "total", F.coalesce("degree", F.lit(0)).alias("degree"))
    return shown.orderBy(F.desc("total"), "path").limit(top)
