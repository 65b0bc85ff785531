"""Incremental co-change pairs: commits arrive as a stream, pairs are never recomputed.

Decay is separable: sum exp(-k (T - t)) = exp(-k (T - t0)) * sum exp(k (t - t0)). Each
micro-batch adds one partition with count, sum exp(k (t - t0)) and last time of the
pairs of its own commits; writing a batch again overwrites its partition, so a
replayed batch counts once. Reading adds the partitions up and scales to a date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators.history import DECAY, age_days


def batch_pairs(commits: DataFrame, changes: DataFrame, tree: DataFrame, anchor: str, most: int, decay: float = DECAY) -> DataFrame:
    """src, dst, raw, grown, last of the commits of one batch; only their changes are read for pairs."""
    mine = changes.join(commits, "sha")
    small = mine.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("sha")
    rows = mine.join(small, "sha", "left_semi").join(tree.select("file"), "file", "left_semi")
    days = F.unix_timestamp(F.col("a.ts").cast("timestamp")) - F.unix_timestamp(F.lit(anchor).cast("timestamp"))
    a, b = rows.alias("a"), rows.select("sha", "file").alias("b")
    met = a.join(b, (F.col("a.sha") == F.col("b.sha")) & (F.col("a.file") < F.col("b.file")))
    return met.groupBy(F.col("a.file").alias("src"), F.col("b.file").alias("dst")).agg(F.count(F.lit(1)).alias("raw"), F.sum(F.exp(F.lit(decay) * days / F.lit(86400.0))).alias("grown"), F.max("a.ts").alias("last"))


def maintain(stream: DataFrame, changes: DataFrame, tree: DataFrame, state: str, checkpoint: str, anchor: str, most: int) -> None:
    """Run the stream of (sha, ts) until what is there has been worked in."""

    def add(batch: DataFrame, number: int) -> None:
        batch_pairs(batch, changes, tree, anchor, most).write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, state: str, anchor: str, at: str, decay: float = DECAY) -> DataFrame:
    """src, dst, raw, decayed, last as of ``at``, for stamps not after it."""
    scale = F.exp(-F.lit(decay) * age_days(F.lit(anchor), at))
    rows = spark.read.parquet(state)
    return rows.groupBy("src", "dst").agg(F.sum("raw").alias("raw"), (F.sum("grown") * scale).alias("decayed"), F.max("last").alias("last"))


def compact(spark: SparkSession, state: str, into: str) -> DataFrame:
    """One partition instead of many; exact, since counts, grown sums and maxima add up."""
    spark.read.parquet(state).groupBy("src", "dst").agg(F.sum("raw").alias("raw"), F.sum("grown").alias("grown"), F.max("last").alias("last")).write.mode("overwrite").parquet(f"{into}/batch=-1")
    return spark.read.parquet(into)
