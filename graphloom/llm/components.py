"""Connected components of an edge table by alternating stars, one shared table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.llm.shared import drop_table, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``node, component`` of every node that has an edge to another; the component is its smallest node.

    Each round ties every node's larger neighbours to its smallest neighbour, then
    its smaller ones; edges stay at most as many as given, and the stars that remain
    are the components. Nodes must be integers; null ends and loops are ignored.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") < F.col("hi"))).distinct()
    e, before = materialise(e, "edges"), None
    for _ in range(rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").filter("m < lo").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        following = materialise(small.unionAll(down.select(F.col("m").alias("lo"), "hi")).distinct(), "edges")
        # the same edges have the same count and the same two hashes of 64 bits
        now = following.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi")), F.bit_xor(F.xxhash64("hi", "lo", F.lit(1)))).first()
        drop_table(e.sparkSession, e.inputFiles()[0].rsplit("/", 1)[0]) if e.inputFiles() else None
        e = following
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
