"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.plans.registry import query
from graphloom.session import shared_folder
from graphloom.sources.tables import BASE, BULK, Model
from graphloom.streaming import pairs as stream_pairs

ANCHOR = "1995-01-01 00:00:00"


@query("stream_pairs", "select src, dst, raw, round(decayed, 6) as decayed, epoch(last)::bigint as last from pairs")
def streamed(m: Model):
    spark = m.spark
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = m.table("orders")
    reader = spark.readStream.schema(table.schema)
    # a stream reads folders: a table of one file is picked out of its folder by name
    single = table.inputFiles()[0].endswith("/orders.parquet")
    orders = reader.option("pathGlobFilter", "orders.parquet").parquet(m.sf_dir) if single else reader.parquet(f"{m.sf_dir}/orders.parquet")
    commits = orders.select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).filter(F.col("ts") <= F.lit(BASE).cast("timestamp_ntz"))
    stream_pairs.maintain(commits, m.changes, m.tree, f"{root}/state", f"{root}/log", ANCHOR, BULK)
    return stream_pairs.current(spark, f"{root}/state", ANCHOR, BASE).withColumn("decayed", F.round("decayed", 6))
