"""Token counts by separator scan of flat, unindexed token files.

A token file is little-endian ids, document after document, each closed by an end
id; it has no index. Files come as blocks of any size (in whole ids). Each block is
searched for end ids at once; what lies between two of them in a block is a whole
document. Documents that run over block edges are stitched by a prefix scan over
each file's blocks: how many end ids came before, and how many ids are still open.

Defined results: a file without ids gives no row; two end ids in a row enclose a
document of 0 ids; ids after the last end id are a row with ``closed`` false; null
blocks count as empty; block rows that repeat count twice, so they must not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from graphloom.llm.memos import claim
from graphloom.llm.packing import encoder_for
from graphloom.llm.sampling import give_back_memory
from graphloom.llm.shared import documents, materialise
from graphloom.llm.word_bpe import WordBpe

#: End id of the public word-end tokenizer (a special token, which no text has where names of special tokens are plain text), bytes of an id, ids of a block.
END_ID, ID_BYTES, BLOCK_IDS = 49_407, 2, 1 << 18
#: Units that a worker remembers: fewer than for packing, since the same task also writes Parquet.
UNITS = 300_000


def flat_blocks(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, id_bytes: int = ID_BYTES) -> DataFrame:
    """file, block, ids of the flat files at ``path``."""
    size = block_ids * id_bytes
    content = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    cut = content.filter("length > 0").select("file", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
    return cut.select("file", "block", F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("ids"))


def scan(blocks: DataFrame, end_id: int = END_ID, id_bytes: int = ID_BYTES) -> DataFrame:
    """file, block, n_ids, inner (lengths up to each end id), tail (ids after the last) of each block."""
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def run(batches):
        for batch in batches:
            inner, tails, sizes = [], [], []
            for value in batch.column(2):
                ids = np.frombuffer(value.as_py() or b"", kind)
                ends = np.flatnonzero(ids == end_id)
                inner.append(np.diff(ends, prepend=-1) - 1)
                tails.append(len(ids) - (int(ends[-1]) + 1 if len(ends) else 0))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(tails, pa.int64())], names=["file", "block", "n_ids", "inner", "tail"])

    file = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", F.col("block").cast("long").alias("block"), "ids").mapInArrow(run, f"file {file}, block long, n_ids long, inner array<long>, tail long")


def token_counts(blocks: DataFrame, end_id: int = END_ID, id_bytes: int = ID_BYTES) -> DataFrame:
    """file, ordinal, n_tokens, closed of every document, in file order; end ids aren't counted."""
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    zero: Column = F.lit(0).cast("long")
    summed = scan(blocks, end_id, id_bytes).withColumn("ends_before", F.coalesce(F.sum(F.size("inner")).over(before), zero)).withColumn("tails_before", F.coalesce(F.sum("tail").over(before), zero))
    # the open ids before a block are the tails since the last block that had an end id
    since = F.last(F.when(F.size("inner") > 0, F.col("tails_before")), ignorenulls=True).over(before)
    stitched = summed.withColumn("open", F.col("tails_before") - F.coalesce(since, zero)).withColumn("last", F.row_number().over(W.partitionBy("file").orderBy(F.desc("block"))) == 1)
    whole = stitched.select("file", "ends_before", "open", F.posexplode("inner").alias("at", "n")).select("file", (F.col("ends_before") + F.col("at")).alias("ordinal"), (F.col("n") + F.when(F.col("at") == 0, F.col("open")).otherwise(zero)).alias("n_tokens"), F.lit(True).alias("closed"))
    left = F.col("tail") + F.when(F.size("inner") == 0, F.col("open")).otherwise(zero)
    rest = stitched.filter("last").select("file", (F.col("ends_before") + F.size("inner")).alias("ordinal"), left.alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return whole.unionAll(rest)


def write_blocks(df: DataFrame, encoder: Callable[[], WordBpe], key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token files of a table's texts: one a partition, its blocks as rows (file, block, ids), and a row of the keys in order.

    The blocks know nothing of documents; the keys say whose the n-th document of a file is.
    """

    def run(batches):
        bpe, file = encoder(), TaskContext.get().partitionId()
        claim("word_bpe", bpe.forget)
        end, size = np.array([END_ID], "<u2").tobytes(), block_ids * ID_BYTES
        held, block, keys, first = bytearray(), 0, [], 0

        def rows(number, data, of):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([of], pa.list_(pa.int64()))], names=["file", "block", "ids", "keys"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for ids in bpe.encode(part.column(1).to_pylist()):
                    held += np.frombuffer(ids, "<u4").astype("<u2").tobytes() + end
                keys += part.column(0).to_pylist()
                while len(held) >= size:
                    yield rows(block, bytes(held[:size]), None)
                    del held[:size]
                    block += 1
                if len(keys) >= 4096:
                    yield rows(first, None, keys)
                    first, keys = first + len(keys), []
        if held:
            yield rows(block, bytes(held), None)
        if keys:
            yield rows(first, None, keys)
        held.clear()
        give_back_memory()

    return df.select(F.col(key).cast("long").alias("key"), text).mapInArrow(run, "file long, block long, ids binary, keys array<long>")


def count_texts(df: DataFrame, encoder: Callable[[], WordBpe] | None = None, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """``key``, n_tokens, file, ordinal of every row: written as token files, counted by scanning them."""
    stored = materialise(write_blocks(df, encoder or encoder_for(units=UNITS, special=False), key, text, block_ids), "tokens")
    counts = token_counts(stored.filter("ids is not null").select("file", "block", "ids"))
    names = stored.filter("keys is not null").select("file", F.col("block").alias("first"), F.posexplode("keys").alias("at", key)).select("file", (F.col("first") + F.col("at")).alias("ordinal"), key)
    return counts.join(names, ["file", "ordinal"]).select(key, "n_tokens", "file", "ordinal")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_texts(documents(spark, sf_dir))
