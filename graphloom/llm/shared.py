"""Session helpers: shared temporary tables, batch sizes, null-safe inputs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes per Arrow batch handed to Python; keeps a batch of long texts small.
ARROW_ROWS, ARROW_BYTES = 512, "32m"

#: Whether the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a local one only where that is unset (tests), and never on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/graphloom-checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
    return path


def _drop_all() -> None:
    for spark, path in _written:
        drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at interpreter exit; the folder is temporary
        pass


atexit.register(_drop_all)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    What its shuffles left on the executors' disks goes as soon as it is written, not whenever the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shard_count(docs: DataFrame, text: str, most_docs: int, most_bytes: int) -> int:
    """Shards for a table, so that one has no more documents and bytes of text than these on average."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return max(1, -(-n // most_docs), -(-(size or 0) // most_bytes))


def shard_of(key: str, text: str, shards: int) -> Column:
    """A document's shard: by its id, or by its text where it has none."""
    return F.pmod(F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(text)), F.lit(shards)).cast("int")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def fold(doc_id, parts: int):
    """crc32 of the decimal text of an id, modulo ``parts``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))
