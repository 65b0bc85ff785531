"""Sources and sinks: history logs, line-delimited JSON, resumable output, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from graphloom.functions.stats import split_of
from graphloom.functions.text import clean_rename

# Extensions of text files in a tree, format of a snapshot.
TEXT_EXTENSIONS = ("py", "rst", "md", "txt", "cfg", "ini", "toml", "yml", "yaml")
SNAPSHOT_VERSION = 1
#: Lines of a log that are filled together; one row for each so many lines meets in one task.
RUN_LINES = 100_000
#: Bytes of a blob that are read for terms, and for snippets.
BLOB_BYTES, SNIPPET_BYTES = 300_000, 60_000


def history_log(lines: DataFrame, most: int = 30, suffix: str = ".py") -> tuple[DataFrame, DataFrame]:
    """commits(sha, ts) and changes(sha, file) from a numbered log (``n``, ``value``).

    A line that starts with \\x01 heads a commit: sha and unix time after it. The others
    are added, removed and path by tabs. Each line takes the last header before it.
    """
    header = F.when(F.col("value").startswith("\x01"), F.col("value"))
    # within a run of lines first; what a run leaves open is the last header of an earlier run, and runs are few
    runs = lines.withColumn("run", F.floor(F.col("n") / RUN_LINES)).withColumn("own", F.last(header, ignorenulls=True).over(W.partitionBy("run").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    lasts = lines.withColumn("run", F.floor(F.col("n") / RUN_LINES)).groupBy("run").agg(F.max_by(header, F.when(header.isNotNull(), F.col("n"))).alias("latest"))
    before = lasts.select("run", F.last("latest", ignorenulls=True).over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    filled = runs.join(before, "run").withColumn("head", F.coalesce("own", "before"))
    parts = F.split(F.substring("head", 2, 1000), "\t")
    rows = filled.filter(~F.col("value").startswith("\x01") & (F.col("value") != "")).select(parts[0].alias("sha"), parts[1].cast("long").alias("ts"), clean_rename(F.split("value", "\t")[2]).alias("file"))
    kept = rows.filter(F.col("file").endswith(suffix)).distinct()
    small = kept.groupBy("sha", "ts").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("sha", "ts")
    return small, kept.select("sha", "file").join(small.select("sha"), "sha", "left_semi")


def blob_texts(tree: DataFrame, blobs: DataFrame, most: int = BLOB_BYTES) -> DataFrame:
    """blob, text of each blob that the tree has, once however many paths it has: its first bytes, with what is no UTF-8 replaced."""
    wanted = tree.select("blob").filter("blob is not null").distinct()
    held = blobs.groupBy("blob").agg(F.any_value("content").alias("content"))
    return held.join(wanted, "blob", "left_semi").select("blob", F.make_valid_utf8(F.substring("content", 1, most).cast("string")).alias("text"))


def file_texts(tree: DataFrame, texts: DataFrame) -> DataFrame:
    """file, blob, text of every path with a text extension: many paths may have one blob."""
    return tree.filter(has_text_extension(F.col("path"))).join(texts, "blob").select("file", "blob", "text")


def has_text_extension(path: Column) -> Column:
    """By what follows the last dot of the whole path."""
    return F.regexp_extract(path, r"\.([^.]+)$", 1).isin(*TEXT_EXTENSIONS)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of line-delimited JSON; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def instances(rows: DataFrame, gold: DataFrame, split: str | None = None) -> DataFrame:
    """Instances that have gold, with it as a sorted array; of one split (dev or holdout, by the id's hash) where it is named."""
    out = rows.join(gold.groupBy("qid").agg(F.sort_array(F.collect_set("file")).alias("gold")), "qid")
    return out.filter(split_of(F.col("qid").cast("string")) == split) if split else out


def append_unfinished(rows: DataFrame, out: str, key: str) -> int:
    """Append rows whose key the output doesn't have yet; returns how many."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(out).select(key).distinct()
        rows = rows.join(done, key, "left_anti")
    except Exception as e:  # no output yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows = rows.checkpoint() if spark.sparkContext.getCheckpointDir() else rows
    n = rows.count()
    rows.write.mode("append").parquet(out)
    return n


def save_snapshot(tables: dict[str, DataFrame], root: str, repo: str, rev: str) -> None:
    """Tables of one index below root/repo/rev: written beside it under another name, then put in its place by renaming.

    Whoever reads finds the old index or the new one, or for a moment none, but no half of either.
    """
    spark = next(iter(tables.values())).sparkSession
    fresh, place = f"{root}/.{uuid.uuid4().hex}", f"{root}/{repo}/{rev}"
    for name, df in tables.items():
        df.withColumn("snapshot_version", F.lit(SNAPSHOT_VERSION)).write.parquet(f"{fresh}/{name}")
    path, fs = _folder(spark, place)
    fs.mkdirs(path.getParent())
    fs.delete(path, True)
    if not fs.rename(_folder(spark, fresh)[0], path):
        raise OSError(f"the index could not be put at {place}")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """repo, rev of every index below ``root``, by name; a repo may be of several folders (owner/name)."""
    top, fs = _folder(spark, root)
    found = []

    def walk(path, names: tuple[str, ...]) -> None:
        for entry in fs.listStatus(path):
            name = entry.getPath().getName()
            if entry.isDirectory() and not name.startswith((".", "_")):
                below = [x.getPath().getName() for x in fs.listStatus(entry.getPath())]
                if any(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), f"{x}/_SUCCESS")) for x in below):
                    found.append(("/".join(names), name))
                else:
                    walk(entry.getPath(), (*names, name))

    if fs.exists(top):
        walk(top, ())
    return spark.createDataFrame(sorted(found), "repo string, rev string")


def load_snapshot(spark: SparkSession, root: str, repo: str, rev: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of an index, or None where one is missing or of another version."""
    out = {}
    for name in names:
        try:
            df = spark.read.parquet(f"{root}/{repo}/{rev}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        first = df.select("snapshot_version").first()
        if first and first[0] != SNAPSHOT_VERSION:
            return None
        out[name] = df.drop("snapshot_version")
    return out


def content_hash(df: DataFrame, *columns: str) -> str:
    """A digest of a table's rows in any order, to compare before a cache is reused."""
    row = F.xxhash64(*columns)
    n, total, mixed = df.agg(F.count(F.lit(1)), F.sum((row % 1_000_000_007).cast("decimal(38,0)")), F.bit_xor(row)).first()
    return f"{n}:{total}:{mixed}"
