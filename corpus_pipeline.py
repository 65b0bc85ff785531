"""From raw documents to packed training windows, stage by stage.

Language ID, toxicity, near-duplicates, repeated passages, packing: each stage works
on all that the one before kept, and is written as Parquet and read again, so a lost
executor costs a stage at most. All stages but the last return the columns of
``documents``; columns that a table has besides those are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import jaccard_join, language, packing, repeats, toxicity
from graphloom.llm.shared import materialise, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The stages keep whole texts and learn models, so no SQL of DuckDB gives the same rows.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or too far from every language; a null ``lang`` becomes the predicted one."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    predicted = language.predict(docs, language.train(docs), keep=COLUMNS)
    return predicted.filter(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; learns from the labels of documents outside the held-out fold.

    Null and empty texts score as clean; without labels nothing is dropped; repeated rows score alike.
    """
    small_batches(spark)
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.learned(spark, docs, sf_dir), keep=COLUMNS)
    return scored.filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id; null ids are in no group.

    Where that id has several texts, all of them stay; of rows that are equal in all columns one does.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    first = jaccard_join.jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    repeated = materialise(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "doc_id", "left_anti").unionAll(kept.join(repeated, "doc_id", "left_semi").distinct())
    return kept.unionAll(docs.filter(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that an earlier document has out of the text; a document stays even where no word does.

    A text that loses nothing, null ones too, stays as it is; rows with equal ids are not compared.
    """
    small_batches(spark)
    cut = repeats.remove_repeats(docs.select(*COLUMNS), repeats.kept_text, repeats.KEPT, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows: every id of every document lies in one; a null text is one end id, repeated rows are packed each."""
    small_batches(spark)
    return packing.pack_table(docs, packing.encoder_for())


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
