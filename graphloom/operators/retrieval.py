"""Text retrieval: BM25, identifier search, path tokens, quoted paths, feedback terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions.text import TERM_CAP, code_identifiers, counted, named, runs, strings, term_counts, terms_of, whole
from graphloom.operators import scoring
from graphloom.operators.graph import ranked

K1, B = 1.2, 0.75
#: A path begins where a run of its signs does, or after the one before: so a long run without a path is passed once.
PATH = r"(?U)(?:\G|(?<![\w./-]))[\w./-]+?[\w-]\.py"


def query_terms(issues: DataFrame, text: str = "text") -> DataFrame:
    """qid, term: distinct terms of each query."""
    return term_counts(issues.select("qid", F.col(text).alias("text")), "qid", None, apart=True).select("qid", "term").distinct()


def bm25(terms: DataFrame, tf: DataFrame, top: int = 100, k1: float = K1, b: float = B) -> DataFrame:
    """qid, file, score, rank from stored counts. ``tf`` is read once for lengths and once for the postings of the queries' terms."""
    lengths = tf.groupBy("file").agg(F.greatest(F.sum("f"), F.lit(1)).alias("dl"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))
    hits = tf.join(terms, "term")
    df = tf.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    scored = hits.join(df, "term").join(lengths, "file").join(F.broadcast(corpus)).groupBy("qid", "file").agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scored, top)


def bm25_texts(terms: DataFrame, texts: DataFrame, top: int = 100, cap: int | None = TERM_CAP, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25`` straight from texts: the same rows as over ``term_counts`` with the same cap, without a row for each pair."""
    asked = scoring.Asked(terms)

    def find(column, places, known):
        row, term, f, words = counted(column, cap, known)
        length = np.bincount(row, f, len(column)).astype("i8")
        place = scoring.placed(words, places)[term]
        has = place >= 0
        return np.where(length > 0, length, -1), row[has], place[has], f[has]

    packed = scoring.blocks(whole(texts, "file"), asked.terms, find)
    df, n, total = scoring.frequencies(packed, len(asked.terms))
    idf, mean = np.log((n - df + 0.5) / (df + 0.5) + 1), total / max(n, 1)
    return scoring.best(packed, asked, lambda t, f, length: idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean)), top)


def identifier_search(issues: DataFrame, texts: DataFrame, top: int = 100) -> DataFrame:
    """qid, file, score, rank: ln(n / (1 + df)) over the identifiers that a file has, plus 2 where one and the file's name contain each other.

    ``texts`` has file, text, name.
    """
    asked = scoring.Asked(issues.select("qid", F.explode(code_identifiers(F.col("text"))).alias("ident")).distinct())

    def find(column, places, known):
        row, ident, _, idents = named(column)
        place = scoring.placed(idents, places)[ident]
        has = place >= 0
        return np.zeros(len(column), "i8"), row[has], place[has], np.ones(has.sum(), "i8")

    packed = scoring.blocks(whole(texts, "file", "name"), asked.terms, find, "name")
    n, (df, _, _) = texts.count(), scoring.frequencies(packed, len(asked.terms))
    idf = np.log(n / (1.0 + df)) if n else np.zeros(len(df))
    lowered = [t.lower() for t in asked.terms]
    shared = texts.sparkSession.sparkContext.broadcast((lowered, asked.queries, asked.counts, asked.starts, len(asked.qids)))

    def bonus(name):
        """2 for each identifier of a query, whether the text has it or not."""
        idents, queries, counts, starts, n_q = shared.value
        near = np.array([i for i, t in enumerate(idents) if name in t or t in name] if name is not None else [], int)
        return 2.0 * np.bincount(queries[runs(starts[near], counts[near])], minlength=n_q)

    return scoring.best(packed, asked, lambda t, f, length: idf[t], top, bonus)


def path_tokens(terms: DataFrame, tree: DataFrame, top: int = 60) -> DataFrame:
    """qid, file, score, rank: common terms of query and path over 1 + ln(1 + terms of the path).

    Paths that have the same terms of those asked for, and as many terms, are equal to every query but for ties, which
    go by file: so the first ``top`` of such a class stand for it, and queries with the same terms of those that paths
    have are answered once. Classes meet on common terms, and of those only the best that fill a query's list are opened.
    """

    def split(batches):
        for batch in batches:
            found = [list(dict.fromkeys(terms_of(p))) if p is not None else [] for p in strings(batch.column(1))]
            sizes = np.array([len(x) for x in found], "i4")
            row = np.repeat(np.arange(len(found)), sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(sizes[row]), pa.array([t for x in found for t in x], pa.string())], ["file", "n", "term"])

    toks = tree.select("file", F.translate("path", "/.", "__").alias("path")).mapInArrow(split, f"file {tree.schema['file'].dataType.simpleString()}, n int, term string")
    both = toks.select("term").distinct().join(terms.select("term").distinct(), "term")
    listed = lambda df, *by: df.join(both, "term").groupBy(*by).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    first = listed(toks, "file", "n").withColumn("place", F.row_number().over(W.partitionBy("terms", "n").orderBy("file"))).filter(F.col("place") <= top)
    asked = listed(terms, "qid")
    classes = first.groupBy("terms", "n").agg(F.array_sort(F.collect_list("file")).alias("files"))
    paths = classes.select(F.col("terms").alias("has"), "n", F.size("files").alias("many"), F.explode("terms").alias("term"))
    wants = asked.select("terms").distinct().withColumn("term", F.explode("terms"))
    met = wants.join(paths, "term").groupBy("terms", "has", "n", "many").agg(F.count(F.lit(1)).alias("k"))
    scored = met.withColumn("score", F.round(F.col("k") / (1 + F.ln(1.0 + F.col("n"))), 6))
    # a class counts while those with better scores don't fill the list
    w = W.partitionBy("terms").orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, 0)
    upto = scored.withColumn("upto", F.sum("many").over(w))
    equal = F.sum("many").over(W.partitionBy("terms", "score"))
    opened = upto.withColumn("before", F.col("upto") - equal).filter(F.col("before") < top)
    rows = opened.join(classes.select(F.col("terms").alias("has"), "n", "files"), ["has", "n"]).select("terms", "score", F.explode("files").alias("file"))
    w = W.partitionBy("terms").orderBy(F.desc("score"), "file")
    best = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    answers = best.groupBy("terms").agg(F.array_sort(F.collect_list(F.struct("rank", "file", "score"))).alias("found"))
    return asked.join(answers, "terms").select("qid", F.explode("found").alias("x")).select("qid", "x.file", "x.score", "x.rank")


def quoted_paths(issues: DataFrame, tree: DataFrame, top: int = 10) -> DataFrame:
    """qid, file, rank: files whose path is, or ends in, a path that the query mentions; by mention, then path.

    Every suffix of a path is a key, so mentions meet files by equality and not by a nested loop.
    """
    found = F.regexp_extract_all("text", F.lit(PATH), F.lit(0))
    said = issues.select("qid", F.posexplode(found).alias("at", "raw")).select("qid", "at", F.ltrim("raw", F.lit("./")).alias("cand"))
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ends = tree.select("file", "path", F.explode(suffixes).alias("cand"))
    met = ends.join(said, "cand").groupBy("qid", "file", "path").agg(F.min("at").alias("at"))
    w = W.partitionBy("qid").orderBy("at", "path")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("qid", "file", "rank")


def counts_of_first(ranking: DataFrame, texts: DataFrame, docs: int = 5, cap: int | None = TERM_CAP) -> DataFrame:
    """Term counts of the first documents of each query, for ``feedback_terms``: no other text is counted."""
    heads = ranking.filter(F.col("rank") <= docs).select("file").distinct()
    return term_counts(texts.join(F.broadcast(heads), "file", "left_semi"), "file", cap)


def feedback_terms(ranking: DataFrame, tf: DataFrame, docs: int = 5, per_doc: int = 30, terms: int = 25) -> DataFrame:
    """qid, term, weight: of the first documents the most common terms, summed, the most common of those."""
    heads = ranking.filter(F.col("rank") <= docs).select("qid", "file")
    w = W.partitionBy("file").orderBy(F.desc("f"), "term")
    common = tf.join(heads.select("file").distinct(), "file", "left_semi").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_doc)
    summed = heads.join(common, "file").groupBy("qid", "term").agg(F.sum("f").alias("weight"))
    w = W.partitionBy("qid").orderBy(F.desc("weight"), "term")
    return summed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= terms).select("qid", "term", "weight")


__all__ = ["bm25", "bm25_texts", "feedback_terms", "identifier_search", "path_tokens", "query_terms", "quoted_paths", "term_counts"]
