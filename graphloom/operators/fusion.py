"""Combining rankings: reciprocal ranks, demotion, caps, votes, replies, evidence.

A *list table* has qid, list (name), ord (place of the list), rank, file, score.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Lists in the order that decides ties, their weights in the weighted recipe, and the production constant.
ORDER = ("bm", "gr", "ppr_bm", "ppr_gr", "rec", "path", "expl")
WEIGHTS = dict(zip(ORDER, (1.5, 1.0, 2.0, 2.0, 1.0, 1.0, 3.0)))
RRF_K, EXCLUDED, DEPTH = 40, ("gr",), 100
# Directory names that mark auxiliary files.
AUX_DIRS = ("tests", "test", "docs", "doc", "examples", "benchmarks")


def list_table(lists: dict[str, DataFrame], depths: dict[str, int] | None = None) -> DataFrame:
    """Named rankings as one list table."""
    out = None
    for name, r in lists.items():
        depth = (depths or {}).get(name, DEPTH)
        score = F.col("score").cast("double") if "score" in r.columns else F.lit(1.0)
        part = r.filter(F.col("rank") <= depth).select("qid", F.lit(name).alias("list"), F.lit(ORDER.index(name) if name in ORDER else 99).alias("ord"), "rank", "file", score.alias("score"))
        out = part if out is None else out.unionAll(part)
    return out


def rrf(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None, exclude: tuple[str, ...] = (), top: int | None = DEPTH, provenance: bool = False) -> DataFrame:
    """qid, file, score, rank: sum of weight / (k + rank); ties by first list, then rank in it."""
    weight: Column = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("list") == name, float(value)).otherwise(weight)
    used = lists.filter(~F.col("list").isin(*exclude)) if exclude else lists
    part = used.withColumn("contribution", weight / (F.lit(k) + F.col("rank")))
    aggs = [F.round(F.sum("contribution"), 9).alias("score"), F.min(F.struct("ord", "rank")).alias("first")]
    if provenance:
        aggs.append(F.sort_array(F.collect_list(F.struct("ord", "list", "rank", "contribution"))).alias("provenance"))
    fused = part.groupBy("qid", "file").agg(*aggs)
    w = W.partitionBy("qid").orderBy(F.desc("score"), "first", "file")
    out = fused.withColumn("rank", F.row_number().over(w)).drop("first")
    return out.filter(F.col("rank") <= top) if top else out


def is_aux(path: Column) -> Column:
    """``test`` anywhere, whatever its case, or a first segment that starts with ``doc``."""
    return F.lower(path).contains("test") | F.element_at(F.split(path, "/"), 1).startswith("doc")


def is_aux_old(path: Column) -> Column:
    return path.contains("test") | path.startswith("doc")


def is_aux_dir(path: Column) -> Column:
    """An auxiliary directory on the way, or a file named as a test."""
    segments = F.split(F.lower(path), "/")
    last = F.element_at(segments, -1)
    folders = F.slice(segments, 1, F.size(segments) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, AUX_DIRS))) | last.startswith("test_") | last.endswith("_test.py")


def demote(ranking: DataFrame, aux: Column, over: int = 2 * DEPTH, top: int = DEPTH) -> DataFrame:
    """Auxiliary files after all others, both in their order; of the first ``over``, cut to ``top``."""
    w = W.partitionBy("qid").orderBy(aux, "rank")
    return ranking.filter(F.col("rank") <= over).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def diversity_cap(ranking: DataFrame, group: Column, most: int = 12) -> DataFrame:
    """The first ``most`` of each group in rank order, the overflow behind them."""
    w = W.partitionBy("qid", group).orderBy("rank")
    spill = ranking.withColumn("spilled", F.row_number().over(w) > most)
    return spill.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("spilled", "rank"))).drop("spilled")


def score_sum(lists: DataFrame, top: int = DEPTH) -> DataFrame:
    """Sum over lists of score / greatest score of the list."""
    most = F.max("score").over(W.partitionBy("qid", "list"))
    scaled = lists.withColumn("s", F.col("score") / F.when(most == 0, 1.0).otherwise(most))
    fused = scaled.groupBy("qid", "file").agg(F.round(F.sum("s"), 8).alias("score"), F.min(F.struct("ord", "rank")).alias("first"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "first", "file")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("first")


def capped_union(lists: DataFrame, caps: dict[str, int], top: int = DEPTH) -> DataFrame:
    """The first files of each list after another, each file at its first place."""
    cap: Column = F.lit(0)
    place: Column = F.lit(99)
    for i, (name, value) in enumerate(caps.items()):
        cap = F.when(F.col("list") == name, value).otherwise(cap)
        place = F.when(F.col("list") == name, i).otherwise(place)
    head = lists.filter(F.col("rank") <= cap).groupBy("qid", "file").agg(F.min(F.struct(place.alias("i"), "rank")).alias("first"))
    w = W.partitionBy("qid").orderBy("first", "file")
    return head.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("qid", "file", "rank")


def recency_rerank(ranking: DataFrame, priors: DataFrame, share: float = 0.3) -> DataFrame:
    """(100 - rank) / 100 + share * recency / greatest recency, ranked anew."""
    most = priors.agg(F.max("recency").alias("most"))
    both = ranking.select("qid", "file", "rank").join(priors.select("file", "recency"), "file", "left").join(F.broadcast(most))
    score = F.round((100 - (F.col("rank") - 1)) / F.lit(100.0) + share * F.coalesce("recency", F.lit(0.0)) / F.col("most"), 8)
    w = W.partitionBy("qid").orderBy(F.desc("score"), "before")
    return both.select("qid", "file", score.alias("score"), F.col("rank").alias("before")).withColumn("rank", F.row_number().over(w)).drop("before")


def vote(lists: DataFrame, depth: int = 5) -> DataFrame:
    """Files by the number of lists that have them in the first ``depth``, then best rank."""
    counts = lists.filter(F.col("rank") <= depth).groupBy("qid", "file").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("best"))
    w = W.partitionBy("qid").orderBy(F.desc("votes"), "best", "file")
    return counts.withColumn("rank", F.row_number().over(w))


def mean_rank_vote(lists: DataFrame, depth: int = 5, seen: int = 10) -> DataFrame:
    """As ``vote``, ties by the mean rank over appearances in the first ``seen``."""
    counts = lists.filter(F.col("rank") <= seen).groupBy("qid", "file").agg(F.sum((F.col("rank") <= depth).cast("int")).alias("votes"), F.round(F.avg("rank"), 6).alias("mean_rank")).filter("votes > 0")
    w = W.partitionBy("qid").orderBy(F.desc("votes"), "mean_rank", "file")
    return counts.withColumn("rank", F.row_number().over(w))


def borda(lists: DataFrame) -> DataFrame:
    """Sum over lists of its length - rank + 1."""
    n = F.max("rank").over(W.partitionBy("qid", "list"))
    points = lists.withColumn("points", n - F.col("rank") + 1).groupBy("qid", "file").agg(F.sum("points").alias("score"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "file")
    return points.withColumn("rank", F.row_number().over(w))


def backfill(ranked: Column, candidates: Column) -> Column:
    """The returned files, then the candidates that weren't returned."""
    return F.array_distinct(F.concat(ranked, candidates))


def parse_reply(raw: Column, candidates: Column, most: int | None = None) -> Column:
    """The first bracketed list in a reply: known files in its order, once each.

    Where none can be read the candidates stay in their order: all of them, or the first ``most``.
    """
    listed = F.from_json(F.regexp_extract(raw, r"(?s)\[.*?\]", 0), "array<string>")
    known = F.array_intersect(F.transform(listed, lambda x: F.trim(x)), candidates)
    return F.when(F.size(known) > 0, known).otherwise(candidates if most is None else F.slice(candidates, 1, most))


def prompt(issue: Column, candidates: Column) -> Column:
    """The issue and its numbered candidates."""
    numbered = F.transform(candidates, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    return F.concat(F.left(issue, F.lit(1500)), F.lit("\n\n"), F.array_join(numbered, "\n"))


def window_chunks(candidates: Column, size: int = 25) -> Column:
    """Consecutive pieces of a candidate array, for scorers that see a few at a time."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(candidates), F.lit(1)), F.lit(size)), lambda i: F.slice(candidates, i, size))


def ensembles(hits: DataFrame, lists: DataFrame, gold: DataFrame, models: list[str], sizes: tuple[int, ...] = (2, 3, 4), k: int = 60, depth: int = 5) -> DataFrame:
    """combo, method, n, acc: strict accuracy at ``depth`` of every subset of models under rrf and vote.

    Subsets are a small literal table that meets the lists by model name; ``hits`` gives the queries that count.
    """
    spark = lists.sparkSession
    rows = [("+".join(c), m) for size in sizes for c in combinations(models, size) for m in c]
    combos = spark.createDataFrame(rows, "combo string, list string")
    used = lists.join(F.broadcast(combos), "list")
    fused = used.groupBy("combo", "qid", "file").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("s"), F.sum((F.col("rank") <= depth).cast("int")).alias("votes"), F.min("rank").alias("best"))
    w = W.partitionBy("combo", "qid")
    by_rrf = fused.withColumn("rank", F.row_number().over(w.orderBy(F.desc("s"), "file"))).filter(F.col("rank") <= depth).select("combo", F.lit("rrf").alias("method"), "qid", "file")
    by_vote = fused.filter("votes > 0").withColumn("rank", F.row_number().over(w.orderBy(F.desc("votes"), "best", "file"))).filter(F.col("rank") <= depth).select("combo", F.lit("vote").alias("method"), "qid", "file")
    found = by_rrf.unionAll(by_vote).join(gold, ["qid", "file"], "left_semi").groupBy("combo", "method", "qid").agg(F.count(F.lit(1)).alias("found"))
    need = hits.join(gold.groupBy("qid").agg(F.count(F.lit(1)).alias("need")), "qid")
    methods = spark.createDataFrame([(c, m) for c in dict.fromkeys(c for c, _ in rows) for m in ("rrf", "vote")], "combo string, method string")
    every = need.join(F.broadcast(methods))
    scored = every.join(found, ["combo", "method", "qid"], "left").groupBy("combo", "method")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.coalesce("found", F.lit(0)) == F.col("need")).cast("double")), 6).alias("acc"))


def evidence(candidates: DataFrame, seeds: DataFrame, pairs: DataFrame, static: DataFrame, propagated: DataFrame, seed_depth: int = 10) -> DataFrame:
    """qid, file and up to three chips: strongest co-change with a seed, first linked seed, graph score."""
    head = seeds.filter(F.col("rank") <= seed_depth).select("qid", F.col("file").alias("seed"), F.col("rank").alias("at"))
    met = candidates.select("qid", "file").join(head, "qid").filter("file <> seed").withColumn("src", F.least("file", "seed")).withColumn("dst", F.greatest("file", "seed"))
    change = met.join(pairs.select("src", "dst", "raw", "last"), ["src", "dst"]).groupBy("qid", "file").agg(F.max_by(F.struct("seed", "raw", "last"), F.struct("raw", -F.col("at"))).alias("c"))
    link = met.join(static.select("src", "dst"), ["src", "dst"], "left_semi").groupBy("qid", "file").agg(F.min_by("seed", "at").alias("link"))
    most = F.max("p").over(W.partitionBy("qid"))
    graph = propagated.select("qid", F.col("node").alias("file"), F.round(F.col("p") / most, 4).alias("graph")).filter("graph > 0")
    out = candidates.select("qid", "file").join(change, ["qid", "file"], "left").join(link, ["qid", "file"], "left").join(graph, ["qid", "file"], "left")
    return out.select("qid", "file", F.col("c.seed").alias("with_file"), F.col("c.raw").alias("count"), F.date_format("c.last", "MMM yyyy").alias("month"), "link", "graph")


def render(with_file: Column, count: Column, link: Column, graph: Column) -> Column:
    """The chips as one line."""
    return F.concat_ws(
        "; ",
        F.when(with_file.isNotNull(), F.format_string("co-changed with %s x%d", with_file.cast("string"), count)),
        F.when(link.isNotNull(), F.concat(F.lit("import link to "), link.cast("string"))),
        F.when(graph.isNotNull(), F.format_string("graph score %.2f", graph)),
    )
