"""Analysis of answers: what several systems ranked, held against gold, by group, bucket and cost.

Answers are rows (qid, system, file, rank); a basket is (qid, file, place); gold is
(qid, file). A query without gold is left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions import stats


def completed(answers: DataFrame, basket: DataFrame) -> DataFrame:
    """qid, system, file, rank: each answer, then the files of the basket that it doesn't have, in its order."""
    asked = answers.select("qid", "system").distinct()
    more = asked.join(basket, "qid").join(answers.select("qid", "system", "file"), ["qid", "system", "file"], "left_anti")
    both = answers.select("qid", "system", "file", F.lit(0).alias("part"), F.col("rank").alias("at")).unionByName(more.select("qid", "system", "file", F.lit(1).alias("part"), F.col("place").alias("at")))
    w = W.partitionBy("qid", "system").orderBy("part", "at", "file")
    return both.withColumn("rank", F.row_number().over(w)).select("qid", "system", "file", "rank")


def answered_by_all(answers: DataFrame, systems: int) -> DataFrame:
    """qid that every one of so many systems has an answer for."""
    return answers.groupBy("qid").agg(F.countDistinct("system").alias("n")).filter(F.col("n") == systems).select("qid")


def strict_hits(ranking: DataFrame, gold: DataFrame, depths: dict[str, int]) -> DataFrame:
    """qid, system, n_gold and per named depth whether all gold files are that high."""
    need = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    asked = ranking.select("qid", "system").distinct().join(need, "qid")
    found = ranking.join(gold, ["qid", "file"]).groupBy("qid", "system").agg(*(F.sum((F.col("rank") <= k).cast("int")).alias(name) for name, k in depths.items()))
    out = asked.join(found, ["qid", "system"], "left")
    return out.select("qid", "system", "n_gold", *((F.coalesce(F.col(name), F.lit(0)) == F.col("n_gold")).alias(name) for name in depths))


def any_hit(hits: DataFrame, flag: str) -> DataFrame:
    """n, rate: the share of queries that at least one system hits."""
    return hits.groupBy("qid").agg(F.bool_or(flag).alias("hit")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))


def headroom(hits: DataFrame, basket: DataFrame, gold: DataFrame, flag: str, most: int = 50) -> DataFrame:
    """By gold count (3 stands for 3 and more): queries, those with all gold in the basket, and of these those no system hits."""
    inside = gold.join(basket.filter(F.col("place") <= most).select("qid", "file"), ["qid", "file"]).groupBy("qid").agg(F.count(F.lit(1)).alias("inside"))
    per = hits.groupBy("qid", "n_gold").agg(F.bool_or(flag).alias("hit")).join(inside, "qid", "left")
    whole = F.coalesce("inside", F.lit(0)) == F.col("n_gold")
    count = lambda c: F.sum(c.cast("int")).cast("long")
    return per.groupBy(F.least(F.lit(3), "n_gold").alias("golds")).agg(F.count(F.lit(1)).alias("n"), count(whole).alias("ceiling"), count(whole & ~F.col("hit")).alias("convertible"), count(~whole).alias("basket_miss"))


def micro_recall(ranking: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    """system, recall: gold files found within ``depth`` over all gold files of its queries."""
    asked = ranking.select("qid", "system").distinct().join(gold, "qid")
    found = asked.join(ranking.filter(F.col("rank") <= depth), ["qid", "system", "file"], "left")
    return found.groupBy("system").agg(F.count(F.lit(1)).alias("n_gold"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("recall"))


def slices(hits: DataFrame, meta: DataFrame, flags: dict[str, Column], flag: str) -> DataFrame:
    """grp, system, n, k, acc, low, high: accuracy with its interval in each named slice of ``meta``; a query may be in several."""
    listed = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in flags.items())), lambda x: x.isNotNull())
    joined = hits.join(meta, "qid").withColumn("grp", F.explode(listed))
    out = joined.groupBy("grp", "system").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("int")).cast("long").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return out.select("grp", "system", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("acc"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def report(rows: DataFrame, hits: DataFrame, five: str, ten: str) -> DataFrame:
    """system, n, errors, both accuracies, interval of the first, mean tokens; ``rows`` has error and tokens of every call."""
    calls = rows.groupBy("system").agg(F.count("error").alias("errors"), F.round(F.coalesce(F.avg(F.when(F.col("error").isNull() & (F.col("tokens") > 0), F.col("tokens"))), F.lit(0.0)), 4).alias("tokens"))
    right = hits.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(five).cast("int")).alias("k"), F.avg(F.col(ten).cast("int")).alias("ten"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    out = calls.join(right, "system", "left")
    return out.select("system", F.coalesce("n", F.lit(0)).alias("n"), "errors", F.round(F.col("k") / F.col("n"), 6).alias("acc5"), F.round("ten", 6).alias("acc10"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), "tokens")


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost: prompt and completion tokens times their price, to 8 places; null without a price."""
    return calls.join(prices, "system", "left").withColumn("cost", F.round(F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price"), 8))


def paired_deltas(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """qid, delta: value of configuration ``a`` less that of ``b``, where both are there."""
    pick = lambda c: F.max(F.when(F.col("config") == c, F.col("value")))
    return metrics.filter(F.col("config").isin(a, b)).groupBy("qid").agg((pick(a) - pick(b)).alias("delta")).filter("delta is not null")


def summary(metrics: DataFrame, values: list[str]) -> DataFrame:
    """repo (null: all), config, n and mean of each value, in one pass of grouping sets."""
    out = metrics.groupingSets([[F.col("config")], [F.col("repo"), F.col("config")]], "repo", "config")
    return out.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(v), 6).alias(v) for v in values))


def chosen_ensembles(ranking: DataFrame, gold: DataFrame, split: DataFrame, systems: list[str], depth: int = 5, k: int = 60, top: int = 8, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """combo, method, dev, holdout: the combinations best on the dev split, and how they do on the other.

    Ties go by method and combination, both descending.
    """
    combos = ["+".join(c) for n in sizes for c in combinations(systems, n)]
    listed = ranking.withColumn("combo", F.explode(F.array(*map(F.lit, combos)))).filter(F.array_contains(F.split("combo", r"\+"), F.col("system")))
    fused = listed.groupBy("combo", "qid", "file").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.sum((F.col("rank") <= depth).cast("int")).alias("votes"), F.min("rank").alias("best"))
    place = lambda *order: F.row_number().over(W.partitionBy("combo", "qid").orderBy(*order, "file"))
    ways = {"rrf": fused.withColumn("rank", place(F.desc("rrf"))), "vote": fused.filter("votes > 0").withColumn("rank", place(F.desc("votes"), "best"))}
    placed = reduce(DataFrame.unionByName, (df.filter(F.col("rank") <= depth).select("combo", "qid", "file", F.lit(name).alias("method")) for name, df in ways.items()))
    need = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold")).join(split, "qid")
    every = need.withColumn("method", F.explode(F.array(F.lit("rrf"), F.lit("vote")))).withColumn("combo", F.explode(F.array(*map(F.lit, combos))))
    found = placed.join(gold, ["qid", "file"]).groupBy("combo", "method", "qid").agg(F.count(F.lit(1)).alias("found"))
    right = every.join(found, ["combo", "method", "qid"], "left").withColumn("right", (F.coalesce("found", F.lit(0)) == F.col("n_gold")).cast("int"))
    rate = lambda s: F.round(F.avg(F.when(F.col("split") == s, F.col("right"))), 6)
    return right.groupBy("combo", "method").agg(rate("dev").alias("dev"), rate("holdout").alias("holdout")).orderBy(F.desc("dev"), F.desc("method"), F.desc("combo")).limit(top)


def gold_from_functions(functions: DataFrame) -> DataFrame:
    """qid, file: the text before the first colon of each path:function, once each."""
    return functions.select("qid", F.explode("functions").alias("f")).select("qid", F.substring_index("f", ":", 1).alias("file")).distinct()


def gold_places(ranking: DataFrame, gold: DataFrame, *by: str) -> DataFrame:
    """``by``, qid, places: sorted ranks of the gold files that a ranking has."""
    return ranking.join(gold, ["qid", "file"]).groupBy(*by, "qid").agg(F.sort_array(F.collect_list("rank")).alias("places"))


def partners(alive: DataFrame, gold: DataFrame, basket: DataFrame, first: int = 10, top: int = 2) -> DataFrame:
    """qid, file, cochange, rank: of a query's first candidates those that changed most often with a gold file of it."""
    heads = basket.filter(F.col("place") <= first).select("qid", "file")
    with_gold = gold.join(alive.select("sha", F.col("file")), "file").select("qid", "sha", F.col("file").alias("other"))
    met = with_gold.join(alive.select("sha", "file"), "sha").filter("file <> other").join(heads, ["qid", "file"], "left_semi")
    counted = met.groupBy("qid", "file").agg(F.count(F.lit(1)).alias("cochange"))
    w = W.partitionBy("qid").orderBy(F.desc("cochange"), "file")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def explained(seeds: DataFrame, gold: DataFrame, pairs: DataFrame, static: DataFrame) -> DataFrame:
    """qid, seed, file, raw, decayed, link: edges between a query's seeds and its gold files; pairs without one are left out."""
    met = seeds.select("qid", F.col("file").alias("seed")).join(gold, "qid").filter("seed <> file").withColumns({"src": F.least("seed", "file"), "dst": F.greatest("seed", "file")})
    linked = met.join(pairs.select("src", "dst", "raw", "decayed"), ["src", "dst"], "left").join(static.select("src", "dst", F.lit(True).alias("link")), ["src", "dst"], "left")
    return linked.filter("raw is not null or link").select("qid", "seed", "file", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("decayed", F.lit(0.0)).alias("decayed"), F.coalesce("link", F.lit(False)).alias("link"))


def recovered(ranking: DataFrame, gold: DataFrame, pairs: DataFrame, depth: int = 10) -> DataFrame:
    """qid, missed, companions: gold files beyond ``depth``, and those of them that changed with a gold file within it."""
    placed = gold.join(ranking.select("qid", "file", "rank"), ["qid", "file"], "left").withColumn("hit", F.coalesce(F.col("rank") <= depth, F.lit(False)))
    missed = placed.filter("not hit").select("qid", "file")
    both = pairs.select("src", "dst").unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = placed.filter("hit").select("qid", F.col("file").alias("src")).join(both, "src").select("qid", F.col("dst").alias("file"), F.lit(1).alias("near")).distinct()
    return missed.join(near, ["qid", "file"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("missed"), F.count("near").alias("companions"))


def visible(edges: DataFrame, weight: str = "w", least: float = 0.05) -> DataFrame:
    """Edges whose weight is above ``least``."""
    return edges.filter(F.col(weight) > least)


def quarantined(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """Adds ``parsed`` and ``error``: malformed JSON keeps its row, with what is wrong."""
    parsed = rows.withColumn("parsed", F.from_json(F.col(text), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull()
    return parsed.withColumn("error", F.when(F.col(text).isNull(), "missing").when(bad, "malformed")).withColumn("parsed", F.when(~bad, F.col("parsed").dropFields("_corrupt")))
