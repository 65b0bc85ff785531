"""Change history: filters, ancestry, co-change pairs, per-file priors, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DECAY = 1 / 90  # per day


def age_days(ts: Column, base: str) -> Column:
    """Days before ``base``; later commits have age 0."""
    seconds = F.unix_timestamp(F.lit(base).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    return F.greatest(F.lit(0.0), seconds / F.lit(86400.0))


def bulk_filter(changes: DataFrame, most: int) -> DataFrame:
    """Changes of commits with at most ``most`` files: a count per commit, pre-aggregated before the shuffle."""
    kept = changes.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("sha")
    return changes.join(kept, "sha", "left_semi")


def until(commits: DataFrame, base: str) -> DataFrame:
    """Commits not after ``base``: a time cutoff, which isn't ancestry (see ``ancestors``)."""
    return commits.filter(F.col("ts") <= F.lit(base).cast("timestamp_ntz"))


def alive_changes(changes: DataFrame, commits: DataFrame, tree: DataFrame, base: str, most: int, dated_only: bool = False) -> DataFrame:
    """sha, ts, file, age of small commits up to ``base``, for files that the tree still has.

    Where ``commits`` are already those that a revision reaches, pass ``dated_only``: then
    the date of the base gives ages, and a commit dated after it counts with age 0.
    """
    dated = bulk_filter(changes, most).join(commits if dated_only else until(commits, base), "sha")
    return dated.join(tree.select("file"), "file", "left_semi").withColumn("age", age_days(F.col("ts"), base))


def ancestors(parents: DataFrame, base: DataFrame, rounds: int = 64) -> DataFrame:
    """base, sha of everything reachable from each base revision, itself included.

    Round k has the hops of exactly 2**k steps and extends what has been found by them, so
    a chain of n commits takes log2(n) rounds, and a commit's hops don't grow with the
    depth of the graph. A round that finds nothing new is the last. Each cuts its lineage.
    """
    hop = parents.filter("parent is not null").select("sha", F.col("parent").alias("up")).distinct().checkpoint()
    found = base.select(F.col("sha").alias("base"), "sha").distinct().checkpoint()
    known = found.count()
    for k in range(rounds):
        if k:
            hop = hop.alias("a").join(hop.alias("b"), F.col("a.up") == F.col("b.sha")).select("a.sha", "b.up").distinct().checkpoint()
        more = found.join(hop, "sha").select("base", F.col("up").alias("sha"))
        found = found.unionAll(more).distinct().checkpoint()
        now = found.count()
        if now == known:
            return found
        known = now
    raise RuntimeError("ancestry is deeper than the rounds allow")


def reachable(commits: DataFrame, parents: DataFrame, heads: DataFrame) -> DataFrame:
    """The commits that are ancestors of a head, or heads: neither later ones nor those of other branches."""
    return commits.join(ancestors(parents, heads).select("sha").distinct(), "sha", "left_semi")


def cochange_pairs(alive: DataFrame, decay: float = DECAY) -> DataFrame:
    """src < dst, raw count, decayed weight and last time, in one aggregation over the self-join.

    The bulk filter bounds the pairs of a commit, so no commit can blow the join up.
    """
    a, b = alive.alias("a"), alive.select("sha", "file").alias("b")
    met = a.join(b, (F.col("a.sha") == F.col("b.sha")) & (F.col("a.file") < F.col("b.file")))
    weight = F.exp(-F.lit(decay) * F.col("a.age")) if decay > 0 else F.lit(1.0)
    return met.groupBy(F.col("a.file").alias("src"), F.col("b.file").alias("dst")).agg(F.count(F.lit(1)).alias("raw"), F.sum(weight).alias("decayed"), F.max("a.ts").alias("last"))


def priors(alive: DataFrame, decay: float = DECAY) -> DataFrame:
    """file, recency (decayed), freq (count), last: the per-file priors."""
    return alive.groupBy("file").agg(F.sum(F.exp(-F.lit(decay) * F.col("age"))).alias("recency"), F.count(F.lit(1)).alias("freq"), F.max("ts").alias("last"))


def symmetric(edges: DataFrame, *columns: str) -> DataFrame:
    """Both directions of each edge."""
    return edges.select("src", "dst", *columns).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns))


def involvement(pairs: DataFrame) -> DataFrame:
    """file, total: raw counts over the pairs that a file is in."""
    return symmetric(pairs, "raw").groupBy(F.col("src").alias("file")).agg(F.sum("raw").alias("total"))


def head_commits(changes: DataFrame, commits: DataFrame, low: int = 2, high: int = 10, n: int = 60) -> DataFrame:
    """The newest ``n`` commits with between ``low`` and ``high`` files."""
    sized = changes.groupBy("sha").agg(F.count(F.lit(1)).alias("n_files")).filter(F.col("n_files").between(low, high))
    return sized.join(commits, "sha").orderBy(F.desc("ts"), "sha").limit(n)


def sessions(events: DataFrame, gap_seconds: int, by: str = "user_id") -> DataFrame:
    """Events with a running session number per ``by``: a new one after a pause longer than the gap."""
    w = W.partitionBy(by).orderBy("ts", "event_id")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    pause = seconds - F.lag(seconds).over(w)
    return events.withColumn("session", F.sum(F.when(pause > gap_seconds, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def session_pairs(alive: DataFrame, author: DataFrame, gap_seconds: int, base: str, most: int = 30, decay: float = DECAY) -> DataFrame:
    """Co-change within an author's work sessions instead of single commits.

    ``author`` gives sha, who. Sessions of 2 to ``most`` distinct files count, at the
    time of their last commit.
    """
    rows = alive.select("sha", "ts", "file").join(author, "sha")
    heads = rows.select("who", "sha", "ts").distinct()
    w = W.partitionBy("who").orderBy("ts", "sha")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    numbered = heads.withColumn("session", F.sum(F.when(seconds - F.lag(seconds).over(w) > gap_seconds, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = numbered.groupBy("who", "session").agg(F.max("ts").alias("ts"))
    files = rows.select("who", "sha", "file").join(numbered.select("who", "sha", "session"), ["who", "sha"]).select("who", "session", "file").distinct()
    fit = files.groupBy("who", "session").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, most))
    unit = files.join(fit, ["who", "session"]).join(ends, ["who", "session"])
    as_commits = unit.select(F.struct("who", "session").alias("sha"), "ts", "file").withColumn("age", age_days(F.col("ts"), base))
    return cochange_pairs(as_commits, decay)


def edge_stamps(alive: DataFrame, pairs: DataFrame, cap: int = 400) -> DataFrame:
    """src, dst, stamps: ascending times of the wanted pairs' common commits, the newest ``cap``."""
    a, b = alive.select("sha", "ts", "file").alias("a"), alive.select("sha", "file").alias("b")
    met = a.join(b, (F.col("a.sha") == F.col("b.sha")) & (F.col("a.file") < F.col("b.file"))).select(F.col("a.file").alias("src"), F.col("b.file").alias("dst"), "ts")
    times = F.sort_array(F.collect_list(F.unix_timestamp(F.col("ts").cast("timestamp"))))
    listed = met.join(pairs.select("src", "dst"), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(times.alias("stamps"))
    return listed.withColumn("stamps", F.slice("stamps", F.greatest(F.size("stamps") - (cap - 1), F.lit(1)), cap))


def replay(stamps: DataFrame, at: int, decay: float = DECAY) -> DataFrame:
    """The decayed weight of each edge as it was at a unix time, and how many commits it had."""
    seen = F.filter("stamps", lambda t: t <= at)
    weight = F.aggregate(seen, F.lit(0.0), lambda s, t: s + F.exp(-F.lit(decay) * (F.lit(at) - t) / F.lit(86400.0)))
    return stamps.select("src", "dst", F.size(seen).alias("count"), weight.alias("weight")).filter("count > 0")


def year_pivot(alive: DataFrame, years: list[int], least: int = 3, top: int = 18) -> DataFrame:
    """The most frequent pairs with their counts per calendar year."""
    a, b = alive.select("sha", "ts", "file").alias("a"), alive.select("sha", "file").alias("b")
    met = a.join(b, (F.col("a.sha") == F.col("b.sha")) & (F.col("a.file") < F.col("b.file"))).select(F.col("a.file").alias("src"), F.col("b.file").alias("dst"), F.year("ts").alias("y"))
    counts = [F.sum(F.when(F.col("y") == y, 1).otherwise(0)).alias(f"y{y}") for y in years]
    return met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("total"), *counts).filter(F.col("total") >= least).orderBy(F.desc("total"), "src", "dst").limit(top)
