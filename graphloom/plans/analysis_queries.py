"""Queries that hold answers of several systems against gold: slices, headroom, costs, views, quarantine.

An order is a query here, its parts are the files of its basket (by line number), the
returned ones are gold, and three systems rank parts by price, by ship date and by
quantity; each answers with two files at most, and the third not on every order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions import stats
from graphloom.operators import analysis, checks
from graphloom.plans.history_queries import BOTH, alive, pairs
from graphloom.plans.registry import query
from graphloom.sources.tables import Model

SYSTEMS = ("price", "early", "bulk")
FIRST, MORE = 1, 2

BASKET = "basket as (select qid, file, row_number() over (partition by qid order by line, file) as place from (select l_orderkey as qid, l_partkey as file, min(l_linenumber) as line from lineitem group by 1, 2))"
TRUTH = "truth as (select distinct l_orderkey as qid, l_partkey as file from lineitem where l_returnflag = 'R')"
ANSWERS = """answers as (select * from (
  select l_orderkey as qid, 'price' as system, l_partkey as file, row_number() over (partition by l_orderkey order by max(l_extendedprice) desc, l_partkey) as rank from lineitem group by l_orderkey, l_partkey
  union all select l_orderkey, 'early', l_partkey, row_number() over (partition by l_orderkey order by min(l_shipdate), l_partkey) from lineitem group by l_orderkey, l_partkey
  union all select l_orderkey, 'bulk', l_partkey, row_number() over (partition by l_orderkey order by max(l_quantity) desc, l_partkey) from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus <> 'P' group by l_orderkey, l_partkey) where rank <= 2)"""
FULL = """full_lists as (select qid, system, file, row_number() over (partition by qid, system order by part, spot, file) as rank from (
  select qid, system, file, 0 as part, rank as spot from answers
  union all select qid, system, file, 1, place from (select distinct qid, system from answers) join basket using (qid) where (qid, system, file) not in (select (qid, system, file) from answers)))"""
HITS = """need as (select qid, count(*) as n_gold from truth group by 1),
hits as (select qid, system, n_gold, coalesce(k1, 0) = n_gold as hit1, coalesce(k2, 0) = n_gold as hit2 from (select distinct qid, system from full_lists) join need using (qid)
  left join (select qid, system, sum((rank <= 1)::int) as k1, sum((rank <= 2)::int) as k2 from full_lists join truth using (qid, file) group by 1, 2) using (qid, system))"""
ALL = (BASKET, TRUTH, ANSWERS, FULL, HITS)
_WILSON = "round((k / n + 3.8416 / (2 * n) {} 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6)"
LOW, HIGH = _WILSON.format("-"), _WILSON.format("+")


def basket(m: Model) -> DataFrame:
    lines = m.table("lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("file")).agg(F.min("l_linenumber").alias("line"))
    return lines.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("line", "file"))).select("qid", "file", "place")


def truth(m: Model) -> DataFrame:
    return m.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("file")).distinct()


def answers(m: Model) -> DataFrame:
    lines = m.table("lineitem").withColumnsRenamed({"l_orderkey": "qid", "l_partkey": "file"})
    ready = m.table("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("qid"))
    ways = {"price": (lines, F.desc(F.max("l_extendedprice"))), "early": (lines, F.asc(F.min("l_shipdate"))), "bulk": (lines.join(ready, "qid", "left_semi"), F.desc(F.max("l_quantity")))}
    listed = []
    for name, (rows, _) in ways.items():
        best = rows.groupBy("qid", "file").agg((F.max("l_extendedprice") if name == "price" else F.min("l_shipdate") if name == "early" else F.max("l_quantity")).alias("by"))
        w = W.partitionBy("qid").orderBy(F.asc("by") if name == "early" else F.desc("by"), "file")
        listed.append(best.select("qid", F.lit(name).alias("system"), "file", F.row_number().over(w).alias("rank")).filter("rank <= 2"))
    return reduce(DataFrame.unionAll, listed)


def full(m: Model) -> DataFrame:
    return analysis.completed(answers(m), basket(m))


def hits(m: Model) -> DataFrame:
    return analysis.strict_hits(full(m), truth(m), {"hit1": FIRST, "hit2": MORE})


def issue(m: Model) -> DataFrame:
    """qid, category, repo, text, n_files of every order."""
    said = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" breaks src/app.py")).otherwise(F.lit(" is late")))
    rows = m.table("orders").join(m.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("repo")), "o_custkey")
    sizes = m.table("customer").groupBy(F.col("c_nationkey").alias("repo")).agg(F.count(F.lit(1)).alias("n_files"))
    return rows.select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("category"), "repo", said.alias("text")).join(sizes, "repo")


ISSUE = """issue as (select o_orderkey as qid, o_orderpriority as category, c_nationkey as repo, 'order ' || o_orderkey || case when o_orderkey % 3 = 0 then ' breaks src/app.py' else ' is late' end as text, n_files
  from orders join customer on c_custkey = o_custkey join (select c_nationkey as nk, count(*) as n_files from customer group by 1) on nk = c_nationkey)"""


@query("full_ranking", "select qid, system, file, rank from full_lists", *ALL)
def full_ranking(m):
    return full(m)


@query("answered_by_all", "select qid from answers group by qid having count(distinct system) = 3", ANSWERS)
def in_all(m):
    return analysis.answered_by_all(answers(m), len(SYSTEMS))


@query("strict_hits", "select qid, system, n_gold, hit1::bigint as hit1, hit2::bigint as hit2 from hits", *ALL)
def strict(m):
    return hits(m).withColumns({"hit1": F.col("hit1").cast("int"), "hit2": F.col("hit2").cast("int")})


@query("oracle_any", "select count(*) as n, round(avg(hit::int), 6) as rate from (select qid, bool_or(hit1) as hit from hits group by qid)", *ALL)
def oracle_any(m):
    return analysis.any_hit(hits(m), "hit1")


@query(
    "headroom",
    """select least(3, n_gold) as golds, count(*) as n, sum((coalesce(inside, 0) = n_gold)::int)::bigint as ceiling, sum((coalesce(inside, 0) = n_gold and not hit)::int)::bigint as convertible, sum((coalesce(inside, 0) <> n_gold)::int)::bigint as basket_miss
       from (select qid, n_gold, bool_or(hit1) as hit from hits group by 1, 2) left join (select qid, count(*) as inside from truth join basket using (qid, file) where place <= 3 group by 1) using (qid) group by 1""",
    *ALL,
)
def headroom(m):
    return analysis.headroom(hits(m), basket(m), truth(m), "hit1", most=3)


@query("micro_recall", "select system, count(*) as n_gold, round(avg((f.file is not null)::int), 6) as recall from (select distinct qid, system from full_lists) join truth t using (qid) left join (select * from full_lists where rank <= 2) f using (qid, system, file) group by 1", *ALL)
def micro(m):
    return analysis.micro_recall(full(m), truth(m), MORE)


@query(
    "subgroup_slices",
    f"""select grp, system, n, k, round(k / n, 6) as acc, {LOW} as low, {HIGH} as high from (select grp, system, count(*) as n, sum(hit1::int)::bigint as k from hits join (
          select qid, 'all' as grp from flagged union all select qid, 'category: ' || category from flagged union all select qid, 'gold=1' from flagged where n_gold = 1 union all select qid, 'gold=2' from flagged where n_gold = 2
          union all select qid, 'gold>=3' from flagged where n_gold >= 3 union all select qid, 'size quartile ' || bucket from flagged union all select qid, 'quotes a path' from flagged where quoted union all select qid, 'no path' from flagged where not quoted
          union all select qid, 'gold=1 and small' from flagged where n_gold = 1 and bucket <= 2) using (qid) group by 1, 2)""",
    *ALL,
    ISSUE,
    "edges as (select s[n // 4 + 1] as t1, s[2 * n // 4 + 1] as t2, s[3 * n // 4 + 1] as t3 from (select list_sort(list(n_files)) as s, count(*) as n from issue join need using (qid)))",
    "flagged as (select qid, category, n_gold, regexp_matches(text, '[\\w/]+\\.py') as quoted, case when n_files <= t1 then 1 when n_files <= t2 then 2 when n_files <= t3 then 3 else 4 end as bucket from issue join need using (qid), edges)",
)
def slices(m):
    from graphloom.operators.evaluation import quartile_buckets

    need = truth(m).groupBy("qid").agg(F.count(F.lit(1)).alias("golds"))
    meta = quartile_buckets(issue(m).join(need, "qid").select("qid", "category", "golds", "text", "n_files"), "n_files")
    quoted = F.col("text").rlike(r"[\w/]+\.py")
    flags = {"all": F.lit(True), "gold=1": F.col("golds") == 1, "gold=2": F.col("golds") == 2, "gold>=3": F.col("golds") >= 3, "quotes a path": quoted, "no path": ~quoted, "gold=1 and small": (F.col("golds") == 1) & (F.col("bucket") <= 2)}
    flags |= {f"size quartile {b}": F.col("bucket") == b for b in (1, 2, 3, 4)}
    named = meta.select("qid", "golds", "bucket", "text", "category")
    fixed = analysis.slices(hits(m), named, flags, "hit1")
    joined = hits(m).join(named.select("qid", "category"), "qid").groupBy(F.concat(F.lit("category: "), "category").alias("grp"), "system").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit1").cast("int")).cast("long").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return fixed.unionAll(joined.select("grp", "system", "n", "k", F.round(F.col("k") / F.col("n"), 6), F.round(low, 6), F.round(high, 6)))


CALLS = "calls as (select o_orderkey as qid, list_extract(['price', 'early', 'bulk'], (o_orderkey % 3 + 1)::int) as system, case when o_orderstatus = 'P' then 'timeout' end as error, (o_orderkey % 700)::bigint as tokens, o_custkey as prompt_tokens, (o_orderkey % 90)::bigint as completion_tokens from orders)"


def calls(m: Model) -> DataFrame:
    key = F.col("o_orderkey")
    named = F.element_at(F.array(*map(F.lit, SYSTEMS)), (key % 3 + 1).cast("int"))
    return m.table("orders").select(key.alias("qid"), named.alias("system"), F.when(F.col("o_orderstatus") == "P", "timeout").alias("error"), (key % 700).alias("tokens"), F.col("o_custkey").alias("prompt_tokens"), (key % 90).alias("completion_tokens"))


@query(
    "model_report",
    f"""select system, coalesce(n, 0) as n, errors, round(k / n, 6) as acc5, round(ten, 6) as acc10, {LOW} as low, {HIGH} as high, tokens
       from (select system, count(error) as errors, round(coalesce(avg(tokens) filter (error is null and tokens > 0), 0.0), 4) as tokens from calls group by 1) left join (select system, count(*) as n, sum(hit1::int)::bigint as k, avg(hit2::int) as ten from hits group by 1) using (system)""",
    *ALL,
    CALLS,
)
def report(m):
    return analysis.report(calls(m), hits(m), "hit1", "hit2")


@query("cost", "select qid, system, round(prompt_tokens * p + completion_tokens * c, 8) as cost from calls left join (select * from (values ('price', 0.0000015::double, 0.000002::double), ('bulk', 0.00000025::double, 0.00000125::double)) t(system, p, c)) using (system)", CALLS)
def cost(m):
    prices = m.spark.createDataFrame([("price", 1.5e-6, 2e-6), ("bulk", 2.5e-7, 1.25e-6)], "system string, prompt_price double, completion_price double")
    return analysis.costs(calls(m), prices).select("qid", "system", "cost")


@query(
    "history_buckets",
    """select bucket, count(*) as n, round(avg(delta), 6) as gain, round(avg(hit), 6) as acc, round(median(n_lines), 6) as edges from (select qid, case when n_files <= t1 then 1 when n_files <= t2 then 2 when n_files <= t3 then 3 else 4 end::bigint as bucket, a.v - b.v as delta, hit, n_lines
       from rated join edges on true join (select qid, recall as v from per where system = 'price') a using (qid) join (select qid, recall as v from per where system = 'early') b using (qid)) group by 1""",
    *ALL,
    ISSUE,
    "per as (select qid, system, avg((f.file is not null)::int) as recall from (select distinct qid, system from full_lists) join truth t using (qid) left join (select * from full_lists where rank <= 1) f using (qid, system, file) group by 1, 2)",
    "rated as (select qid, n_files, hit1::int as hit, n_lines from issue join hits using (qid) join (select qid, count(*) as n_lines from basket group by 1) using (qid) where system = 'price')",
    "edges as (select s[n // 4 + 1] as t1, s[2 * n // 4 + 1] as t2, s[3 * n // 4 + 1] as t3 from (select list_sort(list(n_files)) as s, count(*) as n from rated))",
)
def buckets(m):
    """Quartiles of history length: mean paired difference of recall, accuracy, median size."""
    from graphloom.operators.evaluation import quartile_buckets

    found = truth(m).join(full(m).select("qid", "system").distinct(), "qid").join(full(m).filter("rank <= 1"), ["qid", "system", "file"], "left")
    per = found.groupBy("qid", F.col("system").alias("config")).agg(F.avg(F.col("rank").isNotNull().cast("int")).alias("value"))
    deltas = analysis.paired_deltas(per, "price", "early")
    lines = basket(m).groupBy("qid").agg(F.count(F.lit(1)).alias("n_lines"))
    rated = issue(m).select("qid", "n_files").join(hits(m).filter("system = 'price'").select("qid", F.col("hit1").cast("int").alias("hit")), "qid").join(lines, "qid")
    joined = quartile_buckets(rated, "n_files").join(deltas, "qid")
    return joined.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 6).alias("gain"), F.round(F.avg("hit"), 6).alias("acc"), F.round(F.percentile("n_lines", F.lit(0.5)), 6).alias("edges"))


@query("config_summary", "select repo, system as config, count(*) as n, round(avg(hit1::int), 6) as first, round(avg(hit2::int), 6) as second from hits join issue using (qid) group by grouping sets ((system), (repo, system))", *ALL, ISSUE)
def summary(m):
    rows = hits(m).join(issue(m).select("qid", "repo"), "qid").select("repo", F.col("system").alias("config"), F.col("hit1").cast("int").alias("first"), F.col("hit2").cast("int").alias("second"))
    return analysis.summary(rows, ["first", "second"])


@query("config_pivot", "select repo, " + ", ".join(f"round(avg(hit1::int) filter (system = '{s}'), 6) as {s}" for s in SYSTEMS) + " from hits join issue using (qid) group by repo", *ALL, ISSUE)
def pivoted(m):
    rows = hits(m).join(issue(m).select("qid", "repo"), "qid")
    return rows.groupBy("repo").pivot("system", list(SYSTEMS)).agg(F.round(F.avg(F.col("hit1").cast("int")), 6))


@query(
    "ensemble_choice",
    """select combo, method, round(avg(ok) filter (split = 'dev'), 6) as dev, round(avg(ok) filter (split = 'holdout'), 6) as holdout from (
       select c.combo, w.method, q.qid, q.split, (coalesce(found, 0) = n_gold)::int as ok from (select distinct combo from combos) c cross join (select unnest(['rrf', 'vote']) as method) w cross join (select qid, n_gold, case when qid % 2 = 0 then 'dev' else 'holdout' end as split from need) q
       left join (select combo, method, qid, count(*) as found from (select combo, 'rrf' as method, qid, file from fus qualify row_number() over (partition by combo, qid order by s desc, file) <= 1
         union all select combo, 'vote', qid, file from fus where votes > 0 qualify row_number() over (partition by combo, qid order by votes desc, best, file) <= 1) join truth using (qid, file) group by 1, 2, 3) f on f.combo = c.combo and f.method = w.method and f.qid = q.qid)
       group by 1, 2 order by dev desc, method desc, combo desc limit 3""",
    *ALL,
    "combos as (select * from (values ('price+early', 'price'), ('price+early', 'early'), ('price+bulk', 'price'), ('price+bulk', 'bulk'), ('early+bulk', 'early'), ('early+bulk', 'bulk'), ('price+early+bulk', 'price'), ('price+early+bulk', 'early'), ('price+early+bulk', 'bulk')) t(combo, system))",
    "fus as (select combo, qid, file, round(sum(1.0 / (60 + rank)), 9) as s, sum((rank <= 1)::int) as votes, min(rank) as best from full_lists join combos using (system) group by 1, 2, 3)",
)
def choice(m):
    split = truth(m).select("qid").distinct().withColumn("split", F.when(F.col("qid") % 2 == 0, "dev").otherwise("holdout"))
    return analysis.chosen_ensembles(full(m), truth(m), split, list(SYSTEMS), depth=FIRST, top=3)


# ---------------------------------------------------------------- views


@query("instance_listing", "select qid as id, category, repo, left(text, 110) as title, n_gold, n_candidates from issue join need using (qid) join (select qid, count(*) as n_candidates from basket group by 1) using (qid) order by qid % 97 <> 0, repo, qid limit 200", *ALL, ISSUE)
def listing(m):
    """Instances with gold and a basket, the featured ones first."""
    need = truth(m).groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    size = basket(m).groupBy("qid").agg(F.count(F.lit(1)).alias("n_candidates"))
    rows = issue(m).join(need, "qid").join(size, "qid").orderBy(F.col("qid") % 97 != 0, "repo", "qid").limit(200)
    return rows.select(F.col("qid").alias("id"), "category", "repo", F.left("text", F.lit(110)).alias("title"), "n_gold", "n_candidates")


@query(
    "instance_detail",
    """select qid, string_agg(place::varchar, ',' order by place) as candidates, string_agg(rank::varchar, ',' order by rank) as final from truth join basket using (qid, file) join (select qid, file, rank from full_lists where system = 'price') using (qid, file) group by 1""",
    *ALL,
)
def detail(m):
    """Ranks of the gold files among the candidates and in the final list."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    first = analysis.gold_places(basket(m).withColumnRenamed("place", "rank"), truth(m))
    last = analysis.gold_places(full(m).filter("system = 'price'"), truth(m))
    return first.join(last.withColumnRenamed("places", "final"), "qid").select("qid", text(F.col("places")).alias("candidates"), text(F.col("final")).alias("final"))


@query(
    "explain_gold",
    """select qid, seed, file, coalesce(raw, 0) as raw, round(coalesce(decayed, 0), 6) as decayed, (l.src is not null)::bigint as link from (select b.qid, b.file as seed, t.file from basket b join truth t using (qid) where b.file <> t.file and b.place <= 3) x
       left join pairs p on p.src = least(seed, file) and p.dst = greatest(seed, file) left join static l on l.src = least(seed, file) and l.dst = greatest(seed, file) where raw is not null or l.src is not null""",
    BASKET,
    TRUTH,
)
def explain(m):
    out = analysis.explained(basket(m).filter("place <= 3"), truth(m), pairs(m), m.static_edges)
    return out.withColumns({"decayed": F.round("decayed", 6), "link": F.col("link").cast("int")})


@query(
    "partner_counts",
    """select qid, file, cochange, rank from (select qid, file, count(*) as cochange, row_number() over (partition by qid order by count(*) desc, file) as rank from (select t.qid, b.file from truth t join alive a on a.file = t.file join alive b on b.sha = a.sha and b.file <> a.file) join basket using (qid, file) where place <= 10 group by 1, 2) where rank <= 2""",
    BASKET,
    TRUTH,
)
def partner_counts(m):
    return analysis.partners(alive(m), truth(m), basket(m))


@query(
    "companion_recovery",
    """select qid, count(*) as missed, sum((exists (select 1 from truth t join price p using (qid, file) join both_ways e on e.src = t.file where t.qid = g.qid and p.rank <= 1 and e.dst = g.file))::int)::bigint as companions
       from truth g left join price using (qid, file) where coalesce(rank, 99) > 1 group by 1""",
    *ALL,
    BOTH,
    "price as (select qid, file, rank from full_lists where system = 'price')",
)
def companions(m):
    return analysis.recovered(full(m).filter("system = 'price'"), truth(m), pairs(m), depth=FIRST)


@query("visible_edges", "select src, dst, round(decayed, 6) as w from pairs where round(decayed, 6) > 0.05")
def visible(m):
    return analysis.visible(pairs(m).select("src", "dst", F.round("decayed", 6).alias("w")))


# ---------------------------------------------------------------- rows that fail, checks, small functions


@query("quarantine", "select event_id, case when event_id % 11 = 0 then 'missing' when event_id % 7 = 0 then 'malformed' end as error, case when event_id % 11 = 0 or event_id % 7 = 0 then null else json_extract(props, '$.k')::bigint end as k from events")
def quarantine(m):
    text = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.left("props", F.lit(4))).otherwise(F.col("props"))
    return analysis.quarantined(m.table("events").select("event_id", text.alias("said")), "said", "k long").select("event_id", "error", "parsed.k")


@query("checked_requests", "select qid, (length(trim(coalesce(text, ''))) >= 12)::bigint as ok, case when qid % 5 = 0 then 50 else greatest(10, least(100, qid % 200)) end::bigint as depth from issues")
def requests(m):
    depth = F.when(F.col("qid") % 5 == 0, F.lit(None).cast("long")).when(F.col("qid") % 200 == 0, F.lit(0)).otherwise(F.col("qid") % 200)
    return m.issues.select("qid", checks.long_enough(F.col("text")).cast("int").alias("ok"), checks.clamped_column(depth).alias("depth"))


@query("gold_from_functions", "select distinct qid, 'src/' || (l_partkey % 50) || '.py' as file from (select l_orderkey as qid, l_partkey from lineitem)")
def functions(m):
    said = m.table("lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_list(F.concat(F.lit("src/"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py:Class.run:"), F.col("l_linenumber").cast("string"))).alias("functions"))
    return analysis.gold_from_functions(said)


@query("map_items", "select conv_id, role, count(*) as n, (select count(*) from conversations t where t.conv_id = c.conv_id and t.role = 'tool') as tools from conversations c group by conv_id, role")
def items(m):
    """A map of counts: its entries, and one of them with a default."""
    counts = m.table("conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    mapped = counts.groupBy("conv_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "n")))).alias("mm"))
    return mapped.select("conv_id", F.explode("mm").alias("role", "n"), F.coalesce(F.try_element_at("mm", F.lit("tool")), F.lit(0)).alias("tools"))


@query("month_label", "select src, dst, strftime(last, '%b %Y') as month from pairs")
def months(m):
    return pairs(m).select("src", "dst", F.date_format("last", "MMM yyyy").alias("month"))
