"""Queries over ancestry, blobs, parsed imports and a stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import history, imports, index
from graphloom.plans.history_queries import SBOTH
from graphloom.plans.registry import query
from graphloom.session import shared_folder
from graphloom.sources import logs
from graphloom.sources.tables import BASE, BULK, Model

# A branching graph: each order follows its customer's previous one, and every tenth merges in the order two numbers
# below, if that is older; heads are every seventh customer's latest order up to the base.
BRANCHES = f"""branches as (select sha, parent from parents union select a.o_orderkey, b.o_orderkey from orders a join orders b on b.o_orderkey = a.o_orderkey - 2 and b.o_orderdate < a.o_orderdate where a.o_orderkey % 10 = 0),
tips as (select max_by(o_orderkey, (o_orderdate, o_orderkey)) as sha from orders where o_custkey % 7 = 0 and o_orderdate <= timestamp '{BASE}' group by o_custkey)"""
CLOSURE = "closure(sha) as (select sha from tips union select p.parent from closure c join branches p on p.sha = c.sha)"
REACHED = (
    BRANCHES,
    CLOSURE,
    f"rhistory as (select sha, ts, file, greatest(0, (epoch(timestamp '{BASE}') - epoch(ts)) / 86400.0) as age from small join commits using (sha) where sha in (select sha from closure) and file in (select file from tree))",
)


def branches(m: Model):
    tenth = m.commits.filter("sha % 10 = 0").select("sha", "ts", (F.col("sha") - 2).alias("parent"))
    older = m.commits.select(F.col("sha").alias("parent"), F.col("ts").alias("then"))
    merged = tenth.join(older, "parent").filter("then < ts").select("sha", "parent")
    return m.parents.unionAll(merged).distinct()


def tips(m: Model):
    own = m.table("orders").filter((F.col("o_custkey") % 7 == 0) & (F.col("o_orderdate") <= F.lit(BASE).cast("timestamp_ntz")))
    return own.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("sha")).select("sha")


def reached(m: Model):
    commits = history.reachable(m.commits, branches(m), tips(m))
    return history.alive_changes(m.changes, commits, m.tree, BASE, BULK, dated_only=True)


@query("history_reachable", "select sha, file, round(age, 6) as age from rhistory", *REACHED, recursive=True)
def reachable(m):
    """Changes of the commits that the heads reach: none of a later commit or another branch."""
    return reached(m).select("sha", "file", F.round("age", 6).alias("age"))


@query(
    "cochange_reachable",
    "select a.file as src, b.file as dst, count(*) as raw, round(sum(exp(-a.age / 90.0)), 6) as decayed, epoch(max(a.ts))::bigint as last from rhistory a join rhistory b on a.sha = b.sha and a.file < b.file group by 1, 2",
    *REACHED,
    recursive=True,
)
def cochange_reachable(m):
    return history.cochange_pairs(reached(m)).withColumn("decayed", F.round("decayed", 6))


@query("recency_reachable", "select file, round(sum(exp(-age / 90.0)), 6) as recency, count(*) as freq from rhistory group by file", *REACHED, recursive=True)
def recency_reachable(m):
    return history.priors(reached(m)).select("file", F.round("recency", 6).alias("recency"), "freq")


def pages(m: Model):
    """Pages as a tree: a page's path is its address with an extension, its blob the hash of what it holds."""
    end = F.element_at(F.array(*map(F.lit, ("py", "md", "png", "yaml", "pyi"))), (F.col("page_id") % 5 + 1).cast("int"))
    held = m.table("pages").select(F.col("page_id").alias("file"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit("."), end).alias("path"), F.sha1("html").alias("blob"), F.col("html").cast("binary").alias("content"))
    return held.select("file", "path", "blob"), held.select("blob", "content")


@query("scan_blobs", "select sha1(html) as blob, md5(any_value(html)) as text from pages where html is not null group by 1")
def blobs(m):
    tree, held = pages(m)
    return logs.blob_texts(tree, held).select("blob", F.md5("text").alias("text"))


@query("scan_tree_texts", "select page_id as file, sha1(html) as blob, length(html) as n from pages where html is not null and page_id % 5 in (0, 1, 3)")
def tree_texts(m):
    """Paths with a text extension meet the blobs by name; a blob that several paths have is read once."""
    tree, held = pages(m)
    return logs.file_texts(tree, logs.blob_texts(tree, held)).select("file", "blob", F.length("text").alias("n"))


@query(
    "scan_instances",
    "select item_id as qid, string_agg(file::varchar, ',' order by file) as gold from benchmark join gold on qid = item_id where ('0x' || right(sha1(item_id::varchar), 1))::int % 2 = 0 group by 1",
)
def instances(m):
    found = logs.instances(m.table("benchmark").select(F.col("item_id").alias("qid")), m.gold, "dev")
    return found.select("qid", F.array_join(F.transform("gold", lambda x: x.cast("string")), ",").alias("gold"))


IMPORTS = """modules as (select file, replace(replace(dir, '/', '.'), '#', '_') || '.' || replace(name, ' ', '_') || '_' || file as module, path from tree),
sources as (select a.file, b.file as target from modules a join modules b on b.file in (a.file - 1, a.file - 2) where a.file % 4 <> 0)"""


@query("import_edges", "select file, target from sources", IMPORTS)
def import_edges(m):
    """Source texts are parsed, what they import is resolved to files: plain, from-imports and texts that can't be parsed."""
    name = lambda c: F.regexp_replace(F.translate(c, "#", "_"), "[^A-Za-z0-9_.]", "_")
    modules = m.tree.select("file", "path", F.concat_ws(".", name(F.translate("dir", "/", ".")), F.concat(name(F.col("name")), F.lit("_"), F.col("file").cast("string"))).alias("module"))
    known = modules.select((F.col("file") + 1).alias("file"), F.col("module").alias("one")), modules.select((F.col("file") + 2).alias("file"), F.col("module").alias("two"))
    said = modules.filter("file % 4 <> 0").join(known[0], "file", "left").join(known[1], "file", "left")
    first = F.when(F.col("one").isNotNull(), F.concat(F.lit("import "), "one", F.lit("\n")))
    second = F.when(F.col("two").isNotNull(), F.concat(F.lit("from "), "two", F.lit(" import thing, other\n")))
    broken = F.when(F.col("file") % 3 == 0, F.lit("def (:\n")).otherwise(F.lit("import os\n"))
    sources = said.select(F.col("file").cast("string").alias("path"), F.lit("").alias("package"), F.concat(F.coalesce(first, F.lit("")), F.coalesce(second, F.lit("")), broken).alias("source"))
    found = imports.parse_imports(sources).select(F.col("path").cast("long").alias("file"), "module")
    keyed = modules.select("file", "path", F.col("module").alias("key"))
    return imports.resolve_imports(found, imports.module_map(keyed))


@query("index_overview", "select file, path, total, degree from (select t.file, t.path, sum(raw)::bigint as total, coalesce(any_value(d.degree), 0)::bigint as degree from tree t join (select src as file, raw from pairs union all select dst, raw from pairs) p using (file) left join (select src as file, count(distinct dst) as degree from sboth group by 1) d using (file) group by 1, 2) order by total desc, path limit 40", SBOTH)
def stored(m):
    """An index is built, stored, listed, loaded again, and shown by its forty most involved files."""
    spark, root = m.spark, f"{shared_folder(m.spark)}/index-{uuid.uuid4().hex}"
    tree = m.tree.select("file", "path", F.col("file").cast("string").alias("blob"))
    blobs = m.texts.select(F.col("file").cast("string").alias("blob"), F.col("text").cast("binary").alias("content"))
    tables = index.build_index(m.commits, m.changes, m.parents, tree, blobs, m.static_edges, BASE, bulk=BULK)
    logs.save_snapshot(tables, root, "owner/name", "HEAD")
    repo, rev = logs.list_snapshots(spark, root).first()
    return index.overview(logs.load_snapshot(spark, root, repo, rev, list(index.TABLES)))
