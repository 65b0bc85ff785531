"""The engine's tables, projected from the driver's relational ones.

An order is a commit, its distinct parts are the changed files, a part is a file of
the tree, a document is the text of the file with the same number, a benchmark item
is an issue. ``Model`` keeps each as a lazy DataFrame; nothing is read before use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from graphloom.functions.text import holders

#: Revision date, most files of a commit that counts, largest part that is in the tree.
BASE, BULK, TREE_SIZE = "2000-01-01 00:00:00", 7, 25


@dataclass
class Model:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small result under a name: made once, then read."""
        if name not in self.__dict__:
            self.__dict__[name] = make().persist()
        return self.__dict__[name]

    @cached_property
    def commits(self) -> DataFrame:
        """sha, ts"""
        return self.table("orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))

    @cached_property
    def changes(self) -> DataFrame:
        """sha, file; a file counts once per commit"""
        return self.table("lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file")).distinct()

    @cached_property
    def files(self) -> DataFrame:
        """file, path, dir, name of every part, in the tree or not"""
        where = F.concat_ws("/", "p_type", "p_brand")
        return self.table("part").select(
            F.col("p_partkey").alias("file"),
            F.concat(where, F.lit("/"), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"),
            where.alias("dir"),
            F.col("p_name").alias("name"),
            "p_size",
        )

    @cached_property
    def tree(self) -> DataFrame:
        """file, path, dir, name of the revision"""
        return self.files.filter(F.col("p_size") <= TREE_SIZE).drop("p_size")

    @cached_property
    def parents(self) -> DataFrame:
        """sha, parent: the customer's previous order"""
        w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.table("orders").select(F.col("o_orderkey").alias("sha"), F.lag("o_orderkey").over(w).alias("parent")).filter("parent is not null")

    @cached_property
    def static_edges(self) -> DataFrame:
        """src < dst: files that one supplier sent in one order, both in the tree"""
        sent = self.table("lineitem").select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("file")).join(self.tree.select("file"), "file", "left_semi")
        a, b = sent.alias("a"), sent.alias("b")
        on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") == F.col("b.l_suppkey")) & (F.col("a.file") < F.col("b.file"))
        return a.join(b, on).select(F.col("a.file").alias("src"), F.col("b.file").alias("dst")).distinct()

    @cached_property
    def texts(self) -> DataFrame:
        """file, text"""
        return self.table("documents").select(F.col("doc_id").alias("file"), "text")

    @cached_property
    def issues(self) -> DataFrame:
        """qid, text"""
        return self.table("benchmark").select(F.col("item_id").alias("qid"), "text")

    @cached_property
    def gold(self) -> DataFrame:
        """qid, file: documents that hold 60 characters of the issue"""
        return holders(self.issues.select("qid", F.substring("text", 20, 60).alias("needle")), self.texts)


#: The same projections for DuckDB: common table expressions to put after ``with``.
SQL = f"""
commits as (select o_orderkey as sha, o_orderdate as ts from orders),
changes as (select distinct l_orderkey as sha, l_partkey as file from lineitem),
files as (select p_partkey as file, p_type || '/' || p_brand || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.py' as path,
  p_type || '/' || p_brand as dir, p_name as name, p_size from part),
tree as (select file, path, dir, name from files where p_size <= {TREE_SIZE}),
parents as (select * from (select o_orderkey as sha, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as parent from orders) where parent is not null),
small as (select * from changes where sha in (select sha from changes group by sha having count(*) <= {BULK})),
history as (select sha, ts, file, greatest(0, (epoch(timestamp '{BASE}') - epoch(ts)) / 86400.0) as age from small join commits using (sha) where ts <= timestamp '{BASE}'),
alive as (select * from history where file in (select file from tree)),
pairs as (select a.file as src, b.file as dst, count(*) as raw, sum(exp(-a.age / 90.0)) as decayed, max(a.ts) as last
  from alive a join alive b on a.sha = b.sha and a.file < b.file group by 1, 2),
sent as (select l_orderkey, l_suppkey, l_partkey as file from lineitem where l_partkey in (select file from tree)),
static as (select distinct a.file as src, b.file as dst from sent a join sent b on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey and a.file < b.file),
texts as (select doc_id as file, text from documents),
issues as (select item_id as qid, text from benchmark),
gold as (select qid, file from issues i join texts t on contains(t.text, substr(i.text, 20, 60)))
"""
