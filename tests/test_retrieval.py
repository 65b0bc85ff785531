"""Retrieval and propagation that meet in arrays, against plain loops and the plans over rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import graph, retrieval, scoring
from graphloom.plans import catalog
from graphloom.sources.tables import Model

SF = "/root/testdata/sf0.001"
TABLES = "part orders lineitem documents benchmark".split()


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables, some of them given, the others those of the smallest size."""

    def make(**given):
        for t in TABLES:
            given.get(t, spark.read.parquet(f"{SF}/{t}.parquet")).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        return str(tmp_path)

    return make


def random_texts(n):
    rnd = random.Random(7)
    return [(i, "".join(rnd.choice(["foo", "Bar", "x1", "HTTPServer", "_", " ", " ", "9", "é", ".", "the "]) for _ in range(rnd.randrange(40)))) for i in range(n)]


def test_counts_of_odd_texts_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(text, "BYTES", 200)
    rows = random_texts(200) + [(200, None), (201, ""), (202, "12a 3_b 4 fooBar_foo")]
    for cap in (None, 2):
        want = {}
        for i, t in rows:
            found = Counter(x for name in text.re.findall(text.IDENTIFIER, t or "") for x in text.terms_of(name))
            want |= {(i, x): n for x, n in sorted(found.items(), key=lambda y: (-y[1], y[0]))[:cap]}
        got = text.term_counts(spark.createDataFrame(rows, "file long, text string"), "file", cap).collect()
        assert {(r.file, r.term): r.f for r in got} == want and len(got) == len(want)


def test_terms_of_a_key_with_several_texts(spark):
    texts = spark.createDataFrame([(1, "foo bar"), (1, "foo"), (2, "bar")], "file long, text string")
    assert {tuple(r) for r in text.term_counts(texts, "file").collect()} == {(1, "foo", 2), (1, "bar", 1), (2, "bar", 1)}


def test_bm25_of_texts_is_that_of_counts(spark, monkeypatch):
    monkeypatch.setattr(scoring, "HELD", 50)
    monkeypatch.setattr(scoring, "COLLECTED", 20)
    texts = spark.createDataFrame(random_texts(120) + [(120, None)], "file long, text string").repartition(3)
    terms = retrieval.query_terms(spark.createDataFrame([(1, "foo x1"), (2, "server_http"), (3, "HTTPServer bar"), (4, "nothing")], "qid long, text string"))
    rows = lambda df: sorted(map(tuple, df.select("qid", "file", "score", "rank").collect()))
    got = rows(retrieval.bm25_texts(terms, texts, top=7))
    assert got and got == rows(retrieval.bm25(terms, text.term_counts(texts, "file"), top=7))


def test_identifiers_in_every_text(spark):
    """One that all texts have weighs less than nothing, and is found all the same."""
    texts = spark.createDataFrame([(1, "fooBar", "other"), (2, "fooBar x", "foobar"), (3, "fooBar", None)], "file long, text string, name string")
    got = {r.file: r.score for r in retrieval.identifier_search(spark.createDataFrame([(5, "fooBar")], "qid long, text string"), texts).collect()}
    assert got == {1: round(math.log(3 / 4), 6), 2: round(math.log(3 / 4) + 2, 6), 3: round(math.log(3 / 4), 6)}


@pytest.mark.parametrize("few", (64, 0))
def test_passages_in_texts(spark, monkeypatch, few):
    monkeypatch.setattr(text, "FEW", few)
    texts = spark.createDataFrame([(1, "xa b c d e f gx"), (2, "a b c d e"), (3, "unbroken"), (4, None), (5, "a b c d e f")], "file long, text string")
    said = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c"), (3, "nbroke"), (4, ""), (5, None), (6, "a b c d e f")], "qid long, needle string")
    assert {tuple(r) for r in text.holders(said, texts).collect()} == {(1, 1), (2, 1), (2, 2), (2, 5), (3, 3), (4, 1), (4, 2), (4, 3), (4, 5), (6, 1), (6, 5)}


def test_paths_against_all_pairs(spark):
    rnd = random.Random(3)
    words = ["red", "blue", "ring", "bolt", "fooBar", "a"]
    paths = {i: "/".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))) + f"_{i}.py" for i in range(150)}
    asks = {q: {rnd.choice(words).lower() for _ in range(3)} | {"none"} for q in range(40)}
    tree = spark.createDataFrame(list(paths.items()), "file long, path string")
    terms = spark.createDataFrame([(q, t) for q, ts in asks.items() for t in ts], "qid long, term string")
    want = set()
    for q, ts in asks.items():
        scored = []
        for f, p in paths.items():
            toks = set(text.terms_of(p.replace("/", "_").replace(".", "_")))
            if toks & ts:
                scored.append((-round(len(toks & ts) / (1 + math.log(1 + len(toks))), 6), f))
        want |= {(q, f, -s, r) for r, (s, f) in enumerate(sorted(scored)[:5], 1)}
    assert {(r.qid, r.file, r.score, r["rank"]) for r in retrieval.path_tokens(terms, tree, top=5).collect()} == want


def test_a_path_is_found_to_the_end_of_a_text(spark):
    tree = spark.createDataFrame([(1, "src/late.py"), (2, "src/early.py"), (3, "b.py"), (4, "x/c.py")], "file long, path string")
    said = "early.py " + "word " * 2_000 + "y" * 20_000 + " ./late.py a/b.py.py/x/c.py"
    got = retrieval.quoted_paths(spark.createDataFrame([(7, said)], "qid long, text string"), tree).orderBy("rank").collect()
    assert [r.file for r in got] == [2, 1]
    old = r"(?U)[\w./-]+?(?:[\w-]+/)*[\w-]+\.py"
    rnd = random.Random(5)
    odd = ["".join(rnd.choice(["a", "é", "-", "/", ".", ".py", ".py", " ", "b"]) for _ in range(rnd.randrange(25))) for _ in range(3_000)]
    both = spark.createDataFrame([(x,) for x in odd], "t string").select("t", F.regexp_extract_all("t", F.lit(old), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(retrieval.PATH), F.lit(0)).alias("b"))
    assert both.filter("a <> b").isEmpty()


@pytest.mark.parametrize("kind", ("long", "string"))
def test_propagation_over_several_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "BLOCK_EDGES", 30)
    monkeypatch.setattr(graph, "HELD", 25)
    rnd = random.Random(2)
    edges = [(rnd.randrange(40), 40 + rnd.randrange(30), rnd.random()) for _ in range(80)]
    rows = graph.row_normalized(spark.createDataFrame(edges, "src long, dst long, w double").groupBy("src", "dst").agg(F.sum("w").alias("w"))).select(F.col("src").cast(kind), F.col("dst").cast(kind), "w").persist()
    start = [(q, rnd.randrange(75), 0.25) for q in range(9) for _ in range(3)]
    seeds = spark.createDataFrame(start, "qid long, node long, s double").groupBy("qid", "node").agg(F.sum("s").alias("s")).select("qid", F.col("node").cast(kind), "s")
    out: dict = {}
    for r in rows.collect():
        out.setdefault(r.src, []).append((r.dst, r.w))
    want = p = {(r.qid, r.node): r.s for r in seeds.collect()}
    for _ in range(4):
        now = {k: 0.5 * v for k, v in want.items()}
        for (q, node), v in p.items():
            for dst, w in out.get(node, [(node, 1.0)]):
                now[q, dst] = now.get((q, dst), 0) + 0.5 * v * w
        p = now
    got = {(r.qid, r.node): r.p for r in graph.ppr(rows, seeds, steps=4).collect()}
    assert set(got) == set(p) and all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in p.items())


def test_blend_without_chains_is_scaled_as_in_sql(spark, tables):
    """No directory is small enough for a chain: all parts are in one."""
    import duckdb

    part = spark.read.parquet(f"{SF}/part.parquet").withColumns({"p_type": F.lit("one"), "p_brand": F.lit("place"), "p_size": F.lit(1).cast("int")})
    folder = tables(part=part)
    assert graph.dir_chain(Model(spark, folder).tree).isEmpty()
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = {(r.src, r.dst): r.w for r in catalog.QUERIES["layer_blend"](spark, folder).collect()}
    assert got and got == {(a, b): w for a, b, w in db.execute(f"select src, dst, w from ({catalog.ORACLE_SQL['layer_blend']})").fetchall()}


def test_localize_counts_all_terms_of_a_text(spark, tables):
    """The 2,500th term of a text finds it."""
    letters = [a + b + c for a in "bcdfghjklm" for b in "aeiou" for c in "bcdfghjklmnpqrstvwxyz"]
    words = [x + y for x in letters for y in ("o", "u", "ya")][:2_499]
    documents = spark.createDataFrame([(0, " ".join([*words * 2, "zzlast"])), (1, "other words")], "doc_id long, text string").withColumn("source", F.lit("src0"))
    folder = tables(documents=documents, benchmark=spark.createDataFrame([(1, "zzlast")], "item_id long, text string"))
    got = {r.file: r.lists for r in catalog.QUERIES["localize"](spark, folder).collect()}
    assert "bm:1" in got[0].split(",")
