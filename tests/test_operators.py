"""Small fixtures worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import stats, text
from graphloom.operators import evaluation, fusion, graph, history, imports, retrieval
from graphloom.sources import logs
from graphloom.sources.tables import Model
from graphloom.streaming import pairs as stream_pairs

BASE = "2000-01-01 00:00:00"


def changes(spark, rows):
    return spark.createDataFrame(rows, "sha string, file string")


def commits(spark, rows):
    return spark.createDataFrame(rows, "sha string, day string").select("sha", F.to_timestamp_ntz("day").alias("ts"))


def files(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file string")


def one(df):
    return {tuple(r)[:-1]: tuple(r)[-1] for r in df.collect()}


def test_decay_and_counts(spark):
    ch = changes(spark, [("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("2", "b")])
    co = commits(spark, [("1", "2000-01-01 00:00:00"), ("2", "1999-10-03 00:00:00")])
    live = history.alive_changes(ch, co, files(spark, "a", "b", "c"), BASE, 30)
    got = {(r.src, r.dst): (r.raw, r.decayed) for r in history.cochange_pairs(live).collect()}
    assert got[("a", "b")][0] == 2 and math.isclose(got[("a", "b")][1], 1 + math.exp(-1))
    assert got[("a", "c")] == (1, 1.0) and got[("b", "c")] == (1, 1.0)


def test_later_commit_weighs_one(spark):
    age = commits(spark, [("1", "2000-01-11 00:00:00")]).select(history.age_days(F.col("ts"), BASE)).first()[0]
    assert age == 0


def test_bulk_commits_and_dead_files_go(spark):
    rows = [("big", f"f{i}") for i in range(31)] + [("ok", f"f{i}") for i in range(30)] + [("two", "f1"), ("two", "gone")]
    kept = history.bulk_filter(changes(spark, rows), 30)
    assert {r.sha for r in kept.collect()} == {"ok", "two"}
    co = commits(spark, [("ok", "1999-01-01 00:00:00"), ("two", "1999-01-01 00:00:00")])
    live = history.alive_changes(changes(spark, [("two", "f1"), ("two", "gone")]), co, files(spark, "f1"), BASE, 30)
    assert history.cochange_pairs(live).count() == 0


def test_ancestors_include_the_base(spark):
    parents = spark.createDataFrame([(i, i - 1) for i in range(1, 150)], "sha long, parent long")
    got = history.ancestors(parents, spark.createDataFrame([(149,), (3,)], "sha long"))
    assert got.filter("base = 149").count() == 150 and got.filter("base = 3").count() == 4


def test_mix_keeps_the_share_of_one_layer(spark):
    s = spark.createDataFrame([("x", "y", 1.0)], "src string, dst string, w double")
    t = spark.createDataFrame([("u", "v", 1.0)], "src string, dst string, w double")
    assert one(graph.mix_rows(s, t, 0.25)) == {("x", "y"): 0.25, ("u", "v"): 0.75}
    assert one(graph.mix_rows(s, t, 1)) == {("x", "y"): 1.0} and one(graph.mix_rows(s, t, 0)) == {("u", "v"): 1.0}


def test_propagation_against_plain_loops(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "d", 1.0)]
    rows = graph.row_normalized(spark.createDataFrame(edges, "src string, dst string, w double"))
    seeds = spark.createDataFrame([(1, "a", 0.5), (1, "alone", 0.5), (2, "c", 1.0)], "qid int, node string, s double")
    got = {(r.qid, r.node): r.p for r in graph.ppr(rows, seeds, steps=4).collect()}
    out: dict = {}
    for r in rows.collect():
        out.setdefault(r.src, []).append((r.dst, r.w))
    for q, start in ((1, {"a": 0.5, "alone": 0.5}), (2, {"c": 1.0})):
        p = dict(start)
        for _ in range(4):
            nxt: dict = {}
            for node, v in p.items():
                for dst, w in out.get(node, [(node, 1.0)]):
                    nxt[dst] = nxt.get(dst, 0) + 0.5 * v * w
            for node, v in start.items():
                nxt[node] = nxt.get(node, 0) + 0.5 * v
            p = nxt
        assert {n for (k, n) in got if k == q} == set(p)
        assert all(math.isclose(got[(q, n)], v, abs_tol=1e-12) for n, v in p.items())
    assert math.isclose(got[(1, "alone")], 0.5)


def test_subtokens_and_identifiers(spark):
    df = spark.createDataFrame([("HTTPServerError_x2Y",), ("see parse_url and When or `lib/foo_bar.py`",)], "t string")
    parts = [[x for x in r[0] if len(x) > 1] for r in df.select(text.subtokens(F.col("t"))).collect()]
    assert parts[0] == ["http", "server", "error", "x2", "httpservererror_x2y"]
    assert set(df.select(text.code_identifiers(F.col("t"))).collect()[1][0]) == {"parse_url", "foo_bar"}


def test_terms_are_counted_to_the_end_of_a_text(spark):
    texts = spark.createDataFrame([(1, "early " + "- " * 300_000 + "late early")], "file long, text string")
    assert {tuple(r) for r in text.term_counts(texts, "file").collect()} == {(1, "early", 2), (1, "late", 1)}


def test_query_terms_count_once(spark):
    tf = spark.createDataFrame([(1, "foo", 2), (2, "bar", 1)], "file int, term string, f long")
    ask = spark.createDataFrame([(1, "foo foo"), (2, "foo")], "qid int, text string")
    got = {r.qid: r.score for r in retrieval.bm25(retrieval.query_terms(ask), tf).collect()}
    assert got[1] == got[2] > 0


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid int, file string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "z")], "qid int, file string")
    r = evaluation.evaluate(ranking, gold).first()
    assert (r.r1, r.r5, r.ap) == (0, 0.5, 0.25)
    assert evaluation.strict(ranking, gold, (5,)).first().acc5 == 0


def test_demotion(spark):
    paths = ["tests/a.py", "Docs/b.md", "docs/c.md", "src/latest.py"]
    df = spark.createDataFrame([(1, p, i + 1) for i, p in enumerate(paths)], "qid int, path string, rank int")
    assert [r.path for r in fusion.demote(df, fusion.is_aux(F.col("path"))).orderBy("rank").collect()] == ["Docs/b.md", "tests/a.py", "docs/c.md", "src/latest.py"]


def test_sessions_merge_at_the_gap(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 3600, 2), (1, 7201, 3)], "user_id int, s long, event_id int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.session for r in history.sessions(df, 3600).orderBy("s").collect()] == [0, 0, 1]


def test_stamps_shorter_than_the_cap_stay(spark):
    ch = changes(spark, [(str(i), f) for i in range(3) for f in "ab"])
    co = commits(spark, [(str(i), f"1999-01-0{i + 1} 00:00:00") for i in range(3)])
    live = history.alive_changes(ch, co, files(spark, "a", "b"), BASE, 30)
    stamps = history.edge_stamps(live, history.cochange_pairs(live))
    assert len(stamps.first().stamps) == 3
    assert len(history.edge_stamps(live, history.cochange_pairs(live), cap=2).first().stamps) == 2


@pytest.mark.parametrize("a, b, p", [(35, 15, 0.00660), (34, 4, 6.04e-7), (24, 10, 0.0243), (0, 0, 1.0), (900, 850, None)])
def test_mcnemar(spark, a, b, p):
    got = spark.range(1).select(stats.mcnemar(F.lit(a), F.lit(b))).first()[0]
    exact = 1.0 if a + b == 0 else min(1.0, 2 * sum(math.comb(a + b, j) for j in range(min(a, b) + 1)) / 2 ** (a + b))
    assert math.isclose(got, exact, rel_tol=1e-9)
    assert p is None or math.isclose(got, p, rel_tol=5e-3)


def test_medians_and_quantiles(spark):
    df = spark.range(1).select(stats.upper_median(F.array(F.lit(0.1), F.lit(0.2))).alias("m"), stats.index_quantile(F.array(*map(F.lit, range(10))), 0.9).alias("q"))
    assert tuple(df.first()) == (0.2, 9)


def test_reply_and_backfill(spark):
    cands = F.array(*map(F.lit, "abc"))
    parsed = fusion.parse_reply(F.lit('x ["b","zz","b"," a "] y'), cands)
    bad = fusion.parse_reply(F.lit("no list"), cands)
    r = spark.range(1).select(parsed.alias("p"), fusion.backfill(parsed, cands).alias("f"), bad.alias("b")).first()
    assert (r.p, r.f, r.b) == (["b", "a"], ["b", "a", "c"], ["a", "b", "c"])  # an unreadable reply leaves the order as it is


def test_imports():
    assert imports.imported("import os, a.b\nfrom . import x\nfrom ..up import y\nfrom z import q", "pkg.sub") == ["a.b", "os", "pkg.sub.x", "pkg.up", "z"]
    assert imports.imported("print 'old'\nfrom .m import a\nimport b, c.d", "p") == ["b", "c.d", "m"]
    assert imports.imported(None, "") == []


def test_import_resolution_takes_the_longest_prefix(spark):
    keyed = spark.createDataFrame([("pkg.sub.mod", 1, "pkg/sub/mod.py"), ("pkg", 2, "pkg/__init__.py"), ("pkg", 3, "src/pkg.py")], "key string, file int, path string")
    asks = spark.createDataFrame([(9, "pkg.sub.mod.name"), (9, "pkg.other"), (1, "pkg.sub.mod"), (9, "none.at.all")], "file int, module string")
    assert {tuple(r) for r in imports.resolve_imports(asks, imports.module_map(keyed)).collect()} == {(9, 1), (9, 2)}


def test_import_parsing_runs_in_batches(spark):
    df = spark.createDataFrame([("a.py", "pkg", "import x\n"), ("b.py", "", None), ("c.py", None, "from y import z")], "path string, package string, source string")
    assert {tuple(r) for r in imports.parse_imports(df).collect()} == {("a.py", "x"), ("c.py", "y")}


def test_gold_from_patch_and_renames(spark):
    df = spark.createDataFrame([("diff --git a/x.py b/y.py\n+1\ndiff --git a/q.py b/b.py\n", "src/{old => new}/a.py"), ("", "a.py => b.py")], "patch string, path string")
    rows = df.select(evaluation.gold_from_patch(F.col("patch")), text.clean_rename(F.col("path"))).collect()
    assert [tuple(r) for r in rows] == [(["b.py", "y.py"], "src/new/a.py"), ([], "b.py")]


def test_gold_of_passages_with_few_words(spark, tmp_path):
    """Long compounds, no spaces at all, characters of four bytes, and passages shorter than a gram: as contains() says."""
    head = "x" * 19
    asked = [head + "Donaudampfschifffahrt gesellschaft kapitaen " + "m" * 40, head + "语言没有空格" * 20, head + "🙂é" * 40, head + "short one", head, "tiny", head + "a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d"]
    held = [t[15:] + " and more" for t in asked] + ["nothing", "", None, "short on", "before short one after"]
    spark.createDataFrame(list(enumerate([*asked, None])), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(held)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in Model(spark, str(tmp_path)).gold.collect()}
    assert got == {(q, d) for q, a in enumerate(asked) for d, h in enumerate(held) if h is not None and a[19:79] in h}


def test_history_log(spark):
    lines = ["\x01s1\t100", "1\t0\ta.py", "2\t1\tsrc/{x => y}/b.py", "1\t1\treadme.md", "", "\x01s2\t200", *[f"1\t1\tf{i}.py" for i in range(31)]]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    co, ch = logs.history_log(df)
    assert [tuple(r) for r in co.collect()] == [("s1", 100)]
    assert {r.file for r in ch.collect()} == {"a.py", "src/y/b.py"}


def test_output_can_be_resumed(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.range(5).withColumnRenamed("id", "key")
    assert logs.append_unfinished(rows.filter("key < 3"), out, "key") == 3
    assert logs.append_unfinished(rows, out, "key") == 2
    assert spark.read.parquet(out).count() == 5


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}"
    logs.save_snapshot({"pairs": spark.range(3)}, root, "r", "1")
    assert logs.load_snapshot(spark, root, "r", "1", ["pairs"])["pairs"].count() == 3
    assert logs.load_snapshot(spark, root, "r", "2", ["pairs"]) is None
    assert logs.content_hash(spark.range(3), "id") != logs.content_hash(spark.range(4), "id")


def test_malformed_lines_are_skipped(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in logs.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a int").collect()) == [1, 2]


def test_stream_adds_up_and_replays_once(spark, tmp_path):
    ch = changes(spark, [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")])
    co = commits(spark, [("1", "1999-12-31 00:00:00"), ("2", "1999-06-01 00:00:00")])
    tree = files(spark, "a", "b")
    state = f"file://{tmp_path}/state"
    for n, sha in enumerate("12"):
        for _ in range(2):  # a replayed batch overwrites itself
            stream_pairs.batch_pairs(co.filter(F.col("sha") == sha), ch, tree, "1995-01-01 00:00:00", 30).write.mode("overwrite").parquet(f"{state}/batch={n}")
    got = stream_pairs.current(spark, state, "1995-01-01 00:00:00", BASE).first()
    want = history.cochange_pairs(history.alive_changes(ch, co, tree, BASE, 30)).first()
    assert got.raw == want.raw == 2 and math.isclose(got.decayed, want.decayed, rel_tol=1e-9)
    stream_pairs.compact(spark, state, f"file://{tmp_path}/small")
    assert stream_pairs.current(spark, f"file://{tmp_path}/small", "1995-01-01 00:00:00", BASE).first().raw == 2


def test_quartiles_keep_ties_low(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 1, 1, 5, 6, 7, 8]], "v int")
    got = sorted((r.v, r.bucket) for r in evaluation.quartile_buckets(df, "v").collect())
    assert got == [(1, 1)] * 4 + [(5, 2), (6, 3), (7, 3), (8, 4)]


def test_text_extensions():
    from graphloom.sources.logs import TEXT_EXTENSIONS

    assert sorted(TEXT_EXTENSIONS) == sorted("cfg ini md py rst toml txt yaml yml".split())


def test_ancestry_leaves_out_later_and_other_commits(spark):
    """1 - 2 - 4 (merge of 2 and 3) - 5 and a branch 2 - 6; the head is 4. A cycle ends too."""
    parents = spark.createDataFrame([(2, 1), (4, 2), (4, 3), (3, 1), (5, 4), (6, 2), (1, None)], "sha long, parent long")
    head = spark.createDataFrame([(4,)], "sha long")
    assert {r.sha for r in history.ancestors(parents, head).collect()} == {1, 2, 3, 4}
    commits = spark.createDataFrame([(i, i) for i in range(1, 7)], "sha long, ts long")
    assert {r.sha for r in history.reachable(commits, parents, head).collect()} == {1, 2, 3, 4}
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 130)], "sha long, parent long")
    assert history.ancestors(chain, spark.createDataFrame([(100,), (7,)], "sha long")).count() == 101 + 8
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "sha long, parent long")
    assert {r.sha for r in history.ancestors(loop, spark.createDataFrame([(1,)], "sha long")).collect()} == {1, 2, 3}


def test_blobs_are_cut_and_made_valid(spark):
    from graphloom.sources import logs

    tree = spark.createDataFrame([(1, "a.py", "x"), (2, "b.py", "x"), (3, "c.png", "y"), (4, "d.md", "z")], "file long, path string, blob string")
    blobs = spark.createDataFrame([("x", b"abc\xff\xc3\xa9def"), ("x", b"abc\xff\xc3\xa9def"), ("y", b"pic"), ("w", b"not in the tree")], "blob string, content binary")
    texts = logs.blob_texts(tree, blobs, most=6)
    assert {(r.blob, r.text) for r in texts.collect()} == {("x", "abc�é"), ("y", "pic")}
    assert {(r.file, r.text) for r in logs.file_texts(tree, texts).collect()} == {(1, "abc�é"), (2, "abc�é")}


def test_index_is_stored_listed_and_replaced(spark, tmp_path):
    from graphloom.sources import logs

    root = f"file://{tmp_path}/indexes"
    assert logs.list_snapshots(spark, root).count() == 0
    for rev, n in (("v1", 3), ("v2", 4), ("v1", 5)):
        logs.save_snapshot({"files": spark.range(n), "pairs": spark.range(2)}, root, "owner/name", rev)
    assert [tuple(r) for r in logs.list_snapshots(spark, root).collect()] == [("owner/name", "v1"), ("owner/name", "v2")]
    assert logs.load_snapshot(spark, root, "owner/name", "v1", ["files"])["files"].count() == 5
    assert logs.load_snapshot(spark, root, "owner/name", "v3", ["files"]) is None


def test_requests_are_checked():
    import pytest
    from graphloom.operators import checks

    assert [checks.clamped(d) for d in (None, 0, 3, 55, 999)] == [50, 50, 10, 55, 100]
    assert checks.checked_revision(None) == "HEAD" and checks.checked_revision("v1.2~3^-x/y_z") == "v1.2~3^-x/y_z"
    for bad in ("a b", "--", "$(x)", "a;b"):
        with pytest.raises(ValueError):
            checks.checked_revision(bad)
    with pytest.raises(ValueError):
        checks.checked_issue("  short   ")
    assert checks.checked_issue(" long enough text ") == "long enough text"


def test_log_headers_carry_over_runs(spark, monkeypatch):
    from graphloom.sources import logs

    monkeypatch.setattr(logs, "RUN_LINES", 2)
    lines = ["\x01a\t10", "1\t1\tx.py", "1\t1\ty.py", "1\t0\tz.md", "", "\x01b\t20", "2\t2\tx.py", "2\t2\tw.py", "3\t1\tv.py"]
    commits, changes = logs.history_log(spark.createDataFrame(list(enumerate(lines)), "n long, value string"))
    assert {tuple(r) for r in commits.collect()} == {("a", 10), ("b", 20)}
    assert {tuple(r) for r in changes.collect()} == {("a", "x.py"), ("a", "y.py"), ("b", "x.py"), ("b", "w.py"), ("b", "v.py")}
