import hashlib
from dataclasses import replace

from pyspark.sql import functions as F

from graphloom.plans import recipes, schemes
from graphloom.sources.tables import Model

SF = "/root/testdata/sf0.001"


def test_tables_of_recipes():
    assert {n: len(s) for n, s in recipes.SWEEPS.items()} == {"sweep1": 11, "sweep2": 9, "sweep3": 13, "sweep4": 10, "final": 4, "ablation": 25}
    assert len(recipes.GRID) + 2 == 28


def test_recipes_rank_every_issue(spark):
    context = recipes.Context(Model(spark, SF))
    quick = {n: replace(r, steps=1, bm_steps=None) for n, r in {"final": recipes.FINAL, "union": recipes.SWEEP_1["paths"], "sum": recipes.ABLATION["fuse_scoresum"], "conf": recipes.SWEEP_1["conf"], "spread": recipes.SWEEP_4["divers12"], "rec": recipes.SWEEP_1["recency"]}.items()}
    rows = context.sweep(quick).collect()
    issues = context.m.issues.count()
    for name, r in quick.items():
        mine = [x for x in rows if x.recipe == name]
        assert {x.qid for x in mine} == {x.qid for x in context.m.issues.collect()} and len(mine) <= issues * 100
        for q in range(3):
            ranks = sorted(x["rank"] for x in mine if x.qid == q)
            assert ranks == list(range(1, len(ranks) + 1))
            assert len({x.file for x in mine if x.qid == q}) == len(ranks)


def plain(name, c):
    """The schemes over Python lists, with a scorer that sorts by hash."""
    key = lambda x: hashlib.sha1(x.encode()).hexdigest()
    score = lambda a, n: sorted(a, key=key)[:n]
    once = lambda *lists: list(dict.fromkeys(x for a in lists for x in a))
    if name in ("base50", "base100"):
        head = c[: int(name[4:])]
        return once(score(head, 10), head)
    if name == "cascade":
        finalists = once(*(score(c[i : i + 25], 8) for i in range(0, 100, 25)))
        return once(score(finalists, 10), finalists, c[:100])
    if name == "window":
        carry = score(c[50:100], 10)
        carry = score(once(c[20:50], carry), 10)
        return once(score(once(c[:20], carry), 10), c[:100])
    if name == "refine2":
        first = score(c[:50], 10)
        return once(score(once(first, c[50:90]), 10), first, c[:100])
    if name == "twopass":
        a, b = score(c[:50], 10), score(c[50:100], 10)
        return once(score(once(a, b), 10), a, c[:100])
    first = score(c[:50], 10)
    best = once(first, c[:50])[:1]
    return once(best, score([x for x in c[:50] if x not in best], 6), first, c)


def test_schemes(spark):
    rows = [(i, [f"f{i}_{k}" for k in range(n)]) for i, n in enumerate([1, 7, 26, 60, 130])]
    by_hash = lambda a, n: F.slice(F.transform(F.array_sort(F.transform(a, lambda x: F.struct(F.sha1(x).alias("h"), x.alias("x")))), lambda s: s["x"]), 1, n)
    df = spark.createDataFrame(rows, "i int, c array<string>").select("i", *(f(by_hash, F.col("c")).alias(n) for n, f in schemes.SCHEMES.items()))
    for r in df.collect():
        for name in schemes.SCHEMES:
            assert r[name] == plain(name, rows[r.i][1]), (name, r.i)
