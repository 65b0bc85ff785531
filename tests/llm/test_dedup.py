import hashlib
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from graphloom.llm import jaccard_join, neardup_vectors, repeats, shared
from graphloom.llm.components import components
from graphloom.llm.textkit import encode
from pyspark.sql import functions as F


def sets_of(rows, n):
    out = defaultdict(list)
    for i, t in rows:
        w = encode(t).lower().split()
        out[i].append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def smallest_reachable(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def expected_components(rows, rule=jaccard_join.CONTRACT):
    sets = {i: s[0] for i, s in sets_of(rows, rule.shingle).items() if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= rule.percent * len(sets[a] | sets[b])]
    return smallest_reachable(ids, links), sets, links


@pytest.mark.parametrize("block, rule", [(1024, jaccard_join.CONTRACT), (4, jaccard_join.CONTRACT), (4, jaccard_join.Rule())])
def test_jaccard_against_all_pairs(spark, make_docs, prose, odd_texts, block, rule, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    if block == 4:
        monkeypatch.setattr(jaccard_join, "MEMBERS", 3)
        monkeypatch.setattr(jaccard_join, "REST", 2)
    rows = prose + odd_texts
    label, sets, links = expected_components(rows, rule)
    assert len(links) > 10
    got = jaccard_join.jaccard_components(make_docs(rows), rule).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.component_id, r.n_shingles) == (label[r.doc_id], len(sets[r.doc_id])), r


def test_members_that_the_leader_does_not_link(spark, make_docs, monkeypatch):
    """A text that drifts word by word: neighbours link, the first and the last don't."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", 5)
    monkeypatch.setattr(jaccard_join, "REST", 3)
    words, rows = [f"w{k}" for k in range(120)], []
    for i in range(60):
        if i % 2 == 0:
            words[(i * 3) % 120] = f"x{i}"
        rows.append((500 - i, " ".join(words) + f" y{i}"))
    rows += [(700, rows[0][1]), (701, rows[50][1])]
    label, _, links = expected_components(rows)
    assert len(set(label.values())) == 1 and len(links) < 62 * 61 / 4
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(make_docs(rows), jaccard_join.CONTRACT).collect()} == label


def test_jaccard_over_many_shards(spark, make_docs, prose, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHARD_DOCS", 9)
    label, _, _ = expected_components(prose)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(make_docs(prose), jaccard_join.CONTRACT).collect()} == label
    assert jaccard_join.jaccard_components(make_docs([])).count() == 0


def test_bounds_of_large_sets(spark, make_docs):
    """Large copies with edits link at 80 percent although their bounds have more parts."""
    r = np.random.default_rng(8)
    base = [f"w{k}" for k in r.integers(0, 4000, 5200)]
    rows = []
    for i, edits in enumerate((0, 40, 120, 420, 5200)):
        w = list(base)
        for k in r.choice(len(w), edits, replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(10 + i, " ".join(base[: 990 + 5 * i])) for i in range(5)]
    label, _, links = expected_components(rows, jaccard_join.Rule())
    assert len(links) > 8
    assert {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(make_docs(rows)).collect()} == label


def _rows(sets, common):
    """Rows of one element for ``_filter``: block, id, size, place and bounds of each set."""
    bounds = [jaccard_join._parts(x).tobytes() for x in sets]
    return [(0, i, len(x), int(np.flatnonzero(np.sort(x) == common)[0]), b) for i, (x, b) in enumerate(zip(sets, bounds))]


@pytest.mark.parametrize("n", [300, 810, 980, 3900])
def test_unrelated_sets_do_not_tie(n):
    """Sets that share an element only: what ties them by chance grows with the square of a table."""
    random, common = np.random.default_rng(n), np.uint64(5)
    sets = [np.append(random.integers(6, 2**64, n - 1 - i % 9, dtype=np.uint64), common) for i in range(200)]
    assert jaccard_join._filter(jaccard_join.Rule(), (5, 0, 0), _rows(sets, common)) == []


@pytest.mark.parametrize("others", [0, 1, 5, 60])
def test_linked_sets_of_other_sizes_tie(others):
    """Linked sets whose bits are for different numbers of parts, among few groups and among many."""
    random, common = np.random.default_rng(others), np.uint64(5)
    large = np.append(random.integers(6, 2**64, 859, dtype=np.uint64), common)
    small = np.append(large[:780], common)
    assert jaccard_join._parts_for(len(large)) > jaccard_join._parts_for(len(small))
    sets = [large, small] + [np.append(random.integers(6, 2**64, 700 + 9 * i, dtype=np.uint64), common) for i in range(others)]
    assert jaccard_join._filter(jaccard_join.Rule(), (5, 0, 0), _rows(sets, common)) == [(1, 0)]


def test_bits_of_a_group_that_members_share():
    """Parts where members differ say nothing; a set that is near one member only passes."""
    random = np.random.default_rng(3)
    a, b = (random.integers(6, 2**64, 600, dtype=np.uint64) for _ in range(2))
    x, y = jaccard_join._parts(a), jaccard_join._parts(b)
    group, rule = x.tobytes() + (~(x ^ y)).tobytes(), jaccard_join.Rule()
    for one in (x, y):
        assert jaccard_join._filter(rule, (5, 0, 0), [(0, 1, 600, 3, group), (0, 2, 600, 3, one.tobytes())]) == [(2, 1)]
        assert jaccard_join._filter(rule, (5, 0, 0), [(0, 1, 600, 3, x.tobytes()), (0, 2, 600, 3, y.tobytes())]) == []


def test_shuffles_go_with_the_query_that_made_them(spark):
    """What a written table was shuffled through leaves the disk at once, and the setting stays the caller's."""
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    for k in range(3):
        table = shared.materialise(spark.range(5000).repartition(4 + k, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
        assert len(table.collect()) == 7
    deadline = time.monotonic() + 20
    while files() > before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert files() <= before
    assert spark.conf.get(shared.CLEANUP, None) in (None, "false")


def removed(rows, window):
    words = [(i, encode(t).split()) for i, t in rows]
    first: dict = {}
    for i, w in words:
        for s in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("shard", [4096, 7])
def test_repeats_against_all_windows(spark, make_docs, prose, odd_texts, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_DOCS", shard)
    rows = prose + odd_texts
    expected = removed(rows, repeats.WINDOW)
    assert sum(1 for x in expected if x[2]) > 10
    got = repeats.remove_repeats(make_docs(rows), carry=("source", "shard")).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    assert {r.source for r in got} == {"s"} and {r["shard"] for r in got} == {"x"}
    assert repeats.remove_repeats(make_docs([])).count() == 0


def test_windows_choose_equal_phrases():
    random = np.random.default_rng(3)
    shared = random.integers(0, 2**63, 50).astype(np.uint64)
    for _ in range(20):
        a = np.concatenate((random.integers(0, 2**63, 30).astype(np.uint64), shared, random.integers(0, 2**63, 9).astype(np.uint64)))
        b = np.concatenate((random.integers(0, 2**63, 7).astype(np.uint64), shared))
        phrases = lambda x: {tuple(x[i : i + repeats.PHRASE].tolist()) for i in repeats.chosen(x)}
        assert phrases(a) & phrases(b)


def test_occurrences_of_an_automaton():
    ids = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    ids[200:205] = ids[40:45]
    packed = np.frombuffer(ids[40:45].astype("<u4").tobytes(), "V20")
    assert repeats.occurrences(repeats.automaton(packed), ids).tolist() == [40, 200]
    assert repeats.automaton(np.empty(0, "V20")) is None


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 5) for i, v in rows], "vec_id long, embedding array<float>, filters int")


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK", block)
    random = np.random.default_rng(2)
    centres = random.normal(size=(12, 64))
    x = np.concatenate([c + random.normal(size=(20, 64)) * s for c, s in zip(centres, np.linspace(0.02, 0.25, 12))] + [random.normal(size=(60, 64))]).astype(np.float32)
    x[5], x[6] = x[4], 3 * x[4]
    rows = [(100 + i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1, None), (2, [0.0] * 64), (3, [float("nan")] * 64), (4, [float("inf")] + [1.0] * 63), (5, [None] + [1.0] * 63), (None, x[0].tolist()), (100, x[0].tolist())]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    label = smallest_reachable(range(len(x)), np.argwhere(linked).tolist())
    got = {r.vec_id: r for r in neardup_vectors.neardup_vectors(vectors(spark, rows + odd)).collect()}
    assert len(got) == len(rows) + 6
    exact = sum(got[100 + i].n_links == linked[i].sum() for i in range(len(x)))
    assert all(got[100 + i].n_links <= linked[i].sum() for i in range(len(x))) and exact >= 0.97 * len(x)
    assert sum(got[100 + i].component_id == 100 + label[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1, 6))
    assert (got[None].component_id, got[None].kept) == (None, False)


def test_vectors_of_every_length_link(spark):
    """One stray longer vector takes no links from the others, and those of each length have theirs."""
    random = np.random.default_rng(6)
    rows = []
    for dim in (1, 2, 8, 64):
        for k in range(5):
            v = random.normal(size=dim)
            rows += [(100 * dim + 2 * k, v.tolist()), (100 * dim + 2 * k + 1, (v + 1e-3 * np.abs(v)).tolist())]
    rows += [(9000, [1.0] * 65), (9001, [1.0] * 66), (9002, [2.0] + [1.0] * 65), (9003, [1.0] * 65)]
    got = {r.vec_id: r for r in neardup_vectors.neardup_vectors(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, v in rows:
        near = [j for j, w in rows if j != i and len(w) == len(v) and np.dot(v, w) >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w)]
        assert got[i].n_links == len(near), (i, got[i], near)
        assert got[i].kept == (got[i].component_id == i)
    stray = neardup_vectors.neardup_vectors(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in stray} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_no_vectors(spark):
    assert neardup_vectors.neardup_vectors(vectors(spark, [])).count() == 0
    assert neardup_vectors.neardup_vectors(vectors(spark, [(1, None)])).count() == 1


@pytest.mark.parametrize(("size", "blocks"), [(256, 2), (1024, 2), (4096, 2), (256, 3), (1024, 3)])
def test_recall_of_the_filters(size, blocks):
    """Pairs at the least similarity that counts share a filter nearly always."""
    random = np.random.default_rng(9)
    a = random.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = random.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * side
    code = neardup_vectors.CapCode.of(64, size, blocks)
    met = [len(np.intersect1d(f, g)) > 0 for f, g in zip(code.decode(a), code.decode(b))]
    assert np.mean(met) >= (0.97 if blocks == 2 else 0.94)


def test_doubles_keep_their_precision(spark):
    """A pair a hair above the bound, and one a hair below it, which floats would turn round; lengths beyond a float's."""
    v, rows = np.zeros((4, 64)), []
    for k, cosine in enumerate((0.95 + 1e-9, 0.95 - 1e-9)):
        v[2 * k, 2 * k] = 1
        v[2 * k + 1, 2 * k : 2 * k + 2] = cosine, np.sqrt(1 - cosine**2)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(10, [1e200] * 64), (11, [2e200] * 64), (12, [1e-200] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup_vectors.neardup_vectors(table).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 10: (2, 10), 11: (2, 10), 12: (2, 10)}


def test_a_hot_vector(spark):
    """Most rows are one vector; others are near it, and some are near copies of each other."""
    random = np.random.default_rng(8)
    hot = random.normal(size=64).astype(np.float32)
    near = hot + random.normal(size=(30, 64)).astype(np.float32) * 0.01
    rows = [(i, hot.tolist()) for i in range(2000)] + [(3000 + i, v.tolist()) for i, v in enumerate(near)] + [(4000 + i, random.normal(size=64).tolist()) for i in range(40)]
    random.shuffle(rows)
    got = {int(r.vec_id): (r.n_links, r.component_id, r.kept) for r in neardup_vectors.neardup_vectors(vectors(spark, [(int(i), v) for i, v in rows])).collect()}
    assert all(got[i] == (2029, 0, i == 0) for i in [*range(2000), *range(3000, 3030)])
    assert all(got[4000 + i] == (0, 4000 + i, True) for i in range(40))


def test_decoding_finds_every_filter():
    random = np.random.default_rng(4)
    unit = random.normal(size=(30, 10))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    code = neardup_vectors.CapCode.of(10, 32)
    turned = unit @ code.rotation
    s = (turned[:, :5] @ code.codes[0].T)[:, :, None] + (turned[:, 5:] @ code.codes[1].T)[:, None, :]
    for found, scores in zip(code.decode(unit), s):
        above = np.flatnonzero(scores.ravel() >= code.height * np.sqrt(2))
        assert set(above) <= set(found) and (len(above) < neardup_vectors.FEWEST[1] or set(above) == set(found))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (None, 3), (7000, 6000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[k] == 1000 for k in range(1000, 1100))
    assert got[7000] == got[6000] == 6000 and 5000 not in got
