import random

import numpy as np
import pytest
from graphloom.llm import language, quality, toxicity
from graphloom.llm.shared import fold
from pyspark.sql import functions as F

EN = "the of and to in is that was for it with as his on be at by this had not are but from or have an they which one you".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split()
FR = "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec leur été mais".split()


def sentence(words, n, r):
    return " ".join(r.choice(words) for _ in range(n))


def test_languages(spark, odd_texts):
    r = random.Random(5)
    rows = [(i, sentence(w, r.randint(3, 60), r), lang) for i in range(100, 400) for lang, w in [r.choice([("en", EN), ("de", DE), ("fr", FR)])]]
    rows += [(i, t, None) for i, t in odd_texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, fold(F.col("doc_id"), 4) != 2)
    got = {x.doc_id: x for x in language.predict(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if lang]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3))
    assert all(0 <= x.score <= 1 for x in got.values())
    assert np.mean([got[i].rejected for i, _ in held]) < 0.01


def test_languages_without_training(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = language.predict(docs, language.train(docs)).collect()
    assert {x.lang_pred for x in got} == {"und"} and all(x.rejected for x in got)
    empty = docs.filter("doc_id < 0")
    assert language.predict(empty, language.train(empty)).count() == 0


def test_several_centroids_per_language():
    r = random.Random(1)
    a, b = ["zug", "bahn", "gleis"], ["koch", "topf", "salz"]
    texts = [sentence(a if i % 2 else b, 20, r) for i in range(40)] + [sentence(EN, 20, r) for _ in range(40)]
    model = language.fit(["de"] * 40 + ["en"] * 40, language.matrix(texts))
    assert (model.owner == 0).sum() > 1
    assert model.predict(["koch topf koch salz", "zug bahn zug"])[0] == ["de", "de"]
    assert model.predict(["xqxq wvwv kjkj"])[2][0] or model.predict(["xqxq wvwv kjkj"])[1][0] < 0.3


def test_pairs_decide():
    """An insult with a group is toxic; either alone is not."""
    r = random.Random(7)
    rows = []
    memo = toxicity._Memo(toxicity.terms)
    for _ in range(3000):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = [r.choice(EN) for _ in range(6)] + ["scoundrels"] * insult + ["villagers"] * group
        rows.append((int(insult and group), toxicity.distinct(" ".join(words), memo)))
    model = toxicity.fit(rows, epochs=12)
    score = lambda t: model.score(np.unique([i for w in t.encode().split() for i in model.places(w)]).astype(int))
    assert score("the scoundrels and villagers of") > 0.5 > max(score("the scoundrels and of"), score("the villagers and of"))


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, odd_texts, module, label):
    r = random.Random(3)
    bad = ["moron", "trash", "BUY!!", "win$$$"]
    rows = [(i, sentence(EN + FR, 40, r) + (" " + " ".join(r.choice(bad) for _ in range(6)) if i % 3 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows + [(None if i is None else 10_000 + i, t) for i, t in odd_texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(None, 1), (3, None), (99_999, 1)], f"doc_id long, {label} int")
    from graphloom.llm.sampling import labelled_sample

    sample = labelled_sample(docs, labels, label, fold(F.col("doc_id"), 5) != 0, 400)
    assert 300 < sample.count() <= 400 and sample.filter(fold(F.col("doc_id"), 5) == 0).count() == 0
    model = module.train(sample)
    got = module.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 and x.predicted == int(x.score >= module.THRESHOLD) for x in got)
    right = [x.predicted == int(x.doc_id % 3 == 0) for x in got if x.doc_id is not None and x.doc_id < 900]
    assert np.mean(right) > 0.95
    assert module.score(docs.filter("doc_id < -1"), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels(spark, module):
    none = spark.createDataFrame([], "text string, label int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert len({x.score for x in module.score(docs, module.train(none)).collect()}) == 1
    single = spark.createDataFrame([("a b c", 1), ("d e f", 1)], "text string, label int")
    assert all(x.score > 0.5 for x in module.score(docs, module.train(single)).collect())


def test_either_but_not_both():
    """Labels that no sum of weights can give: an insult or a group is toxic, both or neither is not."""
    r = random.Random(7)
    rows, memo = [], toxicity._Memo(toxicity.terms)
    for _ in range(3000):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = [r.choice(EN) for _ in range(6)] + ["scoundrels"] * insult + ["villagers"] * group
        rows.append((int(insult != group), toxicity.distinct(" ".join(words), memo)))
    model = toxicity.fit(rows, epochs=12)
    score = lambda t: model.score(np.unique([i for w in t.encode().split() for i in model.places(w)]).astype(int))
    assert min(score("the scoundrels and of"), score("the villagers and of")) > 0.8
    assert max(score("the scoundrels and villagers of"), score("the and of")) < 0.2


def test_machine_scores_as_the_sum_over_pairs():
    r = np.random.default_rng(1)
    model = toxicity.Machine(np.arange(9), r.normal(size=9), r.normal(size=(9, toxicity.RANK)), 0.3)
    for k in range(1, 9):
        places = np.sort(r.choice(9, k, replace=False))
        plain = model.bias + sum(model.weights[i] for i in places) + sum(float(model.factors[i] @ model.factors[j]) for a, i in enumerate(places) for j in places[a + 1 :])
        assert abs(model.raw(places) - plain) < 1e-9


def test_language_is_that_of_the_nearest_centroid():
    r = random.Random(2)
    texts, langs = zip(*[(sentence(w, r.randint(2, 40), r), lang) for _ in range(60) for lang, w in (("en", EN), ("de", DE), ("fr", FR))])
    model = language.fit(list(langs), language.matrix(list(texts)))
    asked = [sentence(EN + FR, 8, r) for _ in range(30)] + [sentence(DE, 5, r) for _ in range(30)]
    got, scores, _ = model.predict(asked)
    for text, lang, score in zip(asked, got, scores):
        tf = np.bincount(language.counts(text), minlength=language.DIMS)
        x = np.array([np.log(1 + n) * i for n, i in zip(tf, model.idf)])
        near = [float(x @ c) / (np.linalg.norm(x) * np.linalg.norm(c)) for c in model.vectors]
        assert lang == model.langs[model.owner[int(np.argmax(near))]] and abs(score - max(near)) < 1e-4


def test_no_language_is_left_out(spark):
    """More languages than a bounded number of centroids once allowed; the rarest have one text."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    own = {f"l{k:03}": [word() for _ in range(5)] for k in range(330)}
    rows = [(i, sentence(w, 12, r), lang) for i, (lang, w) in enumerate((lang, w) for lang, w in own.items() for _ in range(1 + (lang < "l100")))]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.langs) == set(own)
    asked = {lang: sentence(w, 12, r) for lang, w in own.items()}
    got = model.predict(list(asked.values()))[0]
    assert np.mean([a == b for a, b in zip(got, asked)]) > 0.97


def test_leader_as_a_dense_loop(monkeypatch):
    """The sparse learner against one that holds and moves every weight, written from the published update."""
    monkeypatch.setattr(quality, "DIM_BITS", 7)
    r = random.Random(4)
    texts = [(i % 2, sentence(EN if i % 2 else DE + FR, r.randint(1, 25), r)) for i in range(120)]
    memo = quality._Pairs()
    rows = [(y, *quality.features(t, memo)) for y, t in texts]
    got = quality.fit(rows)
    size = 1 << 7
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    bias, bias_n, order = float(np.log(0.5 / 0.5)), 1.0, np.random.default_rng(5)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(rows)):
            y, places, counts = rows[k]
            x = np.zeros(size)
            for p, c in zip(places, counts):
                x[p] = np.log(1 + c)
            x = (x / np.sqrt((x**2).sum())).astype(np.float32).astype(float)
            for j in range(size):
                w[j] = 0.0 if abs(z[j]) <= quality.L1 else (np.sign(z[j]) * quality.L1 - z[j]) / ((quality.BETA + np.sqrt(n[j])) / quality.ALPHA + quality.L2)
            g = 1 / (1 + np.exp(-(bias + w @ x))) - y
            for j in np.flatnonzero(x):
                z[j] += g * x[j] - (np.sqrt(n[j] + (g * x[j]) ** 2) - np.sqrt(n[j])) / quality.ALPHA * w[j]
                n[j] += (g * x[j]) ** 2
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
    for j in range(size):
        w[j] = 0.0 if abs(z[j]) <= quality.L1 else (np.sign(z[j]) * quality.L1 - z[j]) / ((quality.BETA + np.sqrt(n[j])) / quality.ALPHA + quality.L2)
    assert np.allclose(got.weights, w, atol=1e-3) and abs(got.bias - bias) < 1e-4


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality"), (language, "lang")])
def test_columns_of_the_same_names(spark, module, label):
    """Extra columns named as the operators' own change nothing."""
    r = random.Random(9)
    rows = [(i, sentence(EN if i % 2 else DE, 9, r), "en" if i % 2 else "de") for i in range(120)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wide = plain.withColumns({c: F.lit("x") for c in ("score", "predicted", "label", "terms", "places", "counts", "lang_pred", "rejected", "share", "n", "tf", "toxic", "quality")})
    out = []
    for docs in (plain, wide):
        if module is language:
            out.append(sorted(map(tuple, language.predict(docs, language.train(docs)).collect())))
        else:
            from graphloom.llm.sampling import labelled_sample

            labels = spark.createDataFrame([(i, int(i % 2)) for i in range(120)], f"doc_id long, {label} int")
            out.append(sorted(map(tuple, module.score(docs, module.train(labelled_sample(docs, labels, label, F.lit(True), 100))).collect())))
    assert out[0] == out[1] and len(out[0]) == 120
