import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, shard string, score string, ids string, kind int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) rows, with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "y", "z", 3) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, one-word and very long texts."""
    r = random.Random(4)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "épée"]) for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "two words"), (6, "two words"), (7, long), (8, long), (9, "x" * 20_000), (None, "no id at all"), (10, "ÀÉÎ 中文 🙂 it's 12,5 <|endoftext|>")]


@pytest.fixture(scope="session")
def prose():
    """Documents that share passages, near and exact copies; some of them upper-cased."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, docs = words(70), []
    for i in range(60):
        w = words(r.randint(0, 160))
        if i % 4 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[: r.randint(45, 70)]
        docs.append(w)
    for i in range(60, 110):
        w = list(docs[r.randint(0, 59)])
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append([x.upper() for x in w] if i % 7 == 0 else w)
    ids = list(range(1000, 1000 + len(docs)))
    r.shuffle(ids)
    return [(i, r.choice([" ", "  ", "\n"]).join(w)) for i, w in zip(ids, docs)] + [(ids[0], docs[0] and " ".join(docs[0]))]
