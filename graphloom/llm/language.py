"""Language ID: nearest of several clustered centroids per language, by cosine.

A text becomes a normalised TF-IDF vector of its byte trigrams: lower-cased UTF-8
with everything that is no letter (ASCII controls, digits, punctuation) turned to
blanks, hashed to ``DIMS`` places, log(1 + tf) * idf, with tf up to 65,535 in
training. Spherical k-means clusters
the training vectors of each language; a text gets the language of the centroid
nearest by cosine. A text farther from its centroid than ``SLACK`` times the lowest
similarities seen in training, at its length, is rejected.

Defined results: null, empty and letterless texts are ``und`` with score 0 and
rejected; with no training row every text is ``und``; ties go to the language first
in code-point order; repeated rows are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.memos import claim
from graphloom.llm.sampling import bounded_rows, give_back_memory
from graphloom.llm.shared import documents, fold
from graphloom.llm.textkit import encode

UNDETERMINED = "und"
#: Hashed places; training texts per language at most, and in all; of a language at least; centroids per language.
DIMS, ROWS_PER_LANG, ROWS, LEAST_ROWS, CENTROIDS = 4096, 600, 30_000, 20, 4
#: Most languages whose shares are broadcast.
FEW_LANGS = 100_000
#: Rejection: share of the similarity that the worst training texts of that length have.
SLACK, LENGTH_CLASSES = 0.35, 14

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


def counts(text: str | None) -> np.ndarray:
    """Places of all trigrams of a whole text, with repeats."""
    x = _FOLD[np.frombuffer(b" " + encode(text and text.lower()) + b" ", np.uint8)]
    if len(x) < 3:
        return np.empty(0, np.int64)
    h = x[:-2] * np.uint32(0x01000193) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return (h[x[1:-1] != 32] % np.uint32(DIMS)).astype(np.int64)


def matrix(texts: list[str | None]) -> np.ndarray:
    """Term frequencies, one row per text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, text in enumerate(texts):
        out[i] = np.bincount(counts(text), minlength=DIMS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def length_class(tf: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(tf.sum(axis=1) + 1).astype(int), LENGTH_CLASSES - 1)


@dataclass
class Centroids:
    langs: list[str]
    owner: np.ndarray  # language of each centroid
    vectors: np.ndarray  # unit rows
    idf: np.ndarray
    floor: np.ndarray  # lowest accepted similarity by length class

    def vectorise(self, tf: np.ndarray) -> np.ndarray:
        x = np.log1p(tf, where=tf > 0, out=np.zeros_like(tf)) * self.idf
        n = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.where(n == 0, 1, n)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, similarity (0 to 1) and whether rejected, of each text."""
        letters = np.array([has_letter(t) for t in texts], dtype=bool)
        if not len(self.langs):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        tf = matrix(texts)
        near = self.vectorise(tf) @ self.vectors.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(texts)), best], 0, 1).astype(float)
        score[~letters] = 0
        langs = [self.langs[self.owner[b]] if ok else UNDETERMINED for b, ok in zip(best, letters)]
        return langs, score, ~letters | (score < self.floor[length_class(tf)])


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out seeds; unit rows."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        near = np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(near.argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
        mine = (x @ c.T).argmax(axis=1)
        c = np.array([x[mine == j].mean(axis=0) if (mine == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]


def fit(langs: list[str], tf: np.ndarray) -> Centroids:
    names = sorted(set(langs))
    n = len(langs)
    idf = (np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Centroids(names, np.empty(0, int), np.empty((0, DIMS), np.float32), idf, np.zeros(LENGTH_CLASSES))
    if not names:
        return model
    x, y = model.vectorise(tf), np.array(langs)
    owner, vectors = [], []
    for i, name in enumerate(names):
        c = _cluster(x[y == name], CENTROIDS)
        owner += [i] * len(c)
        vectors.append(c)
    model.owner, model.vectors = np.array(owner), np.concatenate(vectors).astype(np.float32)
    near = (x @ model.vectors.T).max(axis=1)
    classes = length_class(tf)
    lowest = np.array([np.quantile(near[classes == c], 0.005) if (classes == c).any() else np.inf for c in range(LENGTH_CLASSES)])
    # a class without training text takes the lowest of the shorter ones, and no class asks more than a longer one has shown
    model.floor = SLACK * np.minimum.accumulate(lowest[::-1])[::-1]
    model.floor[~np.isfinite(model.floor)] = 0.0
    return model


def train(docs: DataFrame, keep: Column | None = None) -> Centroids:
    """Fit on texts for which ``keep`` (on doc_id) holds: about ``ROWS_PER_LANG`` of each language, fewer where
    languages are many (``ROWS`` in all), but ``LEAST_ROWS`` of each, or all that it has; no language is left out."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep)).select("doc_id", "lang")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.count()
    if not langs:
        return fit([], np.zeros((0, DIMS), np.float32))
    each = min(ROWS_PER_LANG, max(LEAST_ROWS, ROWS // langs))
    shares = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("share"))
    # a row a language: broadcast, as a third of all rows may have one language, while they are few
    picked = labelled.join(F.broadcast(shares) if langs <= FEW_LANGS else shares, "lang").filter((F.xxhash64("doc_id", F.lit(11)) / F.lit(2.0**64) + 0.5) < F.col("share")).select("doc_id", "lang")
    chosen = bounded_rows(picked.distinct(), max(ROWS, 2 * LEAST_ROWS * langs), F.col("doc_id"), F.col("lang"))
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")

    def run(batches):
        claim("language")
        for batch in batches:
            tf = matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.minimum(r, 65535).astype("<u2").tobytes() for r in tf], pa.binary())], names=["lang", "tf"])

    table = rows.select("lang", "text").mapInArrow(run, "lang string, tf binary").toArrow().sort_by([("lang", "ascending"), ("tf", "ascending")])
    tf = np.array([np.frombuffer(b, "<u2") for b in table["tf"].to_pylist()], np.float32).reshape(-1, DIMS)
    model = fit(table["lang"].to_pylist(), tf)
    del table, tf
    give_back_memory()
    return model


def predict(df: DataFrame, model: Centroids, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred``, ``score`` and ``rejected`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("language")
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                langs, score, rejected = model.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=[*part.schema.names[:-1], "lang_pred", "score", "rejected"])

    kept = df.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double, rejected boolean"])
    return df.select(*keep, text).mapInArrow(run, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = train(docs, fold(F.col("doc_id"), 4) != 2)
    predicted = predict(docs, model)
    return predicted.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
