"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text: one- and two-word runs of the lower-cased words, and one- to
three-word runs of the words' shapes (letters to ``a``/``A``, digits to ``9``, runs
squeezed), each hashed to ``2**DIM_BITS`` places; a place's value is log(1 + count),
the whole scaled to length 1. A score is a sparse dot product and its logistic.

Defined results: null or empty text has no feature and scores the bias alone; with
no labelled row of one class the model is the constant prior; repeated rows are
scored each; of clashing labels of one id the greater counts; columns other than the
key and the text are ignored; an empty table gives no row. Counts are held to 65,535
in training, where they travel in two bytes; in scoring they are whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.memos import claim
from graphloom.llm.sampling import give_back_memory, labelled_sample
from graphloom.llm.shared import documents, fold
from graphloom.llm.textkit import U64, encode, mix

DIM_BITS = 22
#: Most labelled rows the model is fitted on, passes over them, and the learner's settings.
TRAIN_ROWS, EPOCHS, ALPHA, BETA, L1, L2 = 8000, 3, 0.6, 1.0, 0.1, 0.001
THRESHOLD = 0.7

_SHAPE = bytes((65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 57 if 48 <= i <= 57 else i) for i in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class _Pairs(dict):
    """word -> (hash of the lower-cased word, hash of its shape), memoised up to a limit."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= 250_000:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        value = self[word] = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(shape, 1))
        return value


def _runs(ids: np.ndarray, upto: int, salt: int) -> list[np.ndarray]:
    out, x = [mix(ids + U64(salt))], ids
    for k in range(2, upto + 1):
        if len(ids) < k:
            break
        x = mix(x[: len(ids) - k + 1] * U64(0x9E3779B97F4A7C15) + ids[k - 1 :])
        out.append(mix(x + U64(salt + k)))
    return out


def features(text: str | None, memo: _Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Places (sorted, distinct) and counts of a whole text."""
    words = encode(text).split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    pairs = np.array([memo[w] for w in words], dtype=np.uint64)
    hashes = np.concatenate(_runs(pairs[:, 0], 2, 11) + _runs(pairs[:, 1], 3, 101))
    return np.unique((hashes >> U64(64 - DIM_BITS)).astype(np.int32), return_counts=True)


def values(counts: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float64))
    n = np.sqrt(v @ v)
    return v / n if n else v


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, places: np.ndarray, counts: np.ndarray) -> float:
        z = self.bias + (float(self.weights[places] @ values(counts)) if len(places) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: Iterable[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over (label, places, counts); per-coordinate rates, L1 and L2."""
    rows = list(rows)
    size = 1 << DIM_BITS
    labels = np.array([y for y, _, _ in rows], dtype=np.float64)
    if len(rows) == 0 or labels.min() == labels.max():
        prior = (labels.sum() + 0.5) / (len(rows) + 1)
        return Model(np.zeros(size, np.float32), float(np.log(prior / (1 - prior))))
    prior = labels.mean()
    bias, bias_n = float(np.log(prior / (1 - prior))), 1.0
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(5)
    scaled = [(y, p, values(c).astype(np.float32)) for y, p, c in rows]

    def weights_at(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(scaled)):
            y, p, v = scaled[k]
            w = weights_at(p)
            s = bias + w @ v
            g0 = 1 / (1 + np.exp(-np.clip(s, -35, 35))) - y
            g = g0 * v
            now = n[p]
            sigma = (np.sqrt(now + g * g) - np.sqrt(now)) / ALPHA
            z[p] += g - sigma * w
            n[p] = now + g * g
            bias_n += g0 * g0
            bias -= 0.1 * g0 / np.sqrt(bias_n)
    every = np.flatnonzero(n)
    weights = np.zeros(size, np.float32)
    weights[every] = weights_at(every)
    return Model(weights, bias)


def extract(df: DataFrame, label: str = "label") -> DataFrame:
    """``label``, places and counts of each text, packed as little-endian bytes."""

    def run(batches):
        memo = _Pairs()
        for batch in batches:
            places, counts = [], []
            for value in batch.column(1):
                p, c = features(value.as_py(), memo)
                places.append(p.astype("<i4").tobytes())
                counts.append(np.minimum(c, 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=["label", "places", "counts"])

    return df.select(F.col(label).cast("int").alias("label"), "text").mapInArrow(run, "label int, places binary, counts binary")


def train(sample: DataFrame) -> Model:
    """Fit on a bounded sample of (text, label)."""
    table = extract(sample).toArrow().sort_by([("label", "ascending"), ("places", "ascending")])
    rows = zip(table["label"].to_pylist(), table["places"], table["counts"])
    model = fit((y, np.frombuffer(p.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<u2")) for y, p, c in rows)
    del rows, table
    give_back_memory()
    return model


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``score`` and ``predicted`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("quality")
        memo, model = _Pairs(), shared.value
        for batch in batches:
            scores = [model.score(*features(value.as_py(), memo)) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])

    kept = df.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double, predicted int"])
    return df.select(*keep, text).mapInArrow(run, schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2, TRAIN_ROWS))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
