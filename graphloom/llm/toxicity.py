"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased letter runs and their first four and
five letters, as 32-bit hashes; present terms have value 1. Besides a weight each
term has ``RANK`` factors, so a pair of terms adds the dot product of their factors:
the pair can matter where neither term does. Terms in fewer than ``MIN_TEXTS``
texts of the training sample are left out of the model.

Defined results: null or empty text scores the bias alone; with no labelled row of
one class the model is the constant prior; repeated rows are scored each; of clashing
labels of one id the greater counts; columns other than the key and the text are
ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.memos import claim
from graphloom.llm.sampling import give_back_memory, labelled_sample
from graphloom.llm.shared import documents, fold
from graphloom.llm.textkit import encode

#: Most labelled rows the model is fitted on, and the learner's settings.
TRAIN_ROWS, EPOCHS, RANK, MIN_TEXTS = 12_000, 6, 8, 3
RATE, SPARSE, DECAY, FACTOR_RATE, FACTOR_DECAY = 1.0, 3.0, 1.0, 0.03, 1e-3
#: Share of the sample's texts, and least number of them, from which on a term has factors whatever its weight.
FREQUENT, FREQUENT_TEXTS = 0.05, 30
#: Sample size from which on the L1 term is SPARSE; less, by the square root, below it.
FULL_SAMPLE = 4000
THRESHOLD = 0.5

_LETTERS = regex.compile(r"\p{L}+")


def terms(word: bytes) -> tuple[int, ...]:
    """Hashed terms of one white-space delimited word."""
    out = []
    for run in _LETTERS.findall(word.decode("utf-8", "replace").lower()):
        out.append(xxhash.xxh32_intdigest(run.encode(), 0))
        if len(run) > 4:
            out.append(xxhash.xxh32_intdigest(run[:4].encode(), 4))
        if len(run) > 5:
            out.append(xxhash.xxh32_intdigest(run[:5].encode(), 5))
    return tuple(out)


class _Memo(dict):
    """word -> what ``make`` gives for it, memoised up to a limit."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes):
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = self.make(word)
        return value


def distinct(text: str | None, memo: _Memo) -> np.ndarray:
    found = chain.from_iterable(map(memo.__getitem__, set(encode(text).split())))
    return np.unique(np.fromiter(found, dtype=np.int64))


@dataclass
class Machine:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def places(self, word: bytes) -> tuple[int, ...]:
        """Where the word's terms stand in the model; terms that it doesn't know are left out."""
        found = np.searchsorted(self.hashes, hashed := np.array(terms(word), dtype=np.int64))
        return tuple(int(i) for i, h in zip(found, hashed) if i < len(self.hashes) and self.hashes[i] == h)

    def raw(self, places: np.ndarray) -> float:
        if not len(places):
            return self.bias
        v = self.factors[places]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[places].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(places), -35, 35))))


def fit(rows: Iterable[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> Machine:
    """One text at a time; rows are (label, distinct term hashes).

    Weights follow the regularised leader with an L1 term, which leaves terms without
    evidence out. Factors follow AdaGrad, of the terms that have a weight and of frequent
    ones whatever their weight: rarer terms' factors would learn their few texts by heart.
    """
    rows = list(rows)
    labels = np.array([y for y, _ in rows], dtype=np.float64)
    prior = (labels.sum() + 0.5) / (len(rows) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if len(rows) == 0 or labels.min() == labels.max():
        return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, RANK)), bias)
    every, counts = np.unique(np.concatenate([t for _, t in rows]), return_counts=True)
    hashes = every[counts >= MIN_TEXTS]
    if not len(hashes):
        return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, RANK)), bias)
    frequent = counts[counts >= MIN_TEXTS] >= max(FREQUENT_TEXTS, FREQUENT * len(rows))
    placed = []
    for y, t in rows:
        i = np.minimum(np.searchsorted(hashes, t), len(hashes) - 1)
        placed.append((y, i[hashes[i] == t].astype(np.int32)))
    random = np.random.default_rng(3)
    n, sparse = len(hashes), SPARSE * min(1.0, (len(rows) / FULL_SAMPLE) ** 0.5)
    z, zn, w = np.zeros(n), np.zeros(n), np.zeros(n)
    v, gv, gb = random.normal(0, 0.01, (n, RANK)), np.ones((n, RANK)), 1.0
    for _ in range(epochs):
        for k in random.permutation(len(placed)):
            y, i = placed[k]
            wi = w[i]
            live = i[(wi != 0) | frequent[i]]
            vi = v[live]
            s = vi.sum(axis=0)
            raw = bias + wi.sum() + 0.5 * (s @ s - (vi * vi).sum())
            g = 1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y
            if abs(g) < 1e-4:
                continue
            now = zn[i]
            then = now + g * g
            zi = z[i] + g - (np.sqrt(then) - np.sqrt(now)) / RATE * wi
            z[i], zn[i] = zi, then
            w[i] = np.where(np.abs(zi) <= sparse, 0.0, (np.sign(zi) * sparse - zi) / ((1 + np.sqrt(then)) / RATE + DECAY))
            if len(live):
                d = np.clip(g * (s - vi) + FACTOR_DECAY * vi, -1, 1)
                gv[live] += d * d
                v[live] = vi - FACTOR_RATE * d / np.sqrt(gv[live])
            gb += g * g
            bias -= 0.1 * g / np.sqrt(gb)
    known = (w != 0) | frequent
    hashes, w, v = hashes[known].astype(np.int64), w[known], v[known]
    return Machine(hashes, w, v, bias)


def extract(df: DataFrame, label: str = "label") -> DataFrame:
    """``label`` and the distinct term hashes of each text, packed."""

    def run(batches):
        memo = _Memo(terms)
        for batch in batches:
            packed = [distinct(value.as_py(), memo).astype("<u4").tobytes() for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["label", "terms"])

    return df.select(F.col(label).cast("int").alias("label"), "text").mapInArrow(run, "label int, terms binary")


def train(sample: DataFrame) -> Machine:
    """Fit on a bounded sample of (text, label)."""
    table = extract(sample).toArrow().sort_by([("label", "ascending"), ("terms", "ascending")])
    rows = [(y, np.frombuffer(t.as_buffer() if t.is_valid else b"", "<u4")) for y, t in zip(table["label"].to_pylist(), table["terms"])]
    model = fit(rows)
    del rows, table
    give_back_memory()
    return model


def score(df: DataFrame, model: Machine, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``score`` and ``predicted`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("toxicity")
        model = shared.value
        memo = _Memo(model.places)
        for batch in batches:
            scores = [model.score(distinct(value.as_py(), memo)) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])

    kept = df.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double, predicted int"])
    return df.select(*keep, text).mapInArrow(run, schema)


def learned(spark, docs: DataFrame, sf_dir: str) -> Machine:
    """The model of the contract: labels of every row outside the held-out fold, bounded."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, TRAIN_ROWS))


def op1_toxicity_fm(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, learned(spark, docs, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
