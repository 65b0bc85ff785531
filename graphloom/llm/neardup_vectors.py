"""Embedding near-duplicates by spherical-cap filters.

Vectors are turned by a fixed random rotation and cut into blocks. Each block has a
random code of unit vectors; a filter direction is one codeword per block, so a few
small codes give a great many directions. A vector is list-decoded to *all* filters
whose direction it exceeds by the cap height: words that no combination can take over
the height are left out, and so are partial sums that can no longer reach it. Vectors
that share a filter are compared by cosine in double precision.

1. Ids meet by filter, without their vectors. There are so many filters that most hold
   one vector only; those go, and of filters that hold the same vectors one stays.
2. Vectors go to the filters that are left. A filter with more than ``BLOCK`` vectors is
   dealt as pairs of blocks, so that no task holds all of it. A pair that meets in
   several filters counts in the first of them; each task sends counts and the forest
   of its links, not its pairs.

Equal vectors are collapsed first, by parts of their ids and then over those parts, so
that no task holds all rows of a vector, and are counted back. Vectors of each length
have a code of their own, and the length is part of the name of a filter, so only
vectors of one length meet.

Defined results: null, zero and non-finite vectors link with nothing and are their
own component; vectors of different lengths don't link; rows with the same id count
once (the smallest vector of them); an empty table gives no row; each null id is a row
of its own without links and not kept. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import materialise

#: Filters that a vector exceeds on average, and the fewest it gets by blocks (its best, where it exceeds fewer);
#: vectors that are compared in one task; filters for each vector of a table.
EXPECTED, FEWEST, BLOCK, SPREAD = 20, (14, 14, 28), 512, 64
#: Most words of a block; bits of a filter's name below the length; lengths from which on there are two blocks, and can be three.
WORDS, NAME_BITS, SHORT, LONG = 4096, 40, 8, 24
#: Filters whose members are held against each other at once when pairs that met before are left out.
COLUMNS = 4096
#: Random vectors that the cap height is set by.
PROBES = 256


@dataclass
class CapCode:
    """Product code of filter directions for vectors of one length."""

    rotation: np.ndarray
    codes: list[np.ndarray]
    height: float

    @classmethod
    def of(cls, dim: int, size: int, blocks: int = 2, expected: float = EXPECTED, seed: int = 20) -> "CapCode":
        """``blocks`` blocks with ``size`` words each; at the cap height random vectors exceed ``expected`` filters on average.

        Vectors of fewer than ``SHORT`` numbers have one block, and caps that are no narrower than links reach.
        """
        if dim < SHORT:
            size, blocks = min(size, 32 << dim), 1
        random = np.random.default_rng(seed)
        rotation = np.linalg.qr(random.normal(size=(dim, dim)))[0]
        codes = []
        for k in range(blocks):
            c = random.normal(size=(size, dim * (k + 1) // blocks - dim * k // blocks))
            codes.append(c / np.linalg.norm(c, axis=1)[:, None])
        code = cls(rotation, codes, 0.0)
        probes = random.normal(size=(PROBES, dim))
        best = [code._best([s[i] for s in scores], 8 * int(expected))[1] for scores in [code._scores(probes / np.linalg.norm(probes, axis=1)[:, None])] for i in range(PROBES)]
        highest = np.sort(np.concatenate(best))[::-1]
        code.height = float(highest[min(PROBES * int(expected), len(highest)) - 1])
        if dim < SHORT:
            code.height = min(code.height, 0.9)
        return code

    def _scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned, at, scores = unit @ self.rotation, 0, []
        for c in self.codes:
            scores.append(turned[:, at : at + c.shape[1]] @ c.T / np.sqrt(len(self.codes)))
            at += c.shape[1]
        return scores

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """All filters that each unit row exceeds, ascending."""
        scores, need, fewest = self._scores(unit), self.height, FEWEST[len(self.codes) - 1]
        most = np.array([s.max(axis=1) for s in scores])
        # a word that doesn't reach the height with the best words of the other blocks is in no filter
        able = [s >= (need - most.sum(axis=0) + most[k])[:, None] for k, s in enumerate(scores)]
        out = []
        for i in range(len(unit)):
            partial, ids = np.zeros(1), np.zeros(1, np.int64)
            for k, s in enumerate(scores):
                words = np.flatnonzero(able[k][i])
                row = s[i, words]
                order = np.argsort(-row)
                fit = np.searchsorted(-row[order], -(need - most[k + 1 :, i].sum() - partial), side="right")
                take = np.concatenate([order[:n] for n in fit]) if len(fit) else np.empty(0, int)
                partial = np.repeat(partial, fit) + row[take]
                ids = np.repeat(ids, fit) * s.shape[1] + words[take]
            out.append(np.sort(ids if len(ids) >= fewest else self._best([s[i] for s in scores], fewest)[0]))
        return out

    @staticmethod
    def _best(rows: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``n`` filters with the highest scores, and those: they are made of each block's highest words."""
        partial, ids = np.zeros(1), np.zeros(1, np.int64)
        for row in rows:
            top = np.argpartition(row, len(row) - n)[len(row) - n :] if len(row) > n else np.arange(len(row))
            partial = (partial[:, None] + row[top]).ravel()
            ids = (ids[:, None] * len(row) + top).ravel()
            if len(partial) > n:
                best = np.argpartition(partial, len(partial) - n)[len(partial) - n :]
                partial, ids = partial[best], ids[best]
        return ids, partial


def code_size(n: int, dim: int) -> tuple[int, int]:
    """Words of a block's code and blocks, for ``SPREAD`` filters to each of so many vectors."""
    for blocks in (2, 3):
        size = 32
        while size**blocks < SPREAD * n and size < WORDS:
            size *= 2
        if size**blocks >= SPREAD * n or dim < LONG:
            return size, 2 if dim < LONG else blocks
    return size, 3


def _unit(packed: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    # by powers of two, so that squares are neither too large nor too small
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that it reaches through links."""
    label = np.arange(len(linked))
    while True:
        now = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        now = now[now]
        if (now == label).all():
            return label
        label = now


def compare(name: int, first: int, second: int, ids: np.ndarray, blocks: np.ndarray, unit: np.ndarray, weight: np.ndarray, filters: list[np.ndarray], least: float):
    """Links of one filter (or one pair of its blocks): weighted counts per row, and forest edges."""
    linked = unit @ unit.T >= least
    if first != second:
        linked &= blocks[:, None] != blocks[None, :]
    np.fill_diagonal(linked, False)
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return None
    linked = linked[np.ix_(some, some)]
    earlier = [f[f < name] for f in (filters[i] for i in some.tolist())]
    every = np.unique(np.concatenate(earlier))
    counted = linked
    for at in range(0, len(every), COLUMNS):
        part = every[at : at + COLUMNS]
        member = np.zeros((len(some), len(part)), np.float32)
        for r, f in enumerate(earlier):
            f = f[(f >= part[0]) & (f <= part[-1])]
            member[r, np.searchsorted(part, f)] = 1
        counted = counted & (member @ member.T < 0.5)
    return ids[some], counted @ weight[some], ids[some][_forest(linked)]


def _collapsed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (rep, copies, leads, v), and the rows behind each lead of several (lead, ids).

    Only vectors whose hash another row has are moved. A vector's rows meet in about as
    many parts as each part has rows, each under its smallest id, the lead.
    """
    hashed = rows.withColumn("h", F.xxhash64("v"))
    again = materialise(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "hashes")
    flagged = hashed.join(again, "h", "left")
    alone = flagged.filter("m is null").select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("copies"), F.array("id").alias("leads"), "v")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.sqrt("m")))
    leads = materialise(flagged.filter("m > 1").groupBy("v", part.alias("part")).agg(F.min("id").alias("lead"), F.collect_list("id").alias("ids")), "leads")
    several = leads.groupBy("v").agg(F.min("lead").alias("rep"), F.sum(F.size("ids")).alias("copies"), F.collect_list("lead").alias("leads"))
    return alone.unionAll(several.select("rep", "copies", "leads", "v")), leads.select("lead", "ids")


def neardup_vectors(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` of every vector."""
    single = vectors.select(vector).schema[0].dataType.simpleString() == "array<float>"
    kind, number = ("<f4", "float") if single else ("<f8", "double")
    table = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{number}>").alias("v"))
    rows = table.filter("id is not null")
    if not rows.groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    unlinked = [F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")]
    apart = rows.filter(~usable).unionAll(table.filter("id is null")).select(F.col("id").alias(key), *unlinked)
    rows = rows.filter(usable)
    lengths = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not lengths:
        return apart
    sizes = {dim: code_size(n, dim) for dim, n in lengths.items()}
    groups, leads = _collapsed(rows)

    def decode(batches):
        codes = {}
        for batch in batches:
            columns = [[] for _ in range(5)]
            by_length: dict[int, list[int]] = {}
            packed = [np.asarray(v, kind).tobytes() for v in batch.column(3).to_numpy(zero_copy_only=False)]
            for i, x in enumerate(packed):
                by_length.setdefault(len(x) // np.dtype(kind).itemsize, []).append(i)
            for dim, places in by_length.items():
                if dim not in codes:
                    codes.clear()  # one code at a time: there may be many lengths
                    codes[dim] = CapCode.of(dim, *sizes[dim])
                own = [packed[i] for i in places]
                found = [f + (dim << NAME_BITS) for at in range(0, len(own), 256) for f in codes[dim].decode(_unit(own[at : at + 256], kind))]
                for column, values in zip(columns, (places, own, found)):
                    column += values
            order = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(order) for c in batch.columns[:3]), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int64()))], names=["rep", "copies", "leads", "packed", "filters"])

    decoded = materialise(groups.mapInArrow(decode, "rep long, copies long, leads array<long>, packed binary, filters array<long>"), "filters")
    met = decoded.select("rep", F.explode("filters").alias("f"))
    held = met.groupBy("f").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    # filters with the same vectors have the same count, ends and hashes (128 bits)
    stay = held.filter("m > 1").groupBy("m", "low", "high", "x", "y").agg(F.min("f").alias("f")).select("f", "m")
    live = materialise(met.join(stay, "f").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "m"))).alias("live")), "live")
    sent = decoded.select("rep", "copies", "packed").join(live, "rep").select("rep", "copies", "packed", F.col("live.f").alias("filters"), F.explode("live").alias("at"))
    parts = F.ceil(F.col("at.m") / BLOCK).cast("int")
    dealt = sent.withColumn("block", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select(F.col("at.f").alias("f"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "packed", "filters")

    def link(batches):
        key_now, held = None, []

        def close():
            if len(held) < 2:
                return None
            f, i, j = key_now
            blocks, ids, copies, packed, filters = zip(*held)
            return compare(f, i, j, np.array(ids), np.array(blocks), _unit(list(packed), kind), np.array(copies, float), [np.array(x) for x in filters], least)

        def rows_of(found):
            out = [x for x in found if x is not None]
            columns = [np.concatenate([x[k] for x in out]) if out else np.empty(0) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["rep", "links", "root"])

        for batch in batches:
            found = []
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for f, i, j, *row in zip(*columns):
                if (f, i, j) != key_now:
                    found.append(close())
                    key_now, held = (f, i, j), []
                held.append(row)
            yield rows_of(found)
        yield rows_of([close()])

    links = materialise(dealt.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j", "rep").mapInArrow(link, "rep long, links long, root long"), "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(links.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = decoded.select("rep", "copies", "leads").join(counts, "rep", "left").join(joined, "rep", "left")
    found = known.select(F.explode("leads").alias("lead"), F.coalesce("component", "rep").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    full = found.join(leads, "lead", "left").select(F.explode(F.coalesce("ids", F.array("lead"))).alias("id"), "c", "n")
    return full.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), (F.col("c") == F.col("id")).alias("kept")).unionAll(apart)


def op4_neardup_vectors(spark, sf_dir: str) -> DataFrame:
    return neardup_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
