"""The best texts of each query by a sum of term weights, for every query over every text.

Texts are read once and kept as blocks that only have what the queries ask for. A block is scored
against all queries with arrays, and a task gives the best of each query on, not each pair.
The queries and their distinct terms are held by the driver and every worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.text import pieces, runs
from graphloom.operators.graph import ranked

#: Sums that are held at once, and scores that a task collects before it drops those that can't be among the best.
HELD, COLLECTED = 4_000_000, 2_000_000


class Asked:
    """Queries and what they ask for: ``terms`` by number, and the queries of each term one after another."""

    def __init__(self, pairs: DataFrame):
        found = pairs.toArrow()
        self.type = pairs.schema["qid"].dataType.simpleString()
        codes, terms = (found.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
        self.qids, self.terms = codes.dictionary, terms.dictionary.to_pylist()
        q, t = (c.indices.to_numpy(zero_copy_only=False).astype(np.int32) for c in (codes, terms))
        self.queries = q[np.argsort(t, kind="stable")]
        self.counts = np.bincount(t, minlength=len(self.terms))
        self.starts = np.cumsum(self.counts) - self.counts


def placed(words, places) -> np.ndarray:
    """The place of each word in the asked terms, -1 where it is none of them."""
    return pc.fill_null(pc.index_in(words, places), -1).to_numpy(zero_copy_only=False)


def blocks(texts: DataFrame, terms: list[str], find: Callable, label: str | None = None) -> DataFrame:
    """keys, labels, lengths, sizes, terms, counts: the asked terms that each text of a block has.

    ``find`` gives of a column of texts, the places of the terms and what a worker remembers: the length of each
    text (negative: the text is left out), then row, place and count of each term found, rows in order.
    """
    key = texts.schema["file"].dataType.simpleString()
    number = texts.sparkSession.sparkContext.broadcast(terms)

    def pack(batches):
        places, known = pa.array(number.value, pa.large_string()), {}
        for batch in batches:
            for part in pieces(batch):
                lengths, row, ids, counts = find(part.column("text"), places, known)
                sizes = np.bincount(row, minlength=len(lengths))
                take = np.flatnonzero(lengths >= 0)
                columns = [part.column("file").take(pa.array(take)), part.column(label).take(pa.array(take)) if label else pa.nulls(len(take), pa.string())]
                cells = [pa.array([c.to_pylist()], pa.list_(c.type)) for c in columns]
                cells += [pa.array([x.astype(d).tobytes()], pa.binary()) for x, d in ((lengths[take], "i8"), (sizes[take], "i4"), (ids, "i4"), (counts, "i4"))]
                yield pa.RecordBatch.from_arrays(cells, ["keys", "labels", "lengths", "sizes", "terms", "counts"])

    wanted = texts.select("file", "text", *([label] if label else []))
    return wanted.mapInArrow(pack, f"keys array<{key}>, labels array<string>, lengths binary, sizes binary, terms binary, counts binary").persist(StorageLevel.MEMORY_AND_DISK)


def frequencies(packed: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """How many texts have each term, how many there are, and their lengths in all."""

    def count(batches):
        df, n, total = np.zeros(n_terms, "i8"), 0, 0
        for batch in batches:
            for terms, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df += np.bincount(np.frombuffer(terms, "i4"), minlength=n_terms)
                n, total = n + len(lengths) // 8, total + int(np.frombuffer(lengths, "i8").sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, total]))], ["t", "n"])

    found = packed.select("terms", "lengths").mapInArrow(count, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    sums = dict(zip(found["t"], found["n"]))
    df = np.zeros(n_terms, "i8")
    for t, n in sums.items():
        if t >= 0:
            df[t] = n
    return df, sums.get(-1, 0), sums.get(-2, 0)


def best(packed: DataFrame, asked: Asked, weigh: Callable, top: int, bonus: Callable | None = None) -> DataFrame:
    """qid, file, score, rank: the sum of ``weigh(term, f, length)`` over the terms that query and text share, to six places.

    ``bonus`` gives of a label what is added for each query.
    """
    context = packed.sparkSession.sparkContext
    shared = context.broadcast((asked.qids, asked.queries, asked.counts, asked.starts))
    key = packed.schema["keys"].dataType.elementType.simpleString()

    def score(batches):
        qids, queries, per_term, starts = shared.value
        n_q, known = len(qids), {}
        least = np.full(n_q, -np.inf)
        kept: list = []

        def extra(label):
            if label not in known:
                if len(known) >= 4_096:
                    known.clear()
                known[label] = bonus(label)
            return known[label]

        def cut(held):
            """The best of each query; ties by file."""
            q, sums = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            files = pa.concat_arrays([h[2] for h in held])
            ties = files.to_numpy(zero_copy_only=False)
            if ties.dtype.kind == "O":
                ties = np.unique(ties.astype(str), return_inverse=True)[1]
            order = np.lexsort((ties, -sums, q))
            by = q[order]
            starts = np.flatnonzero(np.append(True, by[1:] != by[:-1])[: len(by)])
            place = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
            last = order[place == top - 1]
            least[q[last]] = sums[last]
            order = order[place < top]
            return [(q[order], sums[order], files.take(pa.array(order)))]

        for batch in batches:
            for row in range(batch.num_rows):
                files = batch.column("keys")[row].values
                named = files.is_valid().to_numpy(zero_copy_only=False)
                lengths, sizes, terms, counts = (np.frombuffer(batch.column(c)[row].as_py(), d) for c, d in (("lengths", "i8"), ("sizes", "i4"), ("terms", "i4"), ("counts", "i4")))
                labels = batch.column("labels")[row].values.to_pylist() if bonus else None
                ends = np.cumsum(sizes)
                weights = weigh(terms, counts, np.repeat(lengths, sizes))
                upto = np.concatenate([[0], np.cumsum(per_term[terms])])[np.concatenate([[0], ends])]
                at = 0
                while at < len(files):
                    # as many texts as keep sums and matches within what is held
                    to = max(at + 1, min(at + HELD // max(n_q, 1), int(np.searchsorted(upto, upto[at] + HELD, "right")) - 1))
                    to = min(to, len(files))
                    lo, hi = ends[at] - sizes[at], ends[to - 1]
                    t = terms[lo:hi]
                    of = np.repeat(np.repeat(np.arange(to - at), sizes[at:to]), per_term[t])
                    cell = of * n_q + queries[runs(starts[t], per_term[t])]
                    sums = np.bincount(cell, np.repeat(weights[lo:hi], per_term[t]), (to - at) * n_q)
                    met = np.bincount(cell, minlength=(to - at) * n_q) > 0
                    if bonus:
                        sums = sums + np.concatenate([extra(x) for x in labels[at:to]])
                    sums = np.copysign(np.floor(np.abs(sums) * 1e6 + 0.5), sums) / 1e6
                    hit = np.flatnonzero(met & (sums >= np.tile(least, to - at)) & np.repeat(named[at:to], n_q))
                    kept.append((hit % n_q, sums[hit], files.slice(at).take(pa.array(hit // n_q))))
                    if sum(len(k[0]) for k in kept) > COLLECTED:
                        kept = cut(kept)
                    at = to
        if kept:
            q, s, files = cut(kept)[0]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), files, pa.array(s)], ["qid", "file", "score"])

    return ranked(packed.mapInArrow(score, f"qid {asked.type}, file {key}, score double"), top)
