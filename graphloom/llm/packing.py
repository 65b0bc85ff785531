"""Packing by lexical retrieval: fill each training window with the neighbours of its seed document.

Documents are dealt to shards by content: in the order of their ``TELLING`` most
telling terms over the whole table, the most widespread of these first, neighbours
make up shards of ``SHARD_DOCS`` documents or ``SHARD_TOKENS`` tokens at most,
wherever they were read. So copies and documents of one subject come together, but a
seed searches its shard only. A table of one shard is searched whole. A shard has a
BM25 inverted index over token ids. A window of ``WINDOW`` tokens starts with the
next unused document as seed (or the rest of the one that the last window cut); the
index returns its best unused neighbours, which fill the window in order of score,
cut where it is full. When a seed has no more neighbours, the next unused document
fills on. The rest at the end of a shard becomes sequences of powers of two, so
nothing is padded.

Defined results: null or empty text is a document of one id, the end id; every id
lies in one piece; repeated rows are packed each; other columns are ignored; an
empty table gives no piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.memos import claim
from graphloom.llm.sampling import give_back_memory
from graphloom.llm.shared import documents, materialise
from graphloom.llm.word_bpe import WordBpe

WINDOW, END_ID = 4096, 2
SHARD_DOCS, SHARD_TOKENS, TELLING = 4096, 6_000_000, 8
#: Partitions for each full shard: ranges are cut by a sample, so they differ in size.
SPARE = 1.25
#: BM25 settings.
K1, B = 1.2, 0.75
#: Neighbours that are sorted at first; a term of at least one in so many documents has a row of the matrix, if there is room.
FIRST, COMMON, CELLS = 32, 4, 1 << 23
#: Documents of each partition, and in all, that the bounds of the ranges are taken from.
BOUND_ROWS, MOST_BOUND_ROWS = 64, 200_000
TOKENIZER = "word_bpe_49k.json"
#: Units that a worker remembers between tasks; rows and bytes of text that are encoded together; documents that are counted together.
UNITS, GATHERED_ROWS, GATHERED_BYTES, COUNTED = 1_000_000, 1 << 15, 16 << 20, 256

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of every distinct term of every document, in this order."""
    lengths = np.array([len(x) for x in docs], np.int64)
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    # document and term in one number, as short as they allow: short ones are sorted faster
    kind, bits = (np.uint32, 16) if len(docs) <= 1 << 16 and ids.max(initial=0) < 1 << 16 else (np.int64, 32)
    both = np.repeat(np.arange(len(docs), dtype=kind) << kind(bits), lengths)
    both |= ids.astype(kind)
    both.sort()
    start = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
    found = both[start].astype(np.int64)
    return found >> bits, found & ((1 << bits) - 1), np.diff(start, append=len(both))


class Bm25:
    """Inverted index of a shard, with BM25 weights: rows of a matrix for the most common terms, postings for the others."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        # some documents at a time: what sorting them takes is then small beside the shard
        pieces = [(at, *term_counts(docs[at : at + COUNTED])) for at in range(0, n, COUNTED)]
        d, t, c = np.concatenate([at + x for at, x, _, _ in pieces]), np.concatenate([x for _, _, x, _ in pieces]), np.concatenate([x for _, _, _, x in pieces])
        del pieces
        lengths = np.array([len(x) for x in docs], np.float32)
        df = np.bincount(t)
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1).astype(np.float32)
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1))
        weight = idf[t] * c * np.float32(K1 + 1) / (c + norm[d])
        keep = df[t] > 1  # a term of one document leads to no other
        d, t, weight = d[keep], t[keep], weight[keep].astype(np.float32)
        common = np.flatnonzero(df * COMMON >= n)
        common = common[df[common] > 1]
        if len(common) * n > CELLS:
            common = np.sort(common[np.argsort(-df[common], kind="stable")[: CELLS // n]])
        row = np.full(len(df), -1, np.int64)
        row[common] = np.arange(len(common))
        dense = row[t] >= 0
        self.matrix = np.zeros((len(common), n), np.float32)
        self.matrix[row[t[dense]], d[dense]] = weight[dense]
        starts = np.searchsorted(d, np.arange(n + 1))
        self.rows, self.terms = row[t], t
        self.own = starts.tolist()
        order = np.argsort(t[~dense], kind="stable")
        kind = np.uint16 if n < 1 << 16 else np.int64
        self.columns, self.weights = d[~dense][order].astype(kind), weight[~dense][order]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(t[~dense], minlength=len(df)))))
        #: The document of each column.
        self.docs = np.arange(n)

    def drop_used(self, unused: np.ndarray) -> None:
        """Take used documents out; weights stay those of the whole shard."""
        keep = unused[self.docs]
        self.matrix = self.matrix[:, keep]
        place = (np.cumsum(keep) - 1).astype(self.columns.dtype)
        stay = keep[self.columns]
        self.begin = np.concatenate(([0], np.cumsum(stay)))[self.begin]
        self.columns, self.weights = place[self.columns[stay]], self.weights[stay]
        self.docs = self.docs[keep]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term, by falling score (then by place); sorted as far as they are asked for."""
        own = slice(self.own[seed], self.own[seed + 1])
        rows, terms = self.rows[own], self.terms[own]
        terms, rows = terms[rows < 0], rows[rows >= 0]
        score = self.matrix[rows].sum(axis=0) if len(rows) else np.zeros(len(self.docs), np.float32)
        spans = [(a, b) for a, b in zip(self.begin[terms].tolist(), self.begin[terms + 1].tolist()) if a < b]
        if spans:
            found = np.concatenate([self.columns[a:b] for a, b in spans])
            score = score + np.bincount(found, weights=np.concatenate([self.weights[a:b] for a, b in spans]), minlength=len(score))
        hits = np.flatnonzero((score > 0) & unused[self.docs])
        score, first = score[hits], FIRST
        while len(hits):
            least = -np.inf if len(hits) <= first else np.partition(score, len(hits) - first)[len(hits) - first]
            now = score >= least
            yield from self.docs[hits[now][np.argsort(-score[now], kind="stable")]].tolist()
            hits, score, first = hits[~now], score[~now], 8 * first


def pack(docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    index = Bm25(docs)
    unused, indexed = np.ones(len(docs), bool), len(docs)
    upcoming = 0
    left = sum(map(len, docs))
    sequence, carried = 0, None

    def next_unused() -> int:
        nonlocal upcoming
        while not unused[upcoming]:
            upcoming += 1
        return upcoming

    while left:
        room = WINDOW if left >= WINDOW else 1 << (left.bit_length() - 1)
        left -= room
        offset, queue = 0, None
        if carried is None:
            seed, at = next_unused(), 0
            unused[seed] = False
        else:
            seed, at = carried
            carried = None
        doc = seed
        while True:
            take = min(room - offset, len(docs[doc]) - at)
            yield doc, at, take, sequence, offset
            offset += take
            if at + take < len(docs[doc]):
                carried = (doc, at + take)
            if offset == room:
                break
            if queue is None:
                if 8 * unused.sum() <= 7 * indexed:
                    index.drop_used(unused)
                    indexed = unused.sum()
                queue = index.neighbours(seed, unused.copy())
            doc = next(queue, None)
            doc = next_unused() if doc is None else doc
            unused[doc] = False
            at = 0
        sequence += 1


def narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit."""
    return ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def widened(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4", copy=False)


def telling(docs: list[np.ndarray], df: np.ndarray, n: int, mean: float) -> list[list[int]]:
    """Of each document the terms that weigh most among those that other documents have too, the most widespread first."""
    d, t, c = term_counts(docs)
    shared = df[t] > 1
    d, t, c = d[shared], t[shared], c[shared]
    norm = K1 * (1 - B + B * np.array([len(x) for x in docs]) / mean)
    weight = np.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c / (c + norm[d])
    # one number to sort by: the document, and within it the weight, falling
    order = np.argsort(d + (1 - weight / (weight.max(initial=0) + 1)), kind="stable")
    first = np.searchsorted(d, np.arange(len(docs)))
    order = order[np.arange(len(order)) - first[d] < TELLING]  # as d ascends, places in order[] have the same d
    order = order[np.lexsort((t[order], -df[t[order]], d[order]))]
    ends = np.searchsorted(d[order], np.arange(len(docs) + 1))
    terms = t[order].tolist()
    return [terms[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def _gathered(batches, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows or bytes: words are numbered in larger pieces."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            batch = pa.concat_batches(held)
            held = []
            yield batch
    if held:
        yield pa.concat_batches(held)


def encoded_table(df: DataFrame, encoder: Callable[[], WordBpe], key: str, text: str, keep: bool) -> DataFrame:
    """``key``, n, ids of every row, end id included; and of every task a row with n -1: in how many documents it saw each id."""

    kind = to_arrow_type(df.schema[key].dataType)

    def run(batches):
        bpe = encoder()
        claim("word_bpe", bpe.forget)
        seen = np.zeros(0, np.int64)
        for batch in _gathered(batches, GATHERED_ROWS, GATHERED_BYTES):
            encoded = bpe.encoded(x.as_py() for x in batch.column(1))
            for at in range(0, batch.num_rows, COUNTED):
                ids = [np.append(x, np.uint32(END_ID)) for x in islice(encoded, COUNTED)]
                more = np.bincount(term_counts(ids)[1], minlength=len(seen))
                more[: len(seen)] += seen
                seen = more
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, COUNTED), pa.array([len(x) for x in ids], pa.int64()), pa.array(list(map(narrow, ids)), pa.binary())], names=[key, "n", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([None], kind), pa.array([-1], pa.int64()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], names=[key, "n", "ids"])
        if not keep:
            bpe.forget()
            give_back_memory()

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n long, ids binary")


def _spread(batches):
    """term, df of the counts that tasks have left."""
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            df = np.frombuffer(packed, "<i8")
            t = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(df[t], pa.int64())], names=["term", "df"])


def dealt(table: DataFrame, key: str) -> DataFrame:
    """The rows of ``encoded_table`` in the order of their telling terms, by ranges of about a shard."""
    encoded = table.filter("n >= 0")
    n, tokens = encoded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # as many rows as the tokenizer has ids
    counts = table.filter("n < 0").select("ids").mapInArrow(_spread, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(max(counts["term"].to_pylist(), default=0) + 1, np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    shared, mean = table.sparkSession.sparkContext.broadcast(df), tokens / max(n, 1)
    full = max(n / SHARD_DOCS, tokens / SHARD_TOKENS)
    parts = 1 if full <= 1 else int(np.ceil(full * SPARE))

    def sign(bounds, batches):
        for batch in batches:
            found = telling(list(map(widened, batch.column(2).to_pylist(), batch.column(1).to_pylist())), shared.value, n, mean)
            # equal documents are told apart by a hash, so that a large group of copies is cut too
            part = [bisect_right(bounds.value, (t, h)) for t, h in zip(found, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64())), pa.array(part, pa.int32())], names=[key, "n", "ids", "h", "telling", "part"])

    hashed = encoded.select(key, "n", "ids", F.xxhash64("ids", key).alias("h"))
    schema = f"`{key}` {encoded.schema[key].dataType.simpleString()}, n long, ids binary, h long, telling array<long>, part int"
    send = encoded.sparkSession.sparkContext.broadcast
    signed = hashed.mapInArrow(partial(sign, send([])), schema)
    if parts > 1:
        share = min(1.0, min(BOUND_ROWS * parts, MOST_BOUND_ROWS) / n)
        some = hashed.filter(F.xxhash64("h", F.lit(3)) / F.lit(2.0**64) + 0.5 < share).mapInArrow(partial(sign, send([])), schema)
        table = some.select("telling", "h").toArrow()
        seen = sorted(zip(table["telling"].to_pylist(), table["h"].to_pylist()))
        bounds = [seen[len(seen) * i // parts] for i in range(1, parts)] if seen else []
        signed = hashed.mapInArrow(partial(sign, send(bounds)), schema).repartitionById(parts, "part")
    else:
        signed = signed.coalesce(1)
    return signed.sortWithinPartitions("telling", "h").select(key, "n", "ids")


def pack_table(df: DataFrame, encoder: Callable[[], WordBpe], key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """One row per piece; sequence ids are unique over the table.

    With ``keep`` a worker remembers the words that it has learnt for its next task:
    faster, but not for a job whose workers have other work to do in that memory.
    """

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        keys, docs, tokens, sequences = [], [], 0, 0

        def flush():
            nonlocal sequences
            columns = [[] for _ in range(7)]
            last = -1
            for doc, start, length, sequence, offset in pack(docs):
                row = (keys[doc], start, length, zlib.crc32(docs[doc][start : start + length]), len(docs[doc]), base + sequences + sequence, offset)
                for column, value in zip(columns, row):
                    column.append(value)
                last = sequence
            sequences += last + 1
            return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys.append(k)
                docs.append(widened(ids, n))
                tokens += n
                if len(docs) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    yield flush()
                    keys, docs, tokens = [], [], 0
        if docs:
            yield flush()
        docs.clear()
        give_back_memory()

    encoded = materialise(encoded_table(df, encoder, key, text, keep), "ids", compression="none", **{"parquet.enable.dictionary": "false"})
    return dealt(encoded, key).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {SCHEMA}")


_encoders: dict[tuple[str, int, bool], WordBpe] = {}


def opened(path: str | None, limit: int, special: bool) -> WordBpe:
    """The tokenizer at a path, kept by the worker process; a function of the module, so that tasks share what it keeps."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if (path, limit, special) not in _encoders:
        _encoders[path, limit, special] = WordBpe(path, limit, special)
    return _encoders[path, limit, special]


def encoder_for(path: str | None = None, units: int = UNITS, special: bool = True) -> Callable[[], WordBpe]:
    """Opens the tokenizer at ``path`` (the public word-end file by default) where it is used.

    It remembers ``units`` at most; with ``special`` the names of special tokens in a text are those tokens, as the
    library has it by default, without they are plain text.
    """
    return partial(opened, path, units, special)


def op9_packing_bm25(spark, sf_dir: str) -> DataFrame:
    return pack_table(documents(spark, sf_dir), encoder_for(), keep=True)
