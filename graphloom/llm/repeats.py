"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of a document. A word goes when it lies in
a window whose words also start, in the same order, in a document with a smaller id.

Documents are dealt to shards of about ``SHARD_DOCS`` documents or ``SHARD_BYTES`` of
text by a hash of their id (of their text, where that is null), and three passes run over the shards:

1. *Phrases.* Of every window the ``PHRASE`` consecutive words with the least hash
   are chosen, so equal windows choose equal phrases. Phrases that occur in two
   documents recur; so do whole documents whose word sequences are equal.
2. *Automata.* Each shard compiles an Aho-Corasick automaton of the recurring
   phrases that its own documents chose, and streams its documents through it to
   locate every occurrence. The windows around one are hashed, and the smallest
   document with each window is found over all shards.
3. *Removal.* Each shard gets the windows that recur, with their smallest document,
   looks up all windows of its documents and drops the words they cover.

What shards send to each other is packed per bucket of hashes: a phrase or window
that a third of all documents share is one entry a shard, not one a document.

Defined results: null and empty texts have no word and lose none; documents with
fewer words than a window lose none; rows with equal ids are not compared with each
other; null ids are compared with nothing; other columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.memos import claim
from graphloom.llm.shared import documents, shard_count, shard_of
from graphloom.llm.textkit import U64, WordHashes, encode, mix, shingles, sliding_min

WINDOW, PHRASE = 50, 5
#: Documents and bytes of text of a shard.
SHARD_DOCS, SHARD_BYTES = 2048, 32 << 20
#: Characters that stand for a word in the automaton's texts and bits of each; words hashed together.
LETTERS, LETTER_BITS, CHUNK = 3, 6, 32_768
PHRASES, COPIES, WINDOWS = 0, 1, 2
#: Stands for a null id: no document is smaller.
NEVER = np.iinfo(np.int64).min

PACKED = "bucket int, shard int, kind int, keys binary, low binary, high binary"
ANSWER = "shard int, kind int, keys binary, low binary"
_KEY = {PHRASES: "V20", COPIES: "V16", WINDOWS: "V16"}


def _sequence(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


class Chunk:
    """Documents whose words are hashed as one array; windows never cross their edges."""

    def __init__(self, words: list[list[bytes]], hashes: WordHashes):
        self.ids = hashes.of(list(chain.from_iterable(words)))
        size = np.array([len(w) for w in words])
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.doc = np.repeat(np.arange(len(words)), size)

    def whole(self) -> np.ndarray:
        """Which window starts have all of their words in one document."""
        n = len(self.ids) - WINDOW + 1
        return self.doc[:n] == self.doc[WINDOW - 1 :] if n > 0 else np.empty(0, bool)


def chunks(docs: list[tuple[int, list[bytes]]], hashes: WordHashes):
    """(documents, their Chunk) with about ``CHUNK`` words each."""
    held, size = [], 0
    for item in docs:
        held.append(item)
        size += len(item[-1])
        if size >= CHUNK:
            yield held, Chunk([x[-1] for x in held], hashes)
            held, size = [], 0
    if held:
        yield held, Chunk([x[-1] for x in held], hashes)


def chosen(ids: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Places of the phrases that the (``whole``) windows of these word hashes choose."""
    if len(ids) < WINDOW:
        return np.empty(0, np.int64)
    x = shingles(ids, PHRASE)
    span = WINDOW - PHRASE + 1
    least = sliding_min(x, span)
    if whole is not None:
        least[~whole] = 0
    edge = np.zeros(span - 1, np.uint64)
    most = ~sliding_min(~np.concatenate((edge, least, edge)), span)
    return np.flatnonzero(x == most)


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window, by doubling; needs at least one window."""
    a, n = U64(0x9E3779B97F4A7C15), len(ids) - WINDOW + 1
    cur, parts, span = mix(ids), {}, 1
    while span <= 32:
        parts[span] = cur
        cur = mix(cur[:-span] * a + cur[span:]) if len(cur) > span else cur[:0]
        span *= 2
    x, y, z = parts[32][:n], parts[16][32 : 32 + n], parts[2][48 : 48 + n]
    return mix(mix(x * a + y) * a + z), mix(mix(z * a + x) + y * U64(0xC2B2AE3D27D4EB4F))


def _letters(ids: np.ndarray) -> str:
    """Each word as ``LETTERS`` characters of a small alphabet."""
    shifts = np.arange(LETTERS, dtype=np.uint64) * U64(LETTER_BITS)
    return ((ids[:, None] >> shifts & U64((1 << LETTER_BITS) - 1)).astype(np.uint8) + 48).tobytes().decode("ascii")


def _reduce(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest and largest document."""
    every, place = np.unique(keys, return_inverse=True)
    low, high = np.full(len(every), np.iinfo(np.int64).max), np.full(len(every), np.iinfo(np.int64).min)
    np.minimum.at(low, place, docs)
    np.maximum.at(high, place, docs)
    return every, low, high


def _pack(shard: int, kind: int, keys: np.ndarray, buckets: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
    order = np.argsort(buckets, kind="stable")
    every, begin = np.unique(buckets[order], return_index=True)
    ends = [*begin[1:].tolist(), len(order)]
    return [(int(b), shard, kind, keys[i].tobytes(), low[i].tobytes(), high[i].tobytes()) for b, i in ((b, order[s:e]) for b, s, e in zip(every, begin.tolist(), ends))]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _bucket_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Bucket of each key by its first eight bytes."""
    first = np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), -1)[:, :8].copy().view("<u8")[:, 0]
    return (mix(first) % U64(count)).astype(np.int64)


def _phrases(count: int):
    def run(table: pa.Table) -> pa.Table:
        claim("repeats")
        hashes = WordHashes()
        shard = table.column("shard")[0].as_py()
        keys, docs, copies, copied = [], [], [], []
        read = ((doc, encode(text).split()) for doc, text in zip(table.column("id").to_pylist(), table.column("text").to_pylist()) if doc is not None)
        for part, chunk in chunks((x for x in read if len(x[1]) >= WINDOW), hashes):
            at = chosen(chunk.ids, chunk.whole())
            short = chunk.ids.astype("<u4")
            keys.append(np.ascontiguousarray(np.stack([short[at + j] for j in range(PHRASE)], axis=1)).view("V20")[:, 0])
            docs.append(np.array([d for d, _ in part], np.int64)[chunk.doc[at]])
            copies += [_sequence(words) for _, words in part]
            copied += [d for d, _ in part]
        rows = []
        if keys:
            k, low, high = _reduce(np.concatenate(keys), np.concatenate(docs))
            rows += _pack(shard, PHRASES, k, _bucket_of(k, count), low, high)
            k, low, high = _reduce(np.frombuffer(b"".join(copies), "V16"), np.array(copied, np.int64))
            rows += _pack(shard, COPIES, k, _bucket_of(k, count), low, high)
        return _table(rows, PACKED)

    return run


def _meet(batches):
    """Per bucket and kind: keys of two documents or more, sent back to each shard that has them and a later document."""
    now, held = None, []

    def close():
        rows = []
        if held:
            kind = now[1]
            keys = [np.frombuffer(k, _KEY[kind]) for _, k, _, _ in held]
            shards = np.repeat([s for s, *_ in held], [len(k) for k in keys])
            keys = np.concatenate(keys)
            low = np.frombuffer(b"".join(x for _, _, x, _ in held), "<i8")
            high = np.frombuffer(b"".join(x for _, _, _, x in held), "<i8")
            every, place = np.unique(keys, return_inverse=True)
            least, most = np.full(len(every), np.iinfo(np.int64).max), np.full(len(every), np.iinfo(np.int64).min)
            np.minimum.at(least, place, low)
            np.maximum.at(most, place, high)
            back = least[place] < most[place] if kind == PHRASES else least[place] < high
            order = np.flatnonzero(back)
            order = order[np.argsort(shards[order], kind="stable")]
            targets, begin = np.unique(shards[order], return_index=True)
            for t, s, e in zip(targets.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
                i = order[s:e]
                rows.append((t, kind, keys[i].tobytes(), least[place[i]].tobytes()))
        return rows

    for batch in batches:
        rows = []
        for bucket, shard, kind, keys, low, high in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (bucket, kind) != now:
                rows += close()
                now, held = (bucket, kind), []
            held.append((shard, keys, low, high))
        yield from _table(rows, ANSWER).to_batches() if rows else ()
    if rows := close():
        yield from _table(rows, ANSWER).to_batches()


def _answers(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k, _KEY[kind]) for k, x in zip(table.column("keys").to_pylist(), table.column("kind").to_pylist()) if x == kind]
    low = [np.frombuffer(v, "<i8") for v, x in zip(table.column("low").to_pylist(), table.column("kind").to_pylist()) if x == kind]
    return (np.concatenate(keys), np.concatenate(low)) if keys else (np.empty(0, _KEY[kind]), np.empty(0, np.int64))


def _earlier_copies(answers: pa.Table) -> dict[bytes, int]:
    keys, low = _answers(answers, COPIES)
    return {k.tobytes(): d for k, d in zip(keys, low.tolist())}


def automaton(phrases: np.ndarray):
    """Aho-Corasick automaton of packed phrases (``PHRASE`` unsigned 32-bit words each); None without any."""
    if not len(phrases):
        return None
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    words = np.frombuffer(phrases.tobytes(), "<u4").astype(np.uint64)
    text, step = _letters(words), LETTERS * PHRASE
    for i in range(0, len(text), step):
        out.add_word(text[i : i + step])
    out.make_automaton()
    return out


def occurrences(machine, ids: np.ndarray) -> np.ndarray:
    """Words at which a phrase of the automaton begins."""
    ends = np.fromiter((e for e, _ in machine.iter(_letters(ids))), dtype=np.int64)
    ends = ends[(ends + 1) % LETTERS == 0]
    return (ends + 1) // LETTERS - PHRASE


def _windows(count: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        copies = _earlier_copies(answers)
        machine = automaton(np.unique(_answers(answers, PHRASES)[0]))
        if machine is None or not docs.num_rows:
            return _table([], PACKED)
        hashes, shard = WordHashes(), docs.column("shard")[0].as_py()
        keys, ids_of = [], []
        read = ((doc, encode(text).split()) for doc, text in zip(docs.column("id").to_pylist(), docs.column("text").to_pylist()) if doc is not None)
        # an equal document with a smaller id has the same windows
        for part, chunk in chunks((x for x in read if len(x[1]) >= WINDOW and copies.get(_sequence(x[1]), x[0]) >= x[0]), hashes):
            at = occurrences(machine, chunk.ids)
            at = at[chunk.doc[at] == chunk.doc[at + PHRASE - 1]]
            first = np.maximum(at + PHRASE - WINDOW, chunk.starts[chunk.doc[at]])
            last = np.minimum(at, chunk.ends[chunk.doc[at]] - WINDOW)
            edge = np.zeros(len(chunk.ids) + 1, np.int64)
            np.add.at(edge, first[first <= last], 1)
            np.add.at(edge, last[first <= last] + 1, -1)
            near = np.flatnonzero(np.cumsum(edge) > 0)
            if len(near):
                w, v = windows(chunk.ids)
                keys.append(np.ascontiguousarray(np.stack((w[near], v[near]), axis=1)).view("V16")[:, 0])
                ids_of.append(np.array([d for d, _ in part], np.int64)[chunk.doc[near]])
        if not keys:
            return _table([], PACKED)
        k, low, high = _reduce_windows(np.concatenate(keys), np.concatenate(ids_of))
        return _table(_pack(shard, WINDOWS, k, _bucket_of(k, count), low, high), PACKED)

    return run


def _reduce_windows(keys: np.ndarray, docs: np.ndarray):
    """As ``_reduce``, sorting by the two hashes as numbers."""
    pair = keys.view("<u8").reshape(-1, 2)
    order = np.lexsort((docs, pair[:, 1], pair[:, 0]))
    pair, docs = pair[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]).any(axis=1))))
    last = np.concatenate((first[1:], [len(docs)])) - 1
    return keys[order[first]], docs[first], docs[last]


def digests(words: list[bytes], covered: np.ndarray) -> tuple:
    kept = words if not covered.any() else [w for w, c in zip(words, covered.tolist()) if not c]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


DIGESTS = "n_words long, n_removed long, kept_sha256 string"


def kept_text(words: list[bytes], covered: np.ndarray) -> tuple:
    """Words removed, and the words that stay joined by one space; null where nothing goes."""
    gone = int(covered.sum())
    return gone, b" ".join(w for w, c in zip(words, covered.tolist()) if not c).decode("utf-8", "replace") if gone else None


KEPT = "n_removed long, kept string"


def _removal(finish: Callable, made: str, carried: list[str]):
    schema = f"id long, {made}"

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        copies = _earlier_copies(answers)
        keys, low = _answers(answers, WINDOWS)
        pair = keys.view("<u8").reshape(-1, 2)
        order = np.argsort(pair[:, 0], kind="stable")
        first, second, low = pair[order, 0].copy(), pair[order, 1].copy(), low[order]
        hashes, rows = WordHashes(), []
        read = ((doc, encode(text).split()) for doc, text in zip(docs.column("id").to_pylist(), docs.column("text").to_pylist()))
        for part, chunk in chunks(read, hashes):
            covered = np.zeros(len(chunk.ids), bool)
            if len(first) and (whole := chunk.whole()).any():
                w, v = windows(chunk.ids)
                i = np.minimum(np.searchsorted(first, w), len(first) - 1)
                own = np.array([NEVER if d is None else d for d, _ in part], np.int64)[chunk.doc[: len(w)]]
                gone = np.flatnonzero((first[i] == w) & (second[i] == v) & (low[i] < own) & whole)
                edge = np.zeros(len(chunk.ids) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + WINDOW, -1)
                covered = np.cumsum(edge[:-1]) > 0
            for (doc, words), s, e in zip(part, chunk.starts.tolist(), chunk.ends.tolist()):
                mine = covered[s:e]
                if copies and doc is not None and e - s >= WINDOW and copies.get(_sequence(words), doc) < doc:
                    mine = np.ones(e - s, bool)
                rows.append((doc, *finish(words, mine)))
        out = _table(rows, schema)
        for name in carried:
            out = out.append_column(name, docs.column(name))
        return out

    return run, schema


def remove_repeats(docs: DataFrame, finish: Callable = digests, made: str = DIGESTS, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, what ``finish(words, covered)`` makes of each document (``made`` names its columns), and the ``carry`` columns."""
    shards = shard_count(docs, text, SHARD_DOCS, SHARD_BYTES)
    also = {f"carried_{i}": F.col(c) for i, c in enumerate(carry)}
    dealt = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), *(c.alias(n) for n, c in also.items())).withColumn("shard", shard_of("id", "text", shards))
    meet = lambda packed: packed.repartition("bucket").sortWithinPartitions("bucket", "kind", "shard").mapInArrow(_meet, ANSWER)
    recurring = meet(dealt.groupBy("shard").applyInArrow(_phrases(shards), PACKED))
    located = dealt.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(_windows(shards), PACKED)
    answers = recurring.filter(F.col("kind") == COPIES).unionAll(meet(located))
    run, schema = _removal(finish, made, list(also))
    schema = ", ".join([schema, *(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name in also)])
    return dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, schema).withColumnsRenamed(dict(zip(also, carry)))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
