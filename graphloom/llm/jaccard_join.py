"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct runs of ``shingle`` words. Two
documents link when 100 * |intersection| >= ``percent`` * |union|; ``Rule`` has both.
Elements have one order everywhere: elements that a fixed-size sketch of counts over
all documents shows to be common come last, otherwise by hash. Linked sets share an
element among the first ``n - ceil(percent / 100 * n) + 1`` of each (the *prefix*).

1. Equal sets are collapsed; of the rest, prefix elements that two documents have
   are found over all shards.
2. Documents of a shard with the same prefix and size become one group, with a bit
   for each part of the hash range (more parts for larger sets): whether its members'
   elements there are odd in number. Parts that differ hold an element that only one
   set has. Groups that share a prefix element are compared by size, by place of
   the element and by those bits; what passes ties groups to clusters. Sets have parts
   enough that unrelated ones of any size practically never pass: a few that do would tie
   a large table's documents to one cluster.
3. Clusters are expanded: their members' whole sets meet and are verified exactly, as
   counts of common elements by matrix products. Links become components.

An element shared by more than ``BLOCK`` groups is dealt as pairs of blocks; members of
a large cluster meet its leader first, and only those that don't link with it meet all
members, by pairs of blocks. Tasks send forests of links, not pairs.

Defined results: null texts and texts without words have an empty set, link with
nothing and are their own component; with fewer words than a shingle the whole
sequence is the one element; equal rows count once in links; different texts of one
id link each, under that id, and each row is returned with the component of its own
text; null ids link with nothing; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.components import components
from graphloom.llm.memos import claim
from graphloom.llm.repeats import ANSWER, _bucket_of, _pack, _table
from graphloom.llm.shared import documents, materialise, shard_count, shard_of
from graphloom.llm.textkit import U64, WordHashes, encode, mix, shingles

#: Documents and bytes of text of a shard; groups of an element that meet in one task.
SHARD_DOCS, SHARD_BYTES, BLOCK = 2048, 32 << 20, 1024
#: Members of a cluster that meet as a whole, and of a block where they meet a leader; of a block where the others meet.
MEMBERS, REST = 96, 96
#: Words that are hashed together.
CHUNK = 32_768
#: Counters of the sketch and the pieces it is added up in; least and most parts of the hash range that have a bit.
COUNTERS, PIECES, PARTS = 1 << 20, 64, (512, 16_384)
#: Groups of an element that are compared one by one; more are compared as arrays.
FEW = 12
ELEMENTS, SETS = 0, 1
DOC, GROUP, MEMBER = 0, 1, 2

PACKED = "bucket int, shard int, kind int, keys binary, ids binary"
FOUND = "kind int, element long, id long, other long, n int, place int, bounds binary"
_KEY = {ELEMENTS: "V8", SETS: "V16"}


@dataclass(frozen=True)
class Rule:
    """When documents link: words of a shingle, least similarity in percent."""

    shingle: int = 5
    percent: int = 80

    def prefix_length(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def linked(self, common, a, b):
        """100 * common >= percent * (a + b - common), in whole numbers."""
        return (100 + self.percent) * common >= self.percent * (a + b)

    def near(self, apart, total):
        """Whether sets of ``total`` elements together, of which ``apart`` at least are in one only, can link."""
        return (100 + self.percent) * apart <= (100 - self.percent) * total


def element_sets(texts: Iterable[str | None], hashes: WordHashes, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word runs; the words of several texts are hashed together."""
    held: list[list[bytes]] = []
    size = 0

    def close() -> Iterator[np.ndarray]:
        ids = hashes.of(list(chain.from_iterable(held)))
        runs = shingles(ids, shingle)
        start = 0
        for words in held:
            n = len(words)
            if n >= shingle:
                x = np.sort(runs[start : start + n - shingle + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            else:
                yield shingles(ids[start : start + n], n, salt=n) if n else np.empty(0, np.uint64)
            start += n

    for text in texts:
        held.append(encode(text).lower().split())
        size += len(held[-1])
        if size >= CHUNK:
            yield from close()
            held, size = [], 0
    yield from close()


def _counter(elements: np.ndarray) -> np.ndarray:
    return (mix(elements ^ U64(0x5851F42D4C957F2D)) >> U64(44)).astype(np.int64)


def prefix(elements: np.ndarray, heat: np.ndarray, rule: Rule) -> np.ndarray:
    """The first elements of a set in the common order, in that order."""
    key = heat[_counter(elements)].astype(np.uint64) << U64(58) | elements >> U64(6)
    return elements[np.argsort(key, kind="stable")[: rule.prefix_length(len(elements))]]


# ---------------------------------------------------------------- the sketch


def _count(shingle: int, batches):
    claim("jaccard")
    counts, hashes = np.zeros(COUNTERS, np.int64), WordHashes()
    for batch in batches:
        for elements in element_sets(batch.column(0).to_pylist(), hashes, shingle):
            np.add.at(counts, _counter(elements), 1)
    step = COUNTERS // PIECES
    counts = np.minimum(counts, 2**31 - 1).astype("<i4")
    yield from _table([(i, counts[i * step : (i + 1) * step].tobytes()) for i in range(PIECES)], "piece int, counts binary").to_batches()


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(counts, "<i4").astype(np.int64)
            total[piece] = total[piece] + x if piece in total else x
    yield from _table([(p, x.astype("<i8").tobytes()) for p, x in total.items()], "piece int, counts binary").to_batches()


def heat_levels(docs: DataFrame, rule: Rule, text: str = "text") -> np.ndarray:
    """For each counter 0, or how often its count doubles four times the mean: from one pass over all documents."""
    pieces = docs.select(text).mapInArrow(partial(_count, rule.shingle), "piece int, counts binary").repartition("piece").mapInArrow(_add, "piece int, counts binary").toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    step = COUNTERS // PIECES
    for piece, x in zip(pieces["piece"].to_pylist(), pieces["counts"].to_pylist()):
        counts[piece * step : (piece + 1) * step] += np.frombuffer(x, "<i8")
    usual = 4 * max(counts.mean(), 4.0)
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1, 0, 31).astype(np.uint8)


# ---------------------------------------------------------------- shared elements


def _set_hash(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def _prefixes(count: int, heat, rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        claim("jaccard")
        hashes, shard = WordHashes(), table.column("shard")[0].as_py()
        sets: dict[bytes, tuple[int, np.ndarray]] = {}
        for doc, e in zip(table.column("id").to_pylist(), element_sets(table.column("text").to_pylist(), hashes, rule.shingle)):
            if doc is None or not len(e):
                continue
            h = _set_hash(e)
            if h not in sets:
                sets[h] = doc, prefix(e, heat.value, rule)
            elif doc < sets[h][0]:
                sets[h] = doc, sets[h][1]
        if not sets:
            return _table([], PACKED)
        docs = np.array([d for d, _ in sets.values()], np.int64)
        keys = np.concatenate([p for _, p in sets.values()])
        of = np.repeat(docs, [len(p) for _, p in sets.values()])
        order = np.lexsort((of, keys))
        keys, of = keys[order], of[order]
        # two documents of a shard suffice to show that an element is shared
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        pick = np.unique(np.concatenate((start, np.minimum(start + 1, len(keys) - 1))))
        pick = pick[(pick == 0) | np.isin(pick, start) | (keys[pick] == keys[np.maximum(pick - 1, 0)])]
        keys, of = keys[pick].copy(), of[pick]
        rows = [r[:5] for r in _pack(shard, ELEMENTS, keys.view("V8"), _bucket_of(keys.view("V8"), count), of, of)]
        same = np.frombuffer(b"".join(sets), "V16")
        rows += [r[:5] for r in _pack(shard, SETS, same, _bucket_of(same, count), docs, docs)]
        return _table(rows, PACKED)

    return run


def _meet(batches):
    """Elements and sets of two documents or more, sent back to the shards that have them."""
    now, held = None, []

    def close():
        rows = []
        if held:
            kind = now[1]
            keys = np.concatenate([np.frombuffer(k, _KEY[kind]) for _, k, _ in held])
            shards = np.repeat([s for s, _, _ in held], [len(k) // keys.itemsize for _, k, _ in held])
            ids = np.frombuffer(b"".join(x for _, _, x in held), "<i8")
            if kind == ELEMENTS:
                every, place = np.unique(keys.view("<u8"), return_inverse=True)
            else:
                every, place = np.unique(keys, return_inverse=True)
            least, most = np.full(len(every), np.iinfo(np.int64).max), np.full(len(every), np.iinfo(np.int64).min)
            np.minimum.at(least, place, ids)
            np.maximum.at(most, place, ids)
            order = np.flatnonzero(least[place] < (most[place] if kind == ELEMENTS else ids))
            order = order[np.argsort(shards[order], kind="stable")]
            targets, begin = np.unique(shards[order], return_index=True)
            for t, s, e in zip(targets.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
                i = order[s:e]
                rows.append((t, kind, keys[i].tobytes(), least[place[i]].tobytes()))
        return rows

    for batch in batches:
        rows = []
        for bucket, shard, kind, keys, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (bucket, kind) != now:
                rows += close()
                now, held = (bucket, kind), []
            held.append((shard, keys, ids))
        yield from _table(rows, ANSWER).to_batches() if rows else ()
    if rows := close():
        yield from _table(rows, ANSWER).to_batches()


# ---------------------------------------------------------------- groups


def _parts_for(n: int) -> int:
    """Parts of a set of ``n`` elements: enough for unrelated sets to differ by more than linked ones may."""
    return min(max(PARTS[0], 1 << (5 * n // 8).bit_length()), PARTS[1])


def _parts(elements: np.ndarray) -> np.ndarray:
    """For each part a bit: whether it has an odd number of elements."""
    k = _parts_for(len(elements))
    return np.packbits(np.bincount((elements & U64(k - 1)).astype(np.int64), minlength=k).astype(np.uint8) & 1)


def _halved(bits: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of ``k`` parts from those of more: two parts that become one are odd together if one of them is."""
    while 8 * len(bits) > k:
        half = len(bits) // 2
        bits, known = bits[:half] ^ bits[half:], known[:half] & known[half:]
    return bits, known


def _bits(bounds: bytes, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of ``k`` parts of a group's members, and in which parts they all have the same."""
    own = _parts_for(n) // 8
    bits = np.frombuffer(bounds[:own], np.uint8)
    return _halved(bits, np.frombuffer(bounds[own:], np.uint8) if len(bounds) > own else np.full(own, 255, np.uint8), k)


def _groups(heat, rule: Rule):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u8") for k, x in zip(answers.column("keys").to_pylist(), answers.column("kind").to_pylist()) if x == ELEMENTS]
        shared = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        same = [(np.frombuffer(k, "V16"), np.frombuffer(v, "<i8")) for k, v, x in zip(answers.column("keys").to_pylist(), answers.column("low").to_pylist(), answers.column("kind").to_pylist()) if x == SETS]
        first = {k.tobytes(): int(d) for ks, ds in same for k, d in zip(ks, ds)}
        hashes, rows, done = WordHashes(), [], set()
        sets = [(doc, e, _set_hash(e) if len(e) else b"") for doc, e in zip(docs.column("id").to_pylist(), element_sets(docs.column("text").to_pylist(), hashes, rule.shingle))]
        for doc, _, h in sets:
            if doc is not None and h:
                first[h] = min(doc, first.get(h, doc))
        groups: dict[tuple, list] = {}
        for doc, e, h in sets:
            rep = first[h] if doc is not None and h else doc
            rows.append((DOC, None, doc, rep, len(e), None, None))
            if doc is None or not h or rep != doc or h in done:
                continue
            done.add(h)
            p = prefix(e, heat.value, rule)
            i = np.minimum(np.searchsorted(shared, p), max(len(shared) - 1, 0))
            at = np.flatnonzero(shared[i] == p) if len(shared) else np.empty(0, int)
            if not len(at):
                continue
            x = _parts(e)
            group = groups.setdefault((len(e), p.tobytes()), [doc, p, at, x, np.full(len(x), 255, np.uint8), []])
            group[0] = min(group[0], doc)
            group[4] &= ~(group[3] ^ x)
            group[5].append(doc)
        for (n, _), (lead, p, at, bits, known, members) in groups.items():
            bounds = bits.tobytes() if len(members) == 1 else bits.tobytes() + known.tobytes()
            rows += [(GROUP, int(v), lead, None, n, int(k), bounds) for k, v in zip(at.tolist(), p[at].view(np.int64).tolist())]
            rows += [(MEMBER, None, m, lead, None, None, None) for m in members if m != lead]
        return _table(rows, FOUND)

    return run


def _root(pairs: np.ndarray) -> np.ndarray:
    """Least place that each place reaches, for a symmetric boolean matrix."""
    label = np.arange(len(pairs))
    while True:
        now = np.minimum(label, np.where(pairs, label[None, :], len(pairs)).min(axis=1))
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _streamed(columns: int, work):
    """Batches sorted by their first three columns -> edges of each run of equal ones."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(columns))):
                if row[:3] != now:
                    out += work(now, held) if len(held) > 1 else []
                    now, held = row[:3], []
                held.append(row[3:])
            yield from _table(out, "a long, b long").to_batches() if out else ()
        if len(held) > 1 and (out := work(now, held)):
            yield from _table(out, "a long, b long").to_batches()

    return run


def _edges(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    root = _root(pairs)
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(root.tolist()) if i != r]


def _pass(rule: Rule, a: tuple, b: tuple) -> bool:
    """Whether two groups of one element pass size, place and bits."""
    (_, _, n, place, bits), (_, _, m, other, more) = a, b
    if 100 * min(n, m) < rule.percent * max(n, m) or not rule.linked(min(place, other) + 1 + min(n - place, m - other) - 1, n, m):
        return False
    if len(bits) == len(more) == _parts_for(n) // 8 == _parts_for(m) // 8:
        return rule.near((int.from_bytes(bits) ^ int.from_bytes(more)).bit_count(), n + m)
    k = min(_parts_for(n), _parts_for(m))
    (x, known), (y, same) = _bits(bits, n, k), _bits(more, m, k)
    return rule.near(int(np.bitwise_count((x ^ y) & known & same).sum()), n + m)


def _filter(rule: Rule, key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
    """Group pairs of one element that pass size, place and bits."""
    if len(rows) == 2 and (key[1] == key[2] or rows[0][0] != rows[1][0]):
        return [(max(rows[0][1], rows[1][1]), min(rows[0][1], rows[1][1]))] if _pass(rule, *rows) else []
    block, ids, n, place, bounds = zip(*rows)
    block, ids = np.array(block), np.array(ids)
    if len(rows) <= FEW:
        ok = np.zeros((len(rows), len(rows)), bool)
        for i, a in enumerate(rows):
            for j in range(i):
                if key[1] == key[2] or a[0] != rows[j][0]:
                    ok[i, j] = _pass(rule, a, rows[j])
        return _edges(ids, ok | ok.T) if ok.any() else []
    n, place = np.array(n), np.array(place)
    after = n - place - 1
    most = np.minimum(place[:, None], place[None, :]) + 1 + np.minimum(after[:, None], after[None, :])
    ok = (100 * np.minimum(n[:, None], n[None, :]) >= rule.percent * np.maximum(n[:, None], n[None, :])) & rule.linked(most, n[:, None], n[None, :])
    if key[1] != key[2]:
        ok &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(ok, 1))
    ok[:] = False
    own = np.array([_parts_for(k) for k in n.tolist()])
    both = np.minimum(own[i], own[j])
    for k in np.unique(both).tolist():
        has, which = np.flatnonzero(own >= k), np.flatnonzero(both == k)
        at = np.cumsum(own >= k) - 1
        found = [_bits(bounds[r], int(n[r]), k) for r in has.tolist()]
        x, known = (np.array([f[w] for f in found]).view(np.uint64) for w in (0, 1))
        step = (1 << 23) // k
        for s in range(0, len(which), step):
            a, b = i[which[s : s + step]], j[which[s : s + step]]
            apart = np.bitwise_count((x[at[a]] ^ x[at[b]]) & known[at[a]] & known[at[b]]).sum(axis=1, dtype=np.int64)
            ok[a, b] = rule.near(apart, n[a] + n[b])
    return _edges(ids, ok | ok.T) if ok.any() else []


def _common(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many elements each two sets have in common, and how many each has."""
    n = np.array([len(s) // 8 for s in sets])
    elements = np.frombuffer(b"".join(sets), "<u8")
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    fresh = np.concatenate(([True], elements[1:] != elements[:-1])) if len(elements) else np.empty(0, bool)
    column = np.cumsum(fresh) - 1
    counts = np.bincount(column)
    useful = counts > 1
    number = np.cumsum(useful) - 1
    keep = useful[column]
    column, owner = number[column[keep]], owner[keep]
    common = np.zeros((len(n), len(n)), np.float32)
    bounds = np.searchsorted(column, np.arange(0, int(useful.sum()) + 4096, 4096))
    for k in range(len(bounds) - 1):
        s, e = bounds[k], bounds[k + 1]
        if s < e:
            x = np.zeros((len(n), 4096), np.float32)
            x[owner[s:e], column[s:e] - 4096 * k] = 1
            common += x @ x.T
    return common.astype(np.int64), n


def _verify(rule: Rule, key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
    """Exact links among the members of a cluster, or between its members of part 0 and those of part 1."""
    part, ids, sets = zip(*rows)
    part, ids = np.array(part), np.array(ids)
    common, n = _common(sets)
    ok = rule.linked(common, n[:, None], n[None, :])
    if key[1] >= 0:
        ok &= part[:, None] != part[None, :]
    np.fill_diagonal(ok, False)
    return _edges(ids, ok) if ok.any() else []


def _led(rule: Rule, key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
    """Members of a block of a cluster, each with the leader if they link, else with null."""
    leaders = [np.frombuffer(s, "<u8") for p, _, s in rows if p == 1]
    out = []
    for p, i, s in rows:
        if p == 0:
            x, linked = np.frombuffer(s, "<u8"), False
            for own in leaders:  # one, or the texts of a repeated id
                at = np.minimum(np.searchsorted(own, x), len(own) - 1)
                linked |= bool(rule.linked(int((own[at] == x).sum()), len(own), len(x)))
            out.append((i, key[0] if linked else None))
    return out


def _links(rule: Rule, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links that tie the members of each cluster as all of its links would.

    A cluster of up to ``MEMBERS`` meets as a whole. In a larger one every member meets
    the leader (its smallest id) first; those that link are one component already, so
    pairs among them need no check: only the others meet all members, by pairs of blocks.
    """
    large = materialise(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > MEMBERS), "large")
    meet = lambda rows, work: rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id").select("cluster", "i", "j", "part", "id", "elements").mapInArrow(_streamed(6, partial(work, rule)), "a long, b long")
    none, number = F.lit(-1), lambda k: F.lit(k).cast("int")
    if large.isEmpty():
        return meet(sets.withColumns({"i": none, "j": none, "part": number(0)}), _verify)
    flagged = materialise(sets.join(large, "cluster", "left"), "sets")
    whole = meet(flagged.filter("m is null").withColumns({"i": none, "j": none, "part": number(0)}), _verify)
    many = flagged.filter("m is not null")
    blocks = F.ceil(F.col("m") / MEMBERS).cast("int")
    members = many.filter("id <> cluster").withColumns({"i": F.pmod(F.xxhash64("id"), blocks).cast("int"), "j": none, "part": number(0)})
    leaders = many.filter("id = cluster").withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"j": none, "part": number(1)})
    met = materialise(meet(members.unionByName(leaders), _led), "led")
    rest = met.filter("b is null").select(F.col("a").alias("id")).distinct()
    rest = materialise(rest.join(clusters, "id"), "rest")
    led = met.filter("b is not null")
    if rest.isEmpty():
        return whole.unionAll(led)
    again = many.join(rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("r")), "cluster")
    wide, tall = F.ceil(F.col("m") / REST).cast("int"), F.ceil(F.col("r") / REST).cast("int")
    place = lambda parts: F.pmod(F.xxhash64("id"), parts).cast("int")
    every = again.withColumns({"j": place(wide), "i": F.explode(F.sequence(F.lit(0), tall - 1)), "part": number(0)})
    others = again.join(rest.select("id"), "id", "left_semi").withColumns({"i": place(tall), "j": F.explode(F.sequence(F.lit(0), wide - 1)), "part": number(1)})
    return whole.unionAll(led).unionAll(meet(every.unionByName(others), _verify))


def _dealt(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of each key, in pairs of blocks where ``ids`` has more than ``BLOCK`` of them.

    Only the large keys are joined, from a table of their own: small, it is broadcast
    by Spark's own check, and the rows are shuffled once.
    """
    large = materialise(ids.groupBy(key).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK), "large")
    parts = F.ceil(F.coalesce(F.col("m"), F.lit(1)) / BLOCK).cast("int")
    out = rows.join(large, key, "left").withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return out.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def _whole_sets(shingle: int, batches):
    hashes = WordHashes()
    for batch in batches:
        sets = [e.astype("<u8").tobytes() for e in element_sets(batch.column(2).to_pylist(), hashes, shingle)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["cluster", "id", "elements"])


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    heat = spark.sparkContext.broadcast(heat_levels(rows, rule))
    shards = shard_count(rows, "text", SHARD_DOCS, SHARD_BYTES)
    dealt = rows.withColumn("shard", shard_of("id", "text", shards))
    packed = dealt.groupBy("shard").applyInArrow(_prefixes(shards, heat, rule), PACKED)
    answers = packed.repartition("bucket").sortWithinPartitions("bucket", "kind", "shard").mapInArrow(_meet, ANSWER)
    found = materialise(dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_groups(heat, rule), FOUND), "groups")

    groups = found.filter(F.col("kind") == GROUP).select("element", "id", "n", "place", "bounds")
    met = _dealt(groups, "element", groups.select("element")).select("element", "i", "j", "block", "id", "n", "place", "bounds")
    ties = met.repartition("element", "i", "j").sortWithinPartitions("element", "i", "j", "id").mapInArrow(_streamed(8, partial(_filter, rule)), "a long, b long")
    members = found.filter(F.col("kind") == MEMBER).select(F.col("id").alias("a"), F.col("other").alias("b"))
    clusters = components(ties.unionAll(members)).select(F.col("node").alias("id"), F.col("component").alias("cluster"))

    clusters = materialise(clusters, "clusters")
    members = rows.join(clusters, "id").dropDuplicates(["id", "text"]).select("cluster", "id", "text")
    sets = members.mapInArrow(partial(_whole_sets, rule.shingle), "cluster long, id long, elements binary")
    links = _links(rule, sets, clusters)
    joined = components(links)

    everyone = found.filter(F.col("kind") == DOC).select("id", "other", "n")
    out = everyone.join(joined.select(F.col("node").alias("other"), "component"), "other", "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "other", "id").alias("component_id"))


#: The rule of the query: three words, 90 percent.
CONTRACT = Rule(3, 90)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), CONTRACT)
