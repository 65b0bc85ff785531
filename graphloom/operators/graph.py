"""Graph layers: normalisation, mixing, propagation, neighbourhoods, evidence paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.functions.text import runs
from graphloom.operators.history import symmetric

ALPHA, DAMPING, STEPS, SEEDS, BETA = 0.25, 0.5, 10, 20, 0.5


def row_normalized(edges: DataFrame, weight: str = "w") -> DataFrame:
    """src, dst, w in both directions, each row summing to 1; weights of 0 or less are dropped."""
    both = symmetric(edges.withColumn("w", F.col(weight).cast("double")).filter("w > 0"), "w")
    return both.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("src")))


def mix_rows(static: DataFrame, temporal: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """alpha * static + (1 - alpha) * temporal; a node of one layer only keeps that layer's share.

    At alpha 1 or 0 (or beyond) the layer itself, unscaled.
    """
    if alpha >= 1:
        return static
    if alpha <= 0:
        return temporal
    scaled = static.select("src", "dst", (F.col("w") * alpha).alias("w")).unionAll(temporal.select("src", "dst", (F.col("w") * (1 - alpha)).alias("w")))
    return scaled.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def blend(rows: DataFrame, extra: DataFrame, share: float = 0.1) -> DataFrame:
    """(1 - share) * rows + share * extra; untouched when the extra layer is empty."""
    return rows if extra.isEmpty() else mix_rows(extra, rows, share)


def confidence(pairs: DataFrame, priors: DataFrame) -> DataFrame:
    """src, dst, w = decayed / sqrt((1 + freq of src) * (1 + freq of dst))."""
    f = priors.select("file", "freq")
    both = pairs.join(f.withColumnsRenamed({"file": "src", "freq": "fa"}), "src").join(f.withColumnsRenamed({"file": "dst", "freq": "fb"}), "dst")
    return both.select("src", "dst", (F.col("decayed") / F.sqrt((1 + F.col("fa")) * (1 + F.col("fb")))).alias("w"))


def dir_chain(tree: DataFrame, low: int = 2, high: int = 40) -> DataFrame:
    """Edges between neighbours in the sorted files of directories with ``low`` to ``high`` members."""
    fit = tree.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(low, high))
    following = F.lead("file").over(W.partitionBy("dir").orderBy("path"))
    chained = tree.join(fit, "dir", "left_semi").select(F.col("file").alias("a"), following.alias("b")).filter("b is not null")
    return chained.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit(1.0).alias("w"))


def seed_vector(ranking: DataFrame, nodes: DataFrame | None = None, top: int = SEEDS) -> DataFrame:
    """qid, node, s: the top scores of each list over their sum (1 where that is 0).

    The sum is over all listed files; the share of files outside ``nodes`` is lost.
    """
    head = ranking.filter(F.col("rank") <= top)
    total = F.sum("score").over(W.partitionBy("qid"))
    seeds = head.select("qid", F.col("file").alias("node"), (F.col("score") / F.when(total == 0, 1.0).otherwise(total)).alias("s"))
    return seeds if nodes is None else seeds.join(nodes.select(F.col("file").alias("node")), "node", "left_semi").select("qid", "node", "s")


#: Edges of a block of nodes at most, groups of blocks and queries to have at least, rows that are packed and products
#: that are held at once.
BLOCK_EDGES, GROUPS, PACKED, HELD = 1_000_000, 24, 500_000, 4_000_000


def ppr(rows: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """qid, node, p: personalised propagation of all queries at once.

    A node without a row keeps its damped mass; entries of 0 or less don't spread. Nodes are dealt in blocks of
    neighbouring numbers (others by hash), queries by hash where there are few blocks. A step multiplies the arrays of a
    group with the edges of its block, and sends on one sum for each node and query that it reaches; the edges are dealt once.
    Lineage is cut before the first step: with the plans of edges and seeds in each, planning took longer than the steps.
    """
    kind = {c: df.schema[c].dataType for df, c in ((rows, "src"), (seeds, "node"), (seeds, "qid"))}
    numbers = all(kind[c].typeName() in ("byte", "short", "integer", "long") for c in ("src", "node"))
    # sizes and bounds only choose how work is dealt
    ends = (F.least(F.min("src"), F.min("dst")), F.greatest(F.max("src"), F.max("dst"))) if numbers else (F.lit(0), F.lit(0))
    n, low, high = rows.agg(F.count(F.lit(1)), *ends).first()
    n_blocks = max(1, -(-n // BLOCK_EDGES))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // n_blocks))
    parts = max(1, -(-GROUPS // n_blocks))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    block = lambda c: F.pmod(F.floor((F.col(c) - F.lit(low or 0)) / width) if numbers else F.hash(c), F.lit(n_blocks)).cast("int")
    entry = pa.schema([("qid", to_arrow_type(kind["qid"])), ("node", to_arrow_type(kind["node"])), ("p", pa.float64())])
    edge = pa.schema([("node", entry.field("node").type), ("dst", entry.field("node").type), ("to", pa.int32()), ("w", pa.float64())])

    packed = rows.select(block("src").alias("at"), F.col("src").cast(kind["node"]).alias("node"), F.col("dst").cast(kind["node"]).alias("dst"), block("dst").alias("to"), F.col("w").cast("double").alias("w")).mapInArrow(lambda b: pack(b, edge), PIECE).checkpoint()
    dealt = packed.select(F.explode(F.sequence(F.col("at") * parts, F.col("at") * parts + (parts - 1))).alias("at"), "data").repartition(tasks, "at")
    placed = lambda p: seeds.select((block("node") * parts + F.pmod(F.hash("qid"), F.lit(parts))).cast("int").alias("at"), "qid", "node", p.cast("double").alias("p")).mapInArrow(lambda b: pack(b, entry), PIECE).checkpoint()
    again = placed(F.col("s") * (1 - damping))

    def step(state: pa.Table, edges: pa.Table) -> pa.Table:
        if not state.num_rows:
            return state
        at = state.column("at")[0].as_py()
        qids, nodes, p = unpack(state, entry)
        q, shown = coded(qids)
        live = np.flatnonzero(p > 0)
        out: list[tuple] = []
        degree = np.zeros(len(nodes), "i8")  # of the node of each entry
        if edges.num_rows:
            src, dst, to, w = unpack(edges, edge)
            both, _ = coded(pa.concat_arrays([nodes, src]))
            node, source = both[: len(nodes)], both[len(nodes) :]
            by = np.argsort(source, kind="stable")
            held = np.bincount(source, minlength=both.max() + 1)
            degree, begin = held[node], (np.cumsum(held) - held)[node]
            target, first = coded(dst)
            names, blocks = dst.take(pa.array(first)), to.to_numpy()[first]
            target, weight = target[by], w[by]
            # entries go by query, a few million products at once; equal pairs of query and node are summed where they meet
            live = live[np.argsort(q[live], kind="stable")]
            upto = np.cumsum(degree[live])
            lo = 0
            while lo < len(live):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + HELD, "right")))
                mine = live[lo:hi]
                each, base, span = degree[mine], q[mine[0]], q[mine[-1]] - q[mine[0]] + 1
                there = runs(begin[mine], each)
                key = np.repeat(q[mine] - base, each) * len(first) + target[there]
                value = np.repeat(p[mine] * damping, each) * weight[there]
                if span * len(first) <= 8 * len(key):
                    sums, met = np.bincount(key, value, span * len(first)), np.zeros(span * len(first), bool)
                    met[key] = True
                    key = np.flatnonzero(met)
                    value = sums[key]
                else:
                    key, inverse = np.unique(key, return_inverse=True)
                    value = np.bincount(inverse, value, len(key))
                to_block = blocks[key % len(first)]
                order = np.argsort(to_block, kind="stable")
                key, value = key[order], value[order]
                found = pa.record_batch([qids.take(pa.array(shown[key // len(first) + base])), names.take(pa.array(key % len(first))), pa.array(value)], schema=entry)
                out += cut(to_block[order].astype("i8") * parts + at % parts, found)
                lo = hi
        alone = live[degree[live] == 0]
        if len(alone):
            found = pa.record_batch([qids.take(pa.array(alone)), nodes.take(pa.array(alone)), pa.array(p[alone] * damping)], schema=entry)
            out += cut(np.full(len(alone), at), found)
        return pa.table({"at": pa.array([x for x, _ in out], pa.int32()), "data": pa.array([x for _, x in out], pa.binary())})

    def total(state: pa.Table) -> pa.Table:
        qids, nodes, p = unpack(state, entry)
        (q, _), (node, names) = coded(qids), coded(nodes)
        _, first, inverse = np.unique(q * max(len(names), 1) + node, return_index=True, return_inverse=True)
        return pa.table([qids.take(pa.array(first)), nodes.take(pa.array(first)), pa.array(np.bincount(inverse, p, len(first)))], schema=entry)

    def merged(state: pa.Table, edges: pa.Table) -> pa.Table:
        """A step from entries that are summed first: each pair of query and node spreads as one."""
        if not state.num_rows:
            return state
        at = state.column("at")[0].as_py()
        sums = total(state).combine_chunks().to_batches()
        return step(pa.table({"at": pa.array([at], pa.int32()), "data": pa.array([sums[0].serialize().to_pybytes()], pa.binary())}), edges)

    state = placed(F.col("s")).repartition(tasks, "at")
    for _ in range(steps):
        state = state.groupBy("at").cogroup(dealt.groupBy("at")).applyInArrow(merged, PIECE).unionAll(again).repartition(tasks, "at")
    return state.groupBy("at").applyInArrow(total, f"qid {kind['qid'].simpleString()}, node {kind['node'].simpleString()}, p double")


#: A part of a group's entries or edges, as an Arrow batch.
PIECE = "at int, data binary"


def pack(batches, schema: pa.Schema):
    """Rows whose first column is their group as pieces, many rows at once."""

    def pieces(held):
        table = pa.Table.from_batches(held).combine_chunks()
        at = table.column(0).to_numpy()
        order = np.argsort(at, kind="stable")
        rows = table.drop_columns([table.column_names[0]]).take(pa.array(order)).cast(schema).combine_chunks().to_batches()
        out = cut(at[order], rows[0]) if rows else []
        return pa.record_batch([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["at", "data"])

    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED:
            yield pieces(held)
            held = []
    if held:
        yield pieces(held)


def cut(at: np.ndarray, rows: pa.RecordBatch) -> list[tuple[int, bytes]]:
    """Rows that are in the order of their groups, as a piece for each."""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    ends = np.append(first[1:], len(at))
    return [(int(at[lo]), rows.slice(lo, hi - lo).serialize().to_pybytes()) for lo, hi in zip(first.tolist(), ends.tolist())]


def unpack(table: pa.Table, schema: pa.Schema) -> list:
    """The columns of a group's pieces: doubles as an array, others as Arrow's."""
    held = [pa.ipc.read_record_batch(pa.py_buffer(x.as_py()), schema) for x in table.column("data")]
    whole = pa.Table.from_batches(held, schema).combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.columns]
    return [c.to_numpy() if c.type == pa.float64() else c for c in columns]


def coded(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value, and the first place of each number."""
    code = values.dictionary_encode().indices.to_numpy().astype("i8")
    first = np.zeros(code.max() + 1 if len(code) else 0, "i8")
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def hybrid_rank(ranking: DataFrame, propagated: DataFrame, beta: float = BETA, top: int = 50) -> DataFrame:
    """qid, file, score, rank: beta * seed / first seed score + (1 - beta) * p / greatest p, scores above 0."""
    first = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(W.partitionBy("qid"))
    s = ranking.select("qid", "file", (F.col("score") / F.when(first == 0, 1.0).otherwise(first)).alias("s"))
    most = F.max("p").over(W.partitionBy("qid"))
    p = propagated.select("qid", F.col("node").alias("file"), (F.col("p") / F.when(most == 0, 1.0).otherwise(most)).alias("p"))
    both = s.join(p, ["qid", "file"], "full")
    scored = both.select("qid", "file", F.round(beta * F.coalesce("s", F.lit(0.0)) + (1 - beta) * F.coalesce("p", F.lit(0.0)), 8).alias("score")).filter("score > 0")
    return ranked(scored, top)


def ranked(scores: DataFrame, top: int | None = None, *ties: str) -> DataFrame:
    """``rank`` of each row in its query by falling score, then ``ties``, then file."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), *ties, "file")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= top) if top else out


def rose(pairs: DataFrame, top: int = 10) -> DataFrame:
    """qid (a file), file, score, rank: direct co-change neighbours by raw count, newest first on ties."""
    both = symmetric(pairs, "raw", "last").select(F.col("src").alias("qid"), F.col("dst").alias("file"), F.col("raw").alias("score"), "last")
    w = W.partitionBy("qid").orderBy(F.desc("score"), F.desc("last"), "file")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("last")


def bridges(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, via, count: the common neighbour with the greatest smaller count, for each wanted pair."""
    near = symmetric(pairs, "raw")
    a = wanted.select("src", "dst").join(near.select("src", F.col("dst").alias("via"), F.col("raw").alias("na")), "src")
    b = near.select(F.col("src").alias("dst"), F.col("dst").alias("via"), F.col("raw").alias("nb"))
    met = a.join(b, ["dst", "via"]).withColumn("count", F.least("na", "nb"))
    w = W.partitionBy("src", "dst").orderBy(F.desc("count"), "via")
    return met.withColumn("r", F.row_number().over(w)).filter("r = 1").select("src", "dst", "via", "count")


def neighbourhood(focus: DataFrame, imports: DataFrame, pairs: DataFrame, limit: int = 140, hops: int = 2, by_import: int = 10, by_change: int = 20) -> DataFrame:
    """qid, node, hop: breadth-first from each focus, per node its first imports and strongest co-changes, up to ``limit`` nodes."""
    static = symmetric(imports.withColumn("raw", F.lit(0)), "raw").withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dst"))).filter(F.col("r") <= by_import)
    change = symmetric(pairs, "raw").withColumn("r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("raw"), "dst"))).filter(F.col("r") <= by_change)
    near = static.select(F.col("src").alias("node"), F.col("dst").alias("to")).unionAll(change.select(F.col("src").alias("node"), F.col("dst").alias("to"))).distinct().checkpoint()
    seen = focus.select("qid", "node", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        more = seen.filter(F.col("hop") == hop - 1).join(near, "node").select("qid", F.col("to").alias("node"), F.lit(hop).alias("hop")).distinct()
        seen = seen.unionAll(more).groupBy("qid", "node").agg(F.min("hop").alias("hop")).checkpoint()
    w = W.partitionBy("qid").orderBy("hop", "node")
    return seen.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")


def subgraph(pairs: DataFrame, nodes: DataFrame, min_count: int = 2, max_edges: int = 600) -> DataFrame:
    """The strongest pairs inside a node set, with their weight relative to the greatest."""
    inside = pairs.filter(F.col("raw") >= min_count).join(nodes.select(F.col("file").alias("src")), "src", "left_semi").join(nodes.select(F.col("file").alias("dst")), "dst", "left_semi")
    top = inside.orderBy(F.desc("raw"), "src", "dst").limit(max_edges)
    return top.withColumn("relative", F.col("decayed") / F.max("decayed").over(W.partitionBy(F.lit(1))))


def orthogonality(static: DataFrame, temporal: DataFrame, k: int = 10, least: int = 3) -> DataFrame:
    """file, jaccard of the top-k neighbours in two layers, for files with enough neighbours in both."""

    def top(edges: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy("src")
        near = symmetric(edges, "w").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("w"), "dst")))
        return near.filter((F.col("n") >= least) & (F.col("r") <= k)).groupBy(F.col("src").alias("file")).agg(F.collect_set("dst").alias(name))

    both = top(static, "s").join(top(temporal, "t"), "file")
    return both.select("file", (F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))).alias("jaccard"))
