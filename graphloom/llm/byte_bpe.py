"""Byte-level BPE encoding and decoding with DuckDB recursive queries, per partition.

Encoding: the pattern cuts a text into words. The distinct words of a batch become
token-position rows, one a byte; a recursive query joins neighbouring rows with the
merge table and contracts each word's leftmost pair of least rank, until no pair is
left. Long words contract all occurrences of their least pair in one step where no
merge of the new token can come before the next occurrence. Recursion stops every
``STEPS`` contractions and goes on from there, which bounds its memory.
Decoding: the ids of a batch of texts become position rows again, join the
vocabulary, and an ordered aggregation gives each text's bytes.

White space always ends a word, so a text is looked up in *units* of white space and
what follows it, each of which is encoded once and remembered.

Defined results: null and empty texts have no id and decode to no byte; strings that
name special tokens are ordinary text; repeated rows are encoded each; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.memos import claim
from graphloom.llm.shared import documents

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words per query, bytes from which on a word is long, contractions before the recursion starts anew, ids decoded in one query.
WORDS, LONG, STEPS, DECODED = 20_000, 256, 64, 1_000_000
#: Units and words that a worker process remembers.
UNITS, KNOWN = 1_500_000, 1_200_000

# The characters with the property White_Space, as a class.
_SPACE = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

#: One contraction a step: the word's least (rank, place) among the pairs that the merge table has; ``np`` is where the next token begins.
SHORT_WORDS = f"""
with recursive r(it, wid, pos, tok, np) as (
  select 0::int, wid, pos, tok, coalesce(lead(pos) over (partition by wid order by pos), 4294967295) from base
  union all (
    with pairs as (
      select a.wid, a.np, b.np as beyond, m.rank * 4294967296 + a.pos as k
      from r a join r b on b.wid = a.wid and b.pos = a.np join merges m on m.a = a.tok and m.b = b.tok),
    best as (select wid, min(k) as k, arg_min(np, k) as gone, arg_min(beyond, k) as beyond from pairs group by wid)
    select it + 1, r.wid, r.pos,
      case when r.pos = k % 4294967296 then (k // 4294967296)::int else tok end,
      case when r.pos = k % 4294967296 then best.beyond else r.np end
    from r join best using (wid) where r.pos <> gone and it < {STEPS}))
select wid, pos, tok, it from r join (select wid, max(it) as it from r group by wid) using (wid, it)
"""
#: All occurrences of a word's least rank in a step: of those that overlap, every second one from the left.
LONG_WORDS = f"""
with recursive r(it, wid, pos, tok) as (
  select 0::int, wid, pos, tok from base
  union all (
    with p as (select it, wid, pos, tok, lead(tok) over w as nt, lead(pos) over w as np from r window w as (partition by wid order by pos)),
    q as (select p.wid, p.pos, p.np, m.rank, m.apart, min(m.rank) over (partition by p.wid) as least from p join merges m on m.a = p.tok and m.b = p.nt),
    c as (select *, lag(np) over (partition by wid order by pos) is distinct from pos as fresh, row_number() over (partition by wid order by pos) as nr from q where rank = least),
    d as (select *, sum(fresh::int) over (partition by wid order by pos) as island from c),
    e as (select *, row_number() over (partition by wid, island order by pos) as nth from d),
    taken as (select wid, pos, np, rank from e where case when apart then nth % 2 = 1 else nr = 1 end)
    select it + 1, p.wid, p.pos, coalesce(t.rank::int, p.tok)
    from p left join taken t on t.wid = p.wid and t.pos = p.pos left join taken g on g.wid = p.wid and g.np = p.pos
    where g.wid is null and it < {STEPS} and p.wid in (select wid from taken)))
select wid, pos, tok, it from r join (select wid, max(it) as it from r group by wid) using (wid, it)
"""
DECODE = "select text, array_to_string(list(part order by pos), '') as whole from ids join vocabulary using (id) group by text"


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes((i,))] for i in range(256)], np.int32)
        pairs = [(a, b, r) for token, r in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        a, b, rank = np.array(pairs, np.int64).T
        early = set(a[rank < a].tolist()) | set(b[rank < b].tolist())  # tokens that a merge of lower rank can follow
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
        self.db.register("given", pa.table({"a": a.astype(np.int32), "b": b.astype(np.int32), "rank": rank, "apart": pa.array([x not in early for x in rank.tolist()])}))
        self.db.execute("create table merges as select * from given")
        self.db.unregister("given")
        # DuckDB's text holds bytes as the characters of the same numbers
        self.db.register("given", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "part": [k.decode("latin-1") for k in self.ranks]}))
        self.db.execute("create table vocabulary as select * from given")
        self.db.unregister("given")
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def forget(self) -> None:
        self.words.clear()
        self.units.clear()

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        wid = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(wid):
            self.db.register("base", pa.table({"wid": wid, "pos": pos.astype(np.int64), "tok": tok.astype(np.int32)}))
            out = self.db.execute(query).fetchnumpy()
            self.db.unregister("base")
            more = out["it"] == STEPS
            done.append((out["wid"][~more], out["pos"][~more], out["tok"][~more]))
            wid, pos, tok = out["wid"][more], out["pos"][more], out["tok"][more]
        wid, pos, tok = (np.concatenate([x[i] for x in done]) for i in range(3))
        order = np.lexsort((pos, wid))
        data, stops = tok[order].astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(wid, minlength=len(words)))
        return [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def _learn_words(self, words: list[str]) -> None:
        for query, long in ((SHORT_WORDS, False), (LONG_WORDS, True)):
            part, raw, size = [], [], 0

            def contract() -> None:
                if part:
                    self.words.update(zip(part, self._contract(raw, query)))
                    part.clear()
                    raw.clear()

            for word in words:
                data = word.encode()
                if (len(data) >= LONG) != long:
                    continue
                if (rank := self.ranks.get(data)) is not None:
                    self.words[word] = rank.to_bytes(4, "little")
                    continue
                part.append(word)
                raw.append(data)
                size += len(data)
                if len(part) >= WORDS or size >= 10 * WORDS:
                    contract()
                    size = 0
            contract()

    def learn(self, units: set[str]) -> None:
        """Encode these units and remember them."""
        if len(self.units) + len(units) > UNITS:
            self.units.clear()
        cut = [(u, self.pattern.findall(u)) for u in units]
        needed = {w for _, ws in cut for w in ws}
        if len(self.words) + len(needed) > KNOWN:
            self.words.clear()
        self._learn_words(sorted(needed.difference(self.words)))
        get = self.words.__getitem__
        self.units.update((u, b"".join(map(get, ws))) for u, ws in cut)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [_UNIT.findall(t) if t else [] for t in texts]
        every = set().union(*split)
        fresh = every.difference(self.units)
        if fresh:
            if len(self.units) + len(fresh) > UNITS:
                self.units.clear()
                fresh = every
            self.learn(fresh)
        get = self.units.__getitem__
        return [b"".join(map(get, units)) for units in split]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes that each text's ids stand for."""
        out, start = [b""] * len(packed), 0
        while start < len(packed):
            stop, size = start, 0
            while stop < len(packed) and (stop == start or size + len(packed[stop]) <= 4 * DECODED):
                size += len(packed[stop])
                stop += 1
            n = np.array([len(p) // 4 for p in packed[start:stop]])
            text = np.repeat(np.arange(start, stop, dtype=np.int32), n)
            pos = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            self.db.register("ids", pa.table({"text": text, "pos": pos, "id": np.frombuffer(b"".join(packed[start:stop]), "<u4").astype(np.int32)}))
            for i, whole in self.db.execute(DECODE).fetchall():
                out[i] = whole.encode("latin-1")
            self.db.unregister("ids")
            start = stop
        return out


_open: dict[tuple[str, str], ByteBpe] = {}


def opened(path: str | None = None, pattern: str | None = None) -> ByteBpe:
    """The tokenizer of a rank file (the public multi-language one by default), kept by the worker process."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _open:
        _open[path, pattern] = ByteBpe(path, pattern)
    return _open[path, pattern]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every whole text."""

    def run(batches):
        bpe = opened(path, pattern)
        claim("byte_bpe", bpe.forget)
        for batch in batches:
            packed = bpe.encode(batch.column(1).to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ``decoded`` (binary) of every row of ids; null ids decode to no byte."""

    def run(batches):
        bpe = opened(path, pattern)
        claim("byte_bpe", bpe.forget)
        for batch in batches:
            packed = [b"" if x is None else np.asarray(x, "<u4").tobytes() for x in batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.decode(packed), pa.binary())], names=[key, "decoded"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, decoded binary")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass, keeping the digests only."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        bpe = opened(path, pattern)
        claim("byte_bpe", bpe.forget)
        for batch in batches:
            packed = bpe.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(map(sha, packed), pa.string()), pa.array(map(sha, bpe.decode(packed)), pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
