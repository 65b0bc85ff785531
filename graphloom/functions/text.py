"""Column functions on code and prose text."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Words that are never terms.
STOP = (
    "the a an and or not is are was were be been being have has had do does did will would can could should this that these those with from "
    "for into onto out in on at by of to as if then else when while return def class import self none true false pass raise try except finally "
    "lambda yield assert global del print"
).split()
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
QUOTED = "[`'\"]([A-Za-z_][A-Za-z0-9_./]{2,})[`'\"]"
CAMEL = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: Distinct terms of a file that count.
TERM_CAP = 2_000


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def subtokens(token: Column) -> Column:
    """Parts by underscore and camel case, lower-cased, then the whole if it isn't among them; stop words and single letters still in."""
    parts = F.transform(F.flatten(F.transform(F.split(token, "_"), lambda p: F.split(p, CAMEL))), lambda s: F.lower(s))
    whole = F.lower(token)
    return F.when(F.array_contains(parts, whole), parts).otherwise(F.concat(parts, F.array(whole)))


def is_term(term: Column) -> Column:
    return (F.length(term) > 1) & ~term.isin(STOP)


_HUMPS = re.compile(CAMEL).split
_STOPPED = frozenset(STOP)
#: What a byte is to an identifier: 2 may begin one, 1 may go on in one.
_KINDS = np.array([2 if chr(i) in string.ascii_letters + "_" else 1 if chr(i) in string.digits else 0 for i in range(256)], "u1")
#: Identifiers whose terms a worker remembers, texts that it holds as strings at once, bytes and rows that it reads at once.
REMEMBERED, AT_ONCE, BYTES, ROWS = 200_000, 256, 2_000_000, 1_024
#: Passages of few words that are looked for one by one, and the characters on which more of them are looked up.
FEW, GRAM = 64, 16


def terms_of(token: str) -> list[str]:
    """``subtokens`` of one identifier that are terms, in Python."""
    parts = [p.lower() for piece in token.split("_") for p in _HUMPS(piece)]
    if token.lower() not in parts:
        parts.append(token.lower())
    return [p for p in parts if len(p) > 1 and p not in _STOPPED]


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def summed(row: np.ndarray, code: np.ndarray, n: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and sum of ``n`` of each pair of row and code, in their order."""
    key = row * max(codes, 1) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first] // max(codes, 1), key[first] % max(codes, 1), np.add.reduceat(n[order], first) if len(first) else n[:0]


def named(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """The identifiers of an Arrow column of texts: row, place in the names, count, and the names."""
    import pyarrow as pa

    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", "u1")[ends[0] : ends[-1]]
    bounds = ends - ends[0]
    inside = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
    kind = _KINDS[data]
    word = kind > 0
    fresh, last = word.copy(), word.copy()
    fresh[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    fresh[inside] = word[inside]
    last[inside - 1] = word[inside - 1]
    start, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    digits = np.flatnonzero(kind[start] == 1)
    if len(digits):  # a name begins at the first sign of its run that is no digit
        letters = np.append(np.flatnonzero(kind == 2), len(data))
        begin = np.minimum(letters[np.searchsorted(letters, start[digits])], end[digits])
        word[runs(start[digits], begin - start[digits])] = False
        start[digits] = begin
        start, end = start[start < end], end[start < end]
    places = np.concatenate([[0], np.cumsum(end - start)])
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(data[word].tobytes())).dictionary_encode()
    names = found.dictionary.cast(pa.large_string())
    row, ident, n = summed(np.searchsorted(bounds, start, "right") - 1, found.indices.to_numpy().astype("i8"), np.ones(len(start), "i8"), len(names))
    return row, ident, n, names


def counted(column, cap: int | None, known: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """The terms of an Arrow column of texts: row, place in the terms, count, and the terms; with a cap the most
    frequent ones of a row (ties by term). ``known`` is what a worker remembers."""
    import pyarrow as pa
    import pyarrow.compute as pc

    row, ident, n, names = named(column)
    if len(known) > REMEMBERED:
        known.clear()
    lowered = pc.ascii_lower(names)
    plain = pc.match_substring_regex(names, "^[A-Za-z][a-z0-9]*$").to_numpy(zero_copy_only=False)
    fit = pc.and_not(pc.greater(pc.binary_length(lowered), 1), pc.is_in(lowered, pa.array(STOP, lowered.type))).to_numpy(zero_copy_only=False)
    split, size = [], (plain & fit).astype("i8")  # a plain identifier is its only term
    mixed = np.flatnonzero(~plain)
    for at, name in zip(mixed.tolist(), names.take(pa.array(mixed)).to_pylist()):
        terms = known.get(name)
        if terms is None:
            terms = known[name] = terms_of(name)
        size[at] = len(terms)
        split += terms
    codes = pa.concat_arrays([lowered.filter(pa.array(plain & fit)), pa.array(split, lowered.type)]).dictionary_encode()
    flat = np.empty(size.sum(), "i8")
    owner = np.repeat(plain, size)
    every = codes.indices.to_numpy().astype("i8")
    flat[owner], flat[~owner] = every[: owner.sum()], every[owner.sum() :]
    upto = np.cumsum(size) - size
    each = size[ident]
    row, term, f = summed(np.repeat(row, each), flat[runs(upto[ident], each)], np.repeat(n, each), len(codes.dictionary))
    terms = codes.dictionary
    if cap is not None:
        many = np.flatnonzero(np.bincount(row, minlength=1) > cap)
        for r in many:
            mine = np.flatnonzero(row == r)
            words = terms.take(pa.array(term[mine])).to_pylist()
            mine = mine[sorted(range(len(mine)), key=lambda i: (-f[mine[i]], words[i]))[cap:]]
            f[mine] = 0
        row, term, f = row[f > 0], term[f > 0], f[f > 0]
    return row, term, f, terms


def pieces(batch, at: int = 1) -> Iterator:
    """A batch of rows in pieces with as many rows as texts (column ``at``) fit in what is read at once."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    lo = 0
    while lo < batch.num_rows:
        done = sizes[lo - 1] if lo else 0
        hi = min(max(int(np.searchsorted(sizes, done + BYTES, "right")), lo + 1), lo + ROWS, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def strings(column) -> Iterator[str | None]:
    """The values of an Arrow column, few at a time."""
    for at in range(0, len(column), AT_ONCE):
        yield from column.slice(at, AT_ONCE).to_pylist()


def whole(texts: DataFrame, key: str, *others: str) -> DataFrame:
    """key, text and others with one row a key: the texts of a key that has several are put together."""
    texts = texts.select(key, "text", *others)
    if texts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return texts
    return texts.groupBy(key).agg(F.array_join(F.collect_list("text"), "\n").alias("text"), *(F.min(c).alias(c) for c in others))


def holders(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """qid, file of the texts that hold a passage (``needle``). The passages are held by every worker.

    Passages of six words and more are looked up by four whole words, where the text has the first of them; of the
    others each is looked for while they are few, or by its first characters.
    """
    said = passages.filter("needle is not null").select("qid", "needle").toArrow()
    qids, needles = said.column(0).combine_chunks(), said.column(1).to_pylist()
    by_run: dict[str, dict[str, list[int]]] = {}
    few: list[int] = []
    for i, needle in enumerate(needles):
        words = needle.split(" ")
        if len(words) >= 6:  # the first and the last may be cut
            by_run.setdefault(words[1], {}).setdefault(" ".join(words[1:5]), []).append(i)
        else:
            few.append(i)
    by_start: dict[int, dict[str, list[int]]] = {}
    for i in few if len(few) > FEW else ():
        k = min(len(needles[i]), GRAM)
        by_start.setdefault(k, {}).setdefault(needles[i][:k], []).append(i)
    shared = texts.sparkSession.sparkContext.broadcast((qids, needles, by_run, few, by_start))

    def look(batches):
        import pyarrow as pa

        qids, needles, by_run, few, by_start = shared.value
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(strings(batch.column(1))):
                if text is None:
                    continue
                words = text.split(" ")
                near = set() if by_start else set(few)
                for at in [j for j, word in enumerate(words) if word in by_run]:
                    near.update(by_run[words[at]].get(" ".join(words[at : at + 4]), ()))
                for k, starts in by_start.items():
                    for start in starts.keys() & {text[j : j + k] for j in range(len(text) - k + 1)}:
                        near.update(starts[start])
                held = [i for i in near if needles[i] in text]
                rows += [row] * len(held)
                found += held
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(found, pa.int32())), batch.column(0).take(pa.array(rows, pa.int32()))], ["qid", "file"])

    out = f"qid {passages.schema['qid'].dataType.simpleString()}, file {texts.schema['file'].dataType.simpleString()}"
    return texts.select("file", "text").mapInArrow(look, out).distinct()


def term_counts(texts: DataFrame, key: str, cap: int | None = TERM_CAP, apart: bool = False) -> DataFrame:
    """``key``, term, f over whole texts, each counted where it is read.

    With a cap the most frequent terms of a text (ties by term). ``apart``: texts of one key are counted one by one.
    """

    def count(batches):
        import pyarrow as pa

        known: dict[str, list[str]] = {}
        for batch in batches:
            for part in pieces(batch):
                row, term, f, terms = counted(part.column(1), cap, known)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), terms.cast(pa.string()).take(pa.array(term)), pa.array(f)], [key, "term", "f"])

    return (texts.select(key, "text") if apart else whole(texts, key)).mapInArrow(count, f"`{key}` {texts.schema[key].dataType.simpleString()}, term string, f bigint")


def code_identifiers(text: Column) -> Column:
    """Snake or mixed-case identifiers of three letters or more that are no stop word, and the last path segments of quoted names."""
    named = F.filter(identifiers(text), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(STOP) & (t.contains("_") | ((t != F.upper(t)) & (t != F.lower(t)))))
    quoted = F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda q: F.regexp_replace(F.element_at(F.split(q, "/"), -1), r"\.py$", ""))
    return F.array_union(named, quoted)


def clean_rename(path: Column) -> Column:
    """The new path of a rename notation, without doubled or leading slashes."""
    new = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.ltrim(F.replace(F.element_at(F.split(new, " => "), -1), F.lit("//"), F.lit("/")), F.lit("/"))


def package_of(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, "/?[^/]*$", ""), "/", ".")


def repository(url: Column) -> Column:
    """owner/name of a hosting address, null for anything else."""
    found = F.regexp_extract(url, r"^(?:https?://github\.com/)?([A-Za-z0-9][\w.-]*/[A-Za-z0-9][\w.-]*?)(?:\.git)?/?$", 1)
    return F.when(found != "", found)


def skeleton(text: Column, heads: int = 12, most: int = 500) -> Column:
    """The first docstring fragment and the first definition lines, in one line."""
    doc = F.trim(F.regexp_extract(text, '(?s)"""(.*?)(?:"""|\n\n)', 1))
    lines = F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^\s*((?:class|def)\s+\w+[^\n]*)"), F.lit(1)), 1, heads)
    return F.left(F.array_join(F.filter(F.concat(F.array(doc), lines), lambda x: x != ""), " | "), F.lit(most))
