"""Whole-text ids of a word-end BPE tokenizer file, unit by unit.

A *unit* is a run without white space. The tokenizer drops white space before its
merges, so a text's ids are those of its units in order; each distinct unit is
encoded once by the ``tokenizers`` library and remembered. A text with the name of
a special token is encoded by the library as a whole. A unit of letters, maybe
with a run of signs after them, is a *core* and that run: many units share either,
and cores are encoded many at a time, told apart by the word-end tokens. Texts of
Latin-1 characters are lower-cased as a whole first, which the tokenizer does too.
Units and parts stay in Arrow arrays, where whole arrays are looked up at once.
"""

from __future__ import annotations

import codecs
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of texts whose units are numbered together, and units whose ids are given together.
HELD, GIVEN = 16 << 20, 1 << 18
#: Cores of lower-case Latin-1 letters, and other strings, that the library gets in one text.
JOINED, OTHERS = 512, 4096
#: Controls that Python takes for white space and the tokenizer doesn't.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
WORD_END = "</w>"
#: ASCII characters that are neither letter nor digit; a run of them is one token of the pattern.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
IS_SIGN, IS_LOWER = (np.isin(np.arange(256), list(x.encode())) for x in (SIGNS, "abcdefghijklmnopqrstuvwxyz"))
#: The character that byte-level BPE has for each byte; spaces stay, they separate cores.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_LEVEL = "".join(" " if b == 0x20 else chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256))


def lowered(text: str) -> str:
    """Lower-cased where that is certain to be what the tokenizer makes of it."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


def _stays_letters(core: str) -> bool:
    """Whether the file's normalizer leaves letters only: some letters become one with a mark, which signs after it join."""
    return max(core) <= "\xff" or unicodedata.normalize("NFC", core).lower().isalpha()


def _strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.large_string())


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs of ``counts`` places from ``starts`` on, one after another."""
    place = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    place += np.arange(len(place))
    return place


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of large strings, one after another, and where each begins; the last place is the end."""
    _, offsets, data = strings.buffers()
    stops = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[stops[0] : stops[-1]], stops - stops[0]


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings from slices of UTF-8."""
    stops = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(stops), pa.py_buffer(data[_ranges(starts, ends - starts)]))


def _of_lower_letters(data: np.ndarray) -> np.ndarray:
    """Whether a byte belongs to a letter of Latin-1 that lower-casing leaves."""
    own = IS_LOWER[data]
    lead, follow = data[:-1], data[1:]
    two = (lead == 0xC3) & (follow >= 0x9F) & (follow != 0xB7) | (lead == 0xC2) & ((follow == 0xAA) | (follow == 0xB5) | (follow == 0xBA))
    own[:-1] |= two
    own[1:] |= two
    return own


def _counted(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    before = np.concatenate(([0], np.cumsum(flags)))
    return before[ends] - before[starts]


def _places(strings: pa.Array, known: pa.Array) -> np.ndarray:
    """Where these strings are among the known ones, -1 for those that are not."""
    return pc.fill_null(pc.index_in(strings, value_set=known), -1).to_numpy().astype(np.int64)


class Pool:
    """Ids of numbered entries, one after another in one array."""

    def __init__(self):
        self.ids, self.size = np.empty(1 << 12, np.uint32), 0
        self.starts, self.counts, self.n = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64), 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Entries of ``counts`` ids each."""
        self.ids, self.starts, self.counts = _room(self.ids, self.size + len(ids)), _room(self.starts, self.n + len(counts)), _room(self.counts, self.n + len(counts))
        self.ids[self.size : self.size + len(ids)] = ids
        self.starts[self.n : self.n + len(counts)] = self.size + np.cumsum(counts) - counts
        self.counts[self.n : self.n + len(counts)] = counts
        self.size += len(ids)
        self.n += len(counts)

    def of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these entries in order, and how many each has."""
        counts = self.counts[entries]
        return self.ids[_ranges(self.starts[entries], counts)], counts


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.empty(max(n, len(x) * 3 // 2), x.dtype)
    out[: len(x)] = x
    return out


class WordBpe:
    def __init__(self, path: str, limit: int = 600_000, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        #: Where a text has one of these, it is encoded as a whole.
        self.names = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values()) if special else ()
        # lower-case Latin-1 letters need neither the file's normalizer nor its pattern, and come as characters of bytes
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.limit = limit
        self.forget()

    def forget(self, parts: bool = True) -> None:
        """Drop what has been learnt; without ``parts`` the units only, which come back faster from their parts."""
        #: Units, and parts of units (cores, runs of signs), each at its place in ``pool`` or ``parts``.
        self.units, self.pool = _strings([""]), Pool()
        self.pool.add(np.empty(0, np.uint32), np.zeros(1, np.int64))
        if parts:
            self.known, self.parts = _strings([""]), Pool()
            self.parts.add(np.empty(0, np.uint32), np.zeros(1, np.int64))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep_parts(self, parts: pa.Array, ids: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.known = pa.concat_arrays([self.known, parts])
        self.parts.add(np.concatenate(ids), np.concatenate(counts))

    def _learn_parts(self, parts: pa.Array) -> None:
        """Remember the ids of these cores and runs of signs, none of which is known."""
        data, stops = _bytes_of(parts)
        # only texts of Latin-1 characters come lower-cased; other cores need the file's own rules
        plain = _counted(~_of_lower_letters(data), stops[:-1], stops[1:]) == 0
        signs = IS_SIGN[data[stops[:-1]]]
        for which, tokenizer, step in ((plain, self.plain, JOINED), (~plain & ~signs, self.tokenizer, OTHERS), (signs, None, OTHERS)):
            group, ids, counts = parts.filter(pa.array(which)), [], []
            for at in range(0, len(group), step):
                some = group.slice(at, step)
                if tokenizer:
                    text = b" ".join(some.cast(pa.large_binary()).to_pylist())
                    text = codecs.charmap_decode(text, "strict", BYTE_LEVEL)[0] if tokenizer is self.plain else text.decode()
                    found = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                    ends = np.flatnonzero(self.ends[found]) + 1
                    if len(ends) == len(some):
                        ids.append(found)
                        counts.append(np.diff(ends, prepend=0))
                        continue
                each = self.whole(some.to_pylist())
                ids += each
                counts.append(np.array([len(x) for x in each], np.int64))
            if len(group):
                self._keep_parts(group, ids, counts)

    def learn(self, units: pa.Array) -> np.ndarray:
        """Remember the ids of these units, none of which is known or empty; gives their places."""
        data, stops = _bytes_of(units)
        starts, ends = stops[:-1], stops[1:]
        last = np.maximum.accumulate(np.where(IS_SIGN[data], -1, np.arange(len(data))))[ends - 1]
        stems = np.maximum(last + 1, starts)  # where the signs at the end begin
        cut = (_counted(~_of_lower_letters(data), starts, stems) == 0) & (stems > starts)
        rest = np.flatnonzero(~cut)
        cores = [unit.rstrip(SIGNS) for unit in units.take(pa.array(rest)).to_pylist()]
        cut[rest] = [core.isalpha() and (core.isascii() or _stays_letters(core)) for core in cores]
        both = pc.dictionary_encode(pa.concat_arrays([_slices(data, starts[cut], stems[cut]), _slices(data, stems[cut], ends[cut])]))
        if len(fresh := np.flatnonzero(_places(both.dictionary, self.known) < 0)):
            self._learn_parts(both.dictionary.take(pa.array(fresh)))
        n = int(cut.sum())
        of = _places(both.dictionary, self.known)[both.indices.to_numpy()].reshape(2, n).T.ravel()
        ids, counts = self.parts.of(of)
        at = np.empty(len(units), np.int64)
        at[cut], at[~cut] = np.arange(self.pool.n, self.pool.n + n), np.arange(self.pool.n + n, self.pool.n + len(units))
        odd = units.filter(pa.array(~cut))
        self.units = pa.concat_arrays([self.units, units.filter(pa.array(cut)), odd])
        self.pool.add(ids, counts[::2] + counts[1::2])
        for start in range(0, len(odd), OTHERS):
            found = self.whole(odd.slice(start, OTHERS).to_pylist())
            self.pool.add(np.concatenate(found), np.array([len(x) for x in found], np.int64))
        return at

    def _numbered(self, units: pa.Array) -> np.ndarray:
        """Places of all units in ``pool``; each distinct one is looked up once."""
        coded = pc.dictionary_encode(units)
        distinct = coded.dictionary.cast(pa.large_string())
        at = _places(distinct, self.units)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            if len(self.units) + len(unknown) > self.limit:
                self.forget(parts=len(self.known) > self.limit)  # so all of these texts' units are learnt together
                at = _places(distinct, self.units)
                unknown = np.flatnonzero(at < 0)
            at[unknown] = self.learn(distinct.take(pa.array(unknown)))
        return at[coded.indices.to_numpy()]

    def _given(self, texts: list[str], whole: dict[int, np.ndarray]) -> Iterator[np.ndarray]:
        """Ids of each text, or those that ``whole`` has for its place; empties the list."""
        n, small = len(texts), sum(map(len, texts)) < 1 << 28  # so its bytes have places of 32 bits
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string() if small else pa.large_string()))
        stops = split.offsets.to_numpy().astype(np.int64)
        texts.clear()
        at = self._numbered(split.values)
        del split
        first = 0
        while first < n:
            after = max(first + 1, int(np.searchsorted(stops, stops[first] + GIVEN, "right")) - 1)
            ids, counts = self.pool.of(at[stops[first] : stops[after]])
            ends = np.concatenate(([0], np.cumsum(counts)))[stops[first : after + 1] - stops[first]].tolist()
            for i, a, b in zip(range(first, after), ends, ends[1:]):
                yield whole[i] if i in whole else ids[a:b]
            first = after

    def encoded(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null is empty."""
        held, whole, size = [], {}, 0
        for text in texts:
            text = text or ""
            if any(c in text for c in ODD) or any(name in text for name in self.names):
                whole[len(held)] = self.whole([text])[0]
                text = ""
            held.append(lowered(text))
            size += len(text)
            if size > HELD:
                yield from self._given(held, whole)
                held, whole, size = [], {}, 0
        if held:
            yield from self._given(held, whole)

    def encode_arrays(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        return list(self.encoded(texts))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        return [x.astype("<u4").tobytes() for x in self.encoded(texts)]
