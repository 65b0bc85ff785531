import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from graphloom.llm import byte_bpe, packing, word_bpe
from graphloom.llm.textkit import encode
from graphloom.llm.word_bpe import WordBpe
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

BPE = byte_bpe.opened()
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
WORDS = WordBpe(P.path("word_bpe_49k.json"))
DIRECT = Tokenizer.from_file(P.path("word_bpe_49k.json"))
PLAIN, PLAIN_DIRECT = WordBpe(P.path("word_bpe_49k.json"), special=False), Tokenizer.from_file(P.path("word_bpe_49k.json"))
PLAIN_DIRECT.encode_special_tokens = True

MIXED = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "é", "Éa", "ß", "中", "🙂", ".", ",,", "!?", "12", "²", "_", "\x1c", "\x85", " ", "x" * 30, "Σ", "İ", "é"]), max_size=30).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.one_of(MIXED, st.text(max_size=40)))
def test_bytes_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    ids = BPE.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert BPE.decode([ids]) == [text.encode()]


@pytest.mark.parametrize("text", ["x" * 3000, "=" * 1001, "ab" * 700, "ß" * 300, "".join(random.Random(2).choice("abcdefgh") for _ in range(900)), " " * 500 + "x", "中文" * 200])
def test_long_words(text):
    assert np.frombuffer(BPE.encode([text])[0], "<u4").tolist() == REFERENCE.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.one_of(MIXED, st.text(max_size=40)))
def test_words_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(WORDS.encode([text])[0], "<u4").tolist() == DIRECT.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(PLAIN.encode([text])[0], "<u4").tolist() == PLAIN_DIRECT.encode(text, add_special_tokens=False).ids


def test_letters_that_get_a_mark():
    """Signs after a letter that the normalizer turns into a letter and a mark are one run with the mark."""
    texts = ["İ_", "\u0958--", "aİ!? b", "\u0958", "İ"]
    assert [np.frombuffer(x, "<u4").tolist() for x in WORDS.encode(texts)] == [DIRECT.encode(t, add_special_tokens=False).ids for t in texts]


def test_names_of_special_tokens():
    texts = ["hello <|endoftext|> world", "<|startoftext|>a", "x<|endoftext|>", "<|endoftext|>"]
    assert [np.frombuffer(x, "<u4").tolist() for x in WORDS.encode(texts)] == [DIRECT.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in np.frombuffer(WORDS.encode(texts)[0], "<u4") and 49407 not in np.frombuffer(PLAIN.encode(texts)[0], "<u4")


def test_memory_of_units_is_bounded():
    small = WordBpe(P.path("word_bpe_49k.json"), limit=5)
    texts = ["one two three four", "five six. seven", "one two three four five six seven eight"]
    assert small.encode(texts) == WORDS.encode(texts)


def test_pieces_of_a_table_of_texts(monkeypatch):
    """Texts that are numbered and given in several pieces, with texts among them that the library encodes as a whole."""
    monkeypatch.setattr(word_bpe, "HELD", 60)
    monkeypatch.setattr(word_bpe, "GIVEN", 7)
    r = random.Random(8)
    some = ["the", "schön", "Schön", "été.", "ÉTÉ!", "ªº", "µ!", "naïve÷", "a×b", "ÿ...", "...", "12,5", "ΑΒΓ;", "中文", "it's", "\x1d", "<|endoftext|>", "x" * 70, "\xa0", "  "]
    texts = [" ".join(r.choices(some, k=r.randint(0, 12))) for _ in range(200)] + [None, ""]
    for limit in (6, 1000):
        words = WordBpe(P.path("word_bpe_49k.json"), limit=limit)
        assert [x.tolist() for x in words.encode_arrays(texts)] == [DIRECT.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_units_cost_a_fraction_of_the_library():
    """CPU time of texts with many distinct units, beside the library's for the same ids."""
    r = random.Random(3)
    parts = ["the", "sch", "tion", "é", "ung", "que", "ñ", "er", "lich", "a", "o", "wh"]
    units = ["".join(r.choices(parts, k=r.randint(2, 6))) + r.choice(["", "", "", ".", ",", "***"]) for _ in range(150_000)]
    texts = [" ".join(r.choices(units, k=400)) for _ in range(1500)]
    own, library = [], []
    for _ in range(3):
        words, begin = WordBpe(P.path("word_bpe_49k.json")), time.process_time()
        found = words.encode_arrays(texts)
        between = time.process_time()
        expected = DIRECT.encode_batch_fast(texts, add_special_tokens=False)
        own.append(between - begin)
        library.append(time.process_time() - between)
    assert [x.tolist() for x in found] == [x.ids for x in expected]
    assert min(own) < 0.28 * min(library), (own, library)


@pytest.mark.parametrize("most", [40, 1 << 16, 1 << 20])
def test_term_counts_are_plain_counts(most):
    r = np.random.default_rng(2)
    docs = [np.append(r.integers(0, most, r.integers(0, 80)), most - 1).astype(np.uint32) for _ in range(300)]
    plain = [(d, t, c) for d, doc in enumerate(docs) for t, c in sorted(Counter(doc.tolist()).items())]
    assert list(zip(*(x.tolist() for x in packing.term_counts(docs)))) == plain
    assert [len(x) for x in packing.term_counts([])] == [0, 0, 0]


def test_round_trip(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts)
    for r in byte_bpe.round_trip(docs).collect():
        data = encode(dict(odd_texts)[r.doc_id])
        ids = np.array(REFERENCE.encode_ordinary(data.decode()), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(data).hexdigest())
    decoded = byte_bpe.decode_ids(byte_bpe.encode_texts(docs))
    assert {r.doc_id: bytes(r.decoded) for r in decoded.collect()} == {i: encode(t) for i, t in odd_texts}
    assert byte_bpe.round_trip(make_docs([])).count() == 0


def test_packing_keeps_every_id_once(spark, make_docs, odd_texts, prose):
    rows = [(i, t) for i, t in odd_texts + prose if i is not None]
    pieces = packing.pack_table(make_docs(rows), packing.encoder_for()).collect()
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for i, copies in texts.items():
        ids = np.frombuffer(WORDS.encode([copies[0]])[0] + np.array([2], "<u4").tobytes(), "<u4")
        assert sum(p.length for p in by_doc[i]) == len(ids) * len(copies)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.length > 0 for p in by_doc[i])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert packing.pack_table(make_docs([]), packing.encoder_for()).count() == 0


def test_neighbours_are_those_of_plain_scoring():
    r = np.random.default_rng(0)
    docs = [np.concatenate((r.integers(0, 300, r.integers(5, 60)), r.integers(300 + 10 * (d % 5), 310 + 10 * (d % 5), 8))).astype(np.uint32) for d in range(60)]
    index, unused = packing.Bm25(docs), np.ones(60, bool)
    unused[[0, 7]] = False
    mean = np.mean([len(d) for d in docs])
    for seed in range(0, 60, 9):
        terms, counts = np.unique(docs[seed], return_counts=True)
        df = np.array([sum(t in d for d in docs) for t in terms])
        ok = df > 1
        idf = np.log((60 - df + 0.5) / (df + 0.5) + 1).astype(np.float32)
        score = np.zeros(60)
        for t, w in zip(terms[ok], idf[ok]):
            for d, doc in enumerate(docs):
                c = (doc == t).sum()
                score[d] += w * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        got = list(index.neighbours(seed, unused))
        assert set(got) == set(np.flatnonzero((score > 0) & unused))
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:]))


def plain_fill(docs, window):
    """Pieces of a shard as the module's text has them, each neighbour found by scoring every unused document."""
    n, sizes = len(docs), [len(d) for d in docs]
    mean, df = sum(sizes) / n, {}
    for d in docs:
        for t in set(d.tolist()):
            df[t] = df.get(t, 0) + 1

    def score(seed, other):
        total, tokens = 0.0, docs[other].tolist()
        for t in set(docs[seed].tolist()) & set(tokens):
            if df[t] > 1:
                c = tokens.count(t)
                total += math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sizes[other] / mean))
        return total

    unused, left, rest, sequence = set(range(n)), sum(sizes), None, 0
    while left:
        room = window if left >= window else 2 ** int(math.log2(left))
        left -= room
        seed, at = rest or (min(unused), 0)
        unused.discard(seed)
        rest, doc, offset = None, seed, 0
        while offset < room:
            take = min(room - offset, sizes[doc] - at)
            yield doc, at, take, sequence, offset
            offset += take
            if at + take < sizes[doc]:
                rest = (doc, at + take)
            elif offset < room:
                found = {d: score(seed, d) for d in unused}
                hits = [d for d in found if found[d] > 0]
                doc, at = (min(hits, key=lambda d: (-found[d], d)) if hits else min(unused)), 0
                unused.discard(doc)
        sequence += 1


@pytest.mark.parametrize("seed", range(6))
def test_fill_is_the_plain_one(seed, monkeypatch):
    r = np.random.default_rng(seed)
    monkeypatch.setattr(packing, "WINDOW", 128)
    monkeypatch.setattr(packing, "FIRST", 2)
    docs = [r.integers(0, r.choice([20, 200, 5000]), r.integers(1, 90)) for _ in range(80)]
    assert list(packing.pack([d.astype(np.uint32) for d in docs])) == list(plain_fill(docs, 128))


@pytest.mark.parametrize("others", [1, 20])
def test_windows_take_all_neighbours(others):
    """A group of short documents, a half or a twentieth of the shard: one window needs more than a hundred of them."""
    groups = [d % (others + 1) for d in range(150 * (others + 1))]
    docs = [np.arange(10 + 40 * g, 40 + 40 * g, dtype=np.uint32) for g in groups]
    first = {doc for doc, _, _, sequence, _ in packing.pack(docs) if sequence == 0}
    assert len(first) > 128 and {groups[d] for d in first} == {0}


def test_neighbours_meet_across_partitions(spark, make_docs, monkeypatch):
    """Five subjects, each over all partitions: windows hold one subject, and two where a subject ends."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    r = random.Random(5)
    words = [["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20)] for _ in range(5)]
    rows = [(i, " ".join(r.sample(words[i % 5], 20) * 10)) for i in range(400)]
    pieces = packing.pack_table(make_docs(rows).repartition(8, "doc_id"), packing.encoder_for()).collect()
    assert sum(p.length for p in pieces if p.start == 0) > 0 and {p.doc_id for p in pieces} == {i for i, _ in rows}
    subjects: dict = {}
    for p in pieces:
        subjects.setdefault(p.sequence_id, set()).add(p.doc_id % 5)
    mixed = [s for s, found in subjects.items() if len(found) > 1]
    assert len(mixed) < len(subjects) / 10, (len(mixed), len(subjects))
