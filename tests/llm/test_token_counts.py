import numpy as np
import public_tokenizers as P
import pytest
from graphloom.llm import token_counts
from graphloom.llm.packing import encoder_for
from graphloom.llm.word_bpe import WordBpe

END = token_counts.END_ID


def split(ids):
    out, n = [], 0
    for i in ids:
        if i == END:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_stitching(spark, block):
    random = np.random.default_rng(block)
    files = {"a": [], "b": [END], "c": [5] * 20, "d": [END, END, 1, 2, END, 3], "e": [*([9] * 15), END, *random.choice([1, 2, END], 60).tolist()]}
    rows = [(f, k, np.array(ids[at : at + block], "<u2").tobytes()) for f, ids in files.items() for k, at in enumerate(range(0, len(ids), block))]
    rows.append(("f", 0, None))
    got = {}
    for r in sorted(token_counts.token_counts(spark.createDataFrame(rows, "file string, block int, ids binary")).collect(), key=lambda r: (r.file, r.ordinal)):
        got.setdefault(r.file, []).append((r.n_tokens, r.closed))
    assert got == {f: split(ids) for f, ids in files.items() if ids}


@pytest.mark.parametrize("block", [16, 1 << 18])
def test_texts(spark, make_docs, odd_texts, prose, block):
    words = WordBpe(P.path("word_bpe_49k.json"), special=False)
    rows = odd_texts + prose
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_texts(make_docs(rows), block_ids=block).collect())
    assert got == sorted((i or 0, len(words.encode([t])[0]) // 4) for i, t in rows)
    assert token_counts.count_texts(make_docs([])).count() == 0


def test_flat_files(spark, tmp_path):
    ids = [1, 2, END, 3, END, 4, 4, 4]
    (tmp_path / "x.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "y.bin").write_bytes(b"")
    blocks = token_counts.flat_blocks(spark, f"file://{tmp_path}/*.bin", block_ids=3)
    got = sorted((r.ordinal, r.n_tokens, r.closed) for r in token_counts.token_counts(blocks).collect())
    assert got == [(0, 2, True), (1, 1, True), (2, 3, False)]
