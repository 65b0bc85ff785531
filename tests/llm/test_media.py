import hashlib
import struct
import zlib

import numpy as np
import pytest
from graphloom.llm import media_tiff as tiff
from graphloom.llm.textkit import encode


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, tile, order):
    random = np.random.default_rng(1)
    pages = [random.integers(0, 4, (70, 50), dtype=np.uint8), random.integers(0, 255, (33, 65, 3), dtype=np.uint8), np.zeros((300, 90), np.uint8)]
    got = list(tiff.read_tiff(tiff.write_tiff(pages, compression, predictor, tile, rows_per_strip=16, order=order)))
    assert [p.pixels for p in got] == [p.tobytes() for p in pages]
    assert [(p.width, p.height, p.samples) for p in got] == [(50, 70, 1), (65, 33, 3), (90, 300, 1)]


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 300, bytes(range(256)) * 40, b"ab" * 5000])
def test_codecs(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_packbits_of_the_format_description():
    assert tiff.packbits_decode(b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\xf7\xaa") == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")


def test_sixteen_bits_and_loops():
    x = np.arange(12, dtype=np.uint16).reshape(3, 4) * 5000
    data = x.astype("<u2").tobytes()
    entries = [(256, 4, 4), (257, 4, 3), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 3), (279, 4, len(data))]
    head = struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries)
    file = head + directory + struct.pack("<I", 8 + len(data))  # the chain points back to its start
    pages = list(tiff.read_tiff(file))
    assert len(pages) == 1 and pages[0].bits == 16 and pages[0].pixels == data


def test_pages_of_a_table(spark):
    good = tiff.write_tiff([np.ones((2, 3), np.uint8), np.zeros((1, 1), np.uint8)])
    df = spark.createDataFrame([(1, good, 9), (2, None, 9), (3, b"", 9), (4, b"II*\0junk", 9), (5, good[:-20], 9), (5, good, 9)], "k int, media binary, page int")
    rows = [(r.k, r.page, r.error is None) for r in tiff.tiff_pages(df, keep=("k",)).collect()]
    assert sorted(rows)[:2] == [(1, 0, True), (1, 1, True)] and (4, -1, False) in rows
    assert not any(k in (2, 3) for k, _, _ in rows) and (5, 1, True) in rows and (5, -1, False) in rows


def test_texts(spark, make_docs, odd_texts):
    rows = odd_texts
    got = {}
    for r in tiff.text_media_digests(make_docs(rows)).collect():
        got.setdefault(r.doc_id, r)
    assert len(got) == len({i for i, _ in rows})
    for i, t in rows:
        data = encode(t)
        payload = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[5].media_sha256 == got[6].media_sha256 and got[5].feature == got[6].feature
    assert tiff.text_media_digests(make_docs([])).count() == 0


def test_published_packbits():
    """The worked example of the format's own description."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed).hex().upper() == "AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA"


def test_published_lzw():
    """The worked example of the format's own description: 9-bit codes, high bits first."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    packed = int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert tiff.lzw_decode(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_a_file_written_by_hand():
    """Big-endian, one strip, deflate from the standard library, no predictor."""

    image = np.arange(24, dtype=np.uint8).reshape(4, 6)
    strip = zlib.compress(image.tobytes())
    tags = [(256, 3, 1, 6 << 16), (257, 3, 1, 4 << 16), (258, 3, 1, 8 << 16), (259, 3, 1, 8 << 16), (262, 3, 1, 1 << 16), (273, 4, 1, 8), (277, 3, 1, 1 << 16), (278, 3, 1, 4 << 16), (279, 4, 1, len(strip))]
    at = 8 + len(strip) + len(strip) % 2
    head = b"MM\x00*" + struct.pack(">I", at) + strip + b"\0" * (len(strip) % 2)
    data = head + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">I", 0)
    (page,) = tiff.read_tiff(data)
    assert np.array_equal(np.frombuffer(page.pixels, np.uint8).reshape(4, 6), image)
