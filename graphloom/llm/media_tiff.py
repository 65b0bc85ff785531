"""TIFF as a media column: write 8-bit samples, walk image directories, decode pages.

Reader: classic TIFF of either byte order; strips or tiles; no compression,
PackBits, LZW or deflate; horizontal predictor for 8- and 16-bit samples; chunky
or planar layout. One row per page (image directory).

Defined results: a null or empty media value gives no page; bytes that are not a
readable TIFF give one row with ``page`` -1 and the reason in ``error``; pages
before a damaged one are kept. A directory chain that loops ends where it closes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.textkit import encode

# Fixed values of the TIFF 6.0 format: compression codes and field type sizes.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257

#: Width in samples of the image that stores a text, and rows per strip.
TEXT_WIDTH, STRIP_ROWS = 64, 1024


class TiffError(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes
    tags: dict[int, tuple] = field(default_factory=dict)


# ---------------------------------------------------------------- codecs


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, everything else literal."""
    out = bytearray()
    x = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate(([0], edges)) if len(x) else np.empty(0, int)
    ends = np.concatenate((edges, [len(x)])) if len(x) else starts
    literal = 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s < 3:
            continue
        for a in range(literal, s, 128):
            b = min(a + 128, s)
            out.append(b - a - 1)
            out += data[a:b]
        while e - s >= 2:
            run = min(128, e - s)
            out.append(257 - run)
            out.append(data[s])
            s += run
        literal = s
    for a in range(literal, len(data), 128):
        b = min(a + 128, len(data))
        out.append(b - a - 1)
        out += data[a:b]
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits; the width grows one code early, as the format asks."""
    table: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    width, acc, held, prev = 9, 0, 0, None
    for byte in data:
        acc = (acc << 8 | byte) & 0xFFFFFF
        held += 8
        if held < width:
            continue
        held -= width
        code = acc >> held & (1 << width) - 1
        if code == END:
            break
        if code == CLEAR:
            del table[258:]
            width, prev = 9, None
            continue
        if prev is None:
            if code > 255:
                raise TiffError("LZW stream starts with a code that has no entry")
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(prev + entry[:1])
        elif code == len(table):
            entry = prev + prev[:1]
            table.append(entry)
        else:
            raise TiffError("LZW code beyond the table")
        out.append(entry)
        prev = entry
        size = len(table)
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc = acc << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    base = {bytes((i,)): i for i in range(256)}
    table, width, prefix = dict(base), 9, b""
    put(CLEAR, 9)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        table[longer] = len(table) + 2
        size = len(table) + 2
        if size == 4094:
            put(CLEAR, 12)
            table, width = dict(base), 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix], width)
        size = len(table) + 3
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(END, width)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


DECODE = {NONE: bytes, PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
ENCODE = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), OLD_DEFLATE: lambda x: zlib.compress(x, 1)}


# ---------------------------------------------------------------- writer


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = STRIP_ROWS, order: str = "<") -> bytes:
    """Pages of 8-bit samples (height x width, or height x width x samples) as one TIFF."""
    out = bytearray(b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    link = 4
    for page in pages:
        x = page if page.ndim == 3 else page[:, :, None]
        h, w, s = x.shape
        blocks = []
        if tile:
            tw, th = tile
            for r in range(0, h, th):
                for c in range(0, w, tw):
                    block = np.zeros((th, tw, s), np.uint8)
                    part = x[r : r + th, c : c + tw]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [x[r : r + rows_per_strip] for r in range(0, h, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            data = ENCODE[compression](block.tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
            if len(out) % 2:
                out.append(0)
        entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * s), (259, 3, [compression]), (262, 3, [2 if s == 3 else 1])]
        entries += [] if tile else [(273, 4, offsets)]
        entries += [(277, 3, [s])]
        entries += [] if tile else [(278, 4, [rows_per_strip]), (279, 4, counts)]
        entries += [(317, 3, [predictor])]
        entries += [(322, 4, [tile[0]]), (323, 4, [tile[1]]), (324, 4, offsets), (325, 4, counts)] if tile else []
        packed = []
        for tag, kind, values in entries:
            value = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(value) > 4:
                where = len(out)
                out += value
                value = struct.pack(order + "I", where)
            packed.append(struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0"))
        if len(out) % 2:
            out.append(0)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(packed)) + b"".join(packed)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---------------------------------------------------------------- reader


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise TiffError("directory beyond the end")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("directory is cut off")
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = TYPE_SIZE.get(kind, 0) * count
        where = at + 10 + 12 * i
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + size > len(data):
            raise TiffError(f"field {tag} beyond the end")
        if kind in (3, 4):
            tags[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", data, where)
        elif kind == 1:
            tags[tag] = tuple(data[where : where + count])
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _block(raw: bytes, rows: int, cols: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(order + "u2")
    need = rows * cols * samples * kind.itemsize
    if len(raw) < need:
        raise TiffError("strip or tile is cut off")
    x = np.frombuffer(raw, kind, count=rows * cols * samples).reshape(rows, cols, samples)
    if predictor == 2:
        x = np.cumsum(x, axis=1, dtype=np.uint8 if bits == 8 else np.uint16)
    return x


def _page(data: bytes, tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, s = one(256), one(257), one(277, 1)
    bits, compression, predictor, planar = one(258, 1), one(259, 1), one(317, 1), one(284, 1)
    if not w or not h or not s:
        raise TiffError("image without size")
    if bits not in (8, 16) or compression not in DECODE or predictor not in (1, 2):
        raise TiffError(f"unsupported: {bits} bits, compression {compression}, predictor {predictor}")
    tiled = 324 in tags
    offsets, counts = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if not offsets or not counts or len(offsets) != len(counts):
        raise TiffError("image without strips or tiles")
    bw, bh = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    if not bw or not bh:
        raise TiffError("block without size")
    across, down = -(-w // bw), -(-h // bh)
    layers, deep = (s, 1) if planar == 2 else (1, s)
    if len(offsets) < across * down * layers:
        raise TiffError("too few strips or tiles")
    image = None
    if across * layers > 1 or tiled:
        image = np.empty((h, w, s), np.uint8 if bits == 8 else np.uint16)
    parts = []
    for k in range(across * down * layers):
        layer, cell = divmod(k, across * down)
        r, c = divmod(cell, across)
        if offsets[k] + counts[k] > len(data):
            raise TiffError("strip or tile beyond the end")
        rows = bh if tiled else min(bh, h - r * bh)
        x = _block(DECODE[compression](data[offsets[k] : offsets[k] + counts[k]]), rows, bw, deep, bits, predictor, order)
        if image is None:
            parts.append(x)
        else:
            part = x[: h - r * bh, : w - c * bw]
            image[r * bh : r * bh + part.shape[0], c * bw : c * bw + part.shape[1], layer : layer + deep] = part
    if image is None:
        pixels = b"".join(p.tobytes() if bits == 8 else p.astype("<u2").tobytes() for p in parts)
    else:
        pixels = image.tobytes() if bits == 8 else image.astype("<u2").tobytes()
    return Page(w, h, s, bits, compression, predictor, tiled, pixels, tags)


def read_tiff(data: bytes) -> Iterator[Page]:
    """Pages in directory order; raises TiffError where the file can't be read on."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise TiffError("not a classic TIFF")
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags, order)


# ---------------------------------------------------------------- operators

PAGE_FIELDS = [("page", pa.int32(), "int"), ("width", pa.int32(), "int"), ("height", pa.int32(), "int"), ("samples", pa.int32(), "int"), ("bits", pa.int32(), "int"), ("compression", pa.int32(), "int"), ("predictor", pa.int32(), "int"), ("tiled", pa.bool_(), "boolean"), ("error", pa.string(), "string")]


def tiff_pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = (), derive: dict[str, tuple] | None = None) -> DataFrame:
    """One row per page of the TIFF in ``media``: the ``keep`` columns, what the page is, its samples.

    ``derive`` maps a new column to (Spark type, Arrow type, f(media bytes, page));
    given, it replaces the ``pixels`` column, so that samples need not leave Python.
    Columns of ``df`` that are not in ``keep`` are dropped, so names can't clash.
    """
    made = derive or {"pixels": ("binary", pa.binary(), lambda _, page: page.pixels)}
    kept = df.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {k}" for n, _, k in PAGE_FIELDS), *(f"{n} {k[0]}" for n, k in made.items())])

    def pages(batches):
        for batch in batches:
            source, rows, made_rows, index = batch.column(batch.num_columns - 1), {n: [] for n, _, _ in PAGE_FIELDS}, {n: [] for n in made}, []
            for i in range(batch.num_rows):
                data = source[i].as_py()
                if not data:
                    continue
                k, page = 0, None
                try:
                    for k, page in enumerate(read_tiff(data)):
                        index.append(i)
                        for n, v in zip(rows, (k, page.width, page.height, page.samples, page.bits, page.compression, page.predictor, page.tiled, None)):
                            rows[n].append(v)
                        for n, (_, _, f) in made.items():
                            made_rows[n].append(f(data, page))
                except (TiffError, struct.error, MemoryError, OverflowError, IndexError) as e:
                    index.append(i)
                    for n in rows:
                        rows[n].append(-1 if n == "page" else str(e) if n == "error" else None)
                    for n in made:
                        made_rows[n].append(None)
            taken = batch.take(pa.array(index, pa.int64()))
            columns = [taken.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(rows[n], k) for n, k, _ in PAGE_FIELDS] + [pa.array(made_rows[n], k[1]) for n, k in made.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *rows, *made_rows])

    return df.select(*keep, media).mapInArrow(pages, schema)


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 or 64 * (not data))


def text_tiff(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each whole text as an 8-bit TIFF image 64 samples wide: deflate strips, horizontal predictor.

    Null texts count as empty. Returns the key, ``n_bytes`` (unpadded) and ``media``.
    """

    def store(batches):
        for batch in batches:
            sizes, media = [], []
            for value in batch.column(1):
                data = encode(value.as_py())
                sizes.append(len(data))
                media.append(write_tiff([np.frombuffer(padded(data), np.uint8).reshape(-1, TEXT_WIDTH)], DEFLATE, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(store, f"`{key}` {kind}, n_bytes long, media binary")


def feature(page: Page) -> str:
    """Size, sum, sum of squares, distinct samples and an 8 x 8 average hash of the rows' means."""
    x = np.frombuffer(page.pixels, np.uint8)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    rows = x.reshape(page.height, -1).mean(axis=1)
    cells = np.array([part.mean() if len(part) else 0.0 for part in np.array_split(rows, 64)])
    bits = int("".join("1" if b else "0" for b in cells >= cells.mean()), 2)
    return f"{page.width}x{page.height};sum={int(counts @ levels)};sq={int(counts @ (levels * levels))};distinct={int((counts > 0).sum())};ahash={bits:016x}"


def text_media_digests(df: DataFrame) -> DataFrame:
    """Texts to TIFF and back: the digests of what was stored and of what was read back."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    derive = {
        "payload_bytes": ("long", pa.int64(), lambda _, p: len(p.pixels)),
        "payload_sha256": ("string", pa.string(), lambda _, p: sha(p.pixels)),
        "tail_crc32": ("long", pa.int64(), lambda _, p: zlib.crc32(p.pixels[-64:])),
        "media_bytes": ("long", pa.int64(), lambda m, _: len(m)),
        "media_sha256": ("string", pa.string(), lambda m, _: sha(m)),
        "feature": ("string", pa.string(), lambda _, p: feature(p)),
    }
    pages = tiff_pages(text_tiff(df), keep=("doc_id", "n_bytes"), derive=derive)
    return pages.select("doc_id", "n_bytes", *derive)


def op3_media_tiff(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.shared import documents

    return text_media_digests(documents(spark, sf_dir))
