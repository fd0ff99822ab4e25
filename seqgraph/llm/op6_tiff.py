"""TIFF media columns: texts stored as grey images, and image files read back page by page.

`read_pages` walks a file's image directories, decodes strips or tiles (none, PackBits, LZW or deflate), undoes
horizontal differencing and emits one row for each page. `store` writes such files. Both work row by row in Arrow tasks
and hold one file at a time; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seqgraph.llm.common import table

# Fixed values of the format: tag numbers, sizes of field types, compression numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257

SIDE = 64
PAGE_ROWS = 1024
BATCH = 8 << 20


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, plain = bytearray(), 0, bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            out.append(len(plain[k : k + 128]) - 1)
            out.extend(plain[k : k + 128])
        plain.clear()

    while i < len(data):
        j = i
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            flush()
            out += bytes((257 - (j - i), data[i]))
        else:
            plain.extend(data[i:j])
        i = j
    flush()
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    table_: list[bytes] = []
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> bits - width
            bits -= width
            held &= (1 << bits) - 1
            if code == END:
                return b"".join(out)
            if code == CLEAR:
                table_ = [bytes((i,)) for i in range(256)] + [b"", b""]
                width, last = 9, b""
                continue
            if not table_:
                raise ValueError("no clear code")
            if code < len(table_):
                now = table_[code]
            elif code == len(table_) and last:
                now = last + last[:1]
            else:
                raise ValueError("bad code")
            out.append(now)
            if last:
                table_.append(last + now[:1])
            last = now
            if len(table_) + 1 >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    codes: dict[bytes, int] = {}
    width, now = 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> bits - 8 & 255)
            bits -= 8
            held &= (1 << bits) - 1

    put(CLEAR)
    codes = {bytes((i,)): i for i in range(256)}
    size = 258
    for i in range(len(data)):
        byte = data[i : i + 1]
        if now + byte in codes:
            now += byte
            continue
        put(codes[now])
        codes[now + byte] = size
        size += 1
        if size + 1 > 1 << width:
            width += 1
        if size >= 4094:
            width = 12
            put(CLEAR)
            codes, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        now = byte
    if now:
        put(codes[now])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 4)}
UNPACK = {NONE: bytes, PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, strip_rows: int = 128) -> bytes:
    """A little-endian file of 8-bit pages (rows x columns), in strips or, with ``tile`` (width, height), in tiles."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        rows, cols = page.shape
        if tile:
            parts = [np.pad(page[y : y + tile[1], x : x + tile[0]], ((0, max(0, y + tile[1] - rows)), (0, max(0, x + tile[0] - cols)))) for y in range(0, rows, tile[1]) for x in range(0, cols, tile[0])]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, rows, strip_rows)]
        at, sizes = [], []
        for p in parts:
            if predictor == 2:
                p = np.diff(p, axis=1, prepend=np.zeros((len(p), 1), np.uint8))
            packed = b"".join(pack_bits(r.tobytes()) for r in p) if compression == PACKBITS else PACK[compression](p.tobytes())
            at.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        tags = [(WIDTH, [cols]), (HEIGHT, [rows]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        tags += [(TILE_W, [tile[0]]), (TILE_H, [tile[1]]), (TILE_AT, at), (TILE_SIZE, sizes)] if tile else [(STRIP_AT, at), (ROWS, [strip_rows]), (STRIP_SIZE, sizes)]
        fields = b""
        for tag, values in sorted(tags):
            if len(values) == 1:
                fields += struct.pack("<HHII", tag, 4, 1, values[0])
            else:
                fields += struct.pack("<HHII", tag, 4, len(values), len(out))
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(data: bytes) -> Iterator[dict]:
    """One dict for each image directory: page, width, height, samples, bits and the decoded bytes, row by row."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, page, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPES:
                size, code = TYPES[kind]
                where = at + 2 + 12 * k + 8
                if size * n > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, where)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
        one = lambda tag, default=None: tags[tag][0] if tag in tags or default is None else default  # noqa: B023, E731
        cols, rows, spp, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
        if bits not in (8, 16) or one(PLANAR, 1) != 1:
            raise ValueError("only 8 and 16 bits in one plane are read")
        kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
        image = np.zeros((rows, cols, spp), kind)
        tiled = TILE_AT in tags
        w, h = (one(TILE_W), one(TILE_H)) if tiled else (cols, min(rows, one(ROWS, rows)))
        across = -(-cols // w) if cols else 1
        for k, (a, size) in enumerate(zip(tags[TILE_AT if tiled else STRIP_AT], tags[TILE_SIZE if tiled else STRIP_SIZE], strict=True)):
            y, x = k // across * h, k % across * w
            high = h if tiled else min(h, rows - y)
            part = np.frombuffer(UNPACK[one(COMPRESSION, 1)](data[a : a + size]), kind)[: high * w * spp].reshape(high, w, spp)
            if one(PREDICTOR, 1) == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
            image[y : y + high, x : x + w] = part[: rows - y, : cols - x]
        yield {"page": page, "width": cols, "height": rows, "samples": spp, "bits": bits, "data": image.tobytes()}
        page += 1


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of SIDE, and the length without them."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(1, -(-len(raw) // SIDE)) * SIDE - len(raw)), len(raw)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += size(r) + 64
        if weight > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _store(batches):
    def rows():
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data, n = payload(text)
                image = np.frombuffer(data, np.uint8).reshape(-1, SIDE)
                yield key, n, write_tiff([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)])

    yield from _batches(rows(), pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]), lambda r: len(r[2]))


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text as a deflated grey image of SIDE columns, a page for each PAGE_ROWS rows."""
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


PAGE = "page int, n_pages int, width int, height int, samples int, bits int, data binary, error string"


def _pages(batches):
    schema = None
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "media"]
        schema = pa.schema([*(batch.schema.field(c) for c in rest), ("page", pa.int32()), ("n_pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("data", pa.binary()), ("error", pa.string())])

        def rows():
            for i, media in enumerate(batch.column("media").to_pylist()):  # noqa: B023
                own = tuple(batch.column(c)[i].as_py() for c in rest)  # noqa: B023
                try:
                    pages = list(tiff_pages(media or b""))
                    yield from ((*own, p["page"], len(pages), p["width"], p["height"], p["samples"], p["bits"], p["data"], None) for p in pages)
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    yield (*own, None, 0, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])

        yield from _batches(rows(), schema, lambda r: len(r[-2] or b""))


def read_pages(media: DataFrame) -> DataFrame:
    """One row for each page of the files in column ``media``, with the other columns; pages of a file are in order.

    A null, broken or unsupported file gives one row with ``error`` set and no page. Columns of media that are named as
    the result's own are dropped.
    """
    own = T._parse_datatype_string(PAGE).names
    media = media.drop(*own)
    fields = ", ".join(f"`{n}` {t}" for n, t in media.dtypes if n != "media")
    return media.mapInArrow(_pages, f"{fields}, {PAGE}" if fields else PAGE)


def feature(data: np.ndarray) -> str:
    """Mean, deviation, entropy in bits, share of zero bytes and of changes between neighbours."""
    share = np.bincount(data, minlength=256) / len(data)
    some = share[share > 0]
    return ",".join(f"{x:.6f}" for x in (data.mean(), data.std(), -(some * np.log2(some)).sum(), share[0], (data[1:] != data[:-1]).mean()))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())])


def _digest(batches):
    parts: list[bytes] = []

    def rows():
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "n_pages", "data")]
            for key, n, size, sha, page, pages, data in zip(*cols, strict=True):
                if page == 0:
                    parts.clear()
                parts.append(data)
                if page == pages - 1:
                    whole = b"".join(parts)
                    yield key, n, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-SIDE:]), size, sha, feature(np.frombuffer(whole, np.uint8)), pages

    yield from _batches(rows(), RESULT, lambda r: 200)


def digests(pages: DataFrame) -> DataFrame:
    """A row for each file whose pages follow one another in ``pages``, as `read_pages` gives them."""
    return pages.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = store(table(spark, sf_dir, "documents"))
    return digests(read_pages(files.selectExpr("*", "cast(length(media) as bigint) as media_bytes", "sha2(media, 256) as media_sha256")))


QUERIES = {"op6_tiff": op6_tiff}
SQL: dict = {}
