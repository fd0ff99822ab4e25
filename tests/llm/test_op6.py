import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqgraph.llm.op6_tiff import DEFLATE, LZW, NONE, PACKBITS, digests, pack_bits, pack_lzw, read_pages, store, tiff_pages, unpack_bits, unpack_lzw, write_tiff


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 60))
def test_codecs_round_trip(data, times):
    for x in (data, data * times):
        assert unpack_bits(pack_bits(x)) == x
        assert unpack_lzw(pack_lzw(x)) == x


def test_lzw_over_a_full_table():
    x = random.Random(1).randbytes(40_000)
    assert unpack_lzw(pack_lzw(x)) == x


@pytest.mark.parametrize("compression", [NONE, PACKBITS, LZW, DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 48)])
def test_files_round_trip(compression, predictor, tile):
    r = np.random.default_rng(1)
    pages = [r.integers(0, 4, shape, dtype=np.uint8) for shape in ((1, 64), (100, 64), (37, 50))]
    got = list(tiff_pages(write_tiff(pages, compression, predictor, tile, strip_rows=16)))
    assert [(g["height"], g["width"]) for g in got] == [p.shape for p in pages]
    assert [g["data"] for g in got] == [p.tobytes() for p in pages]


def test_big_endian_16_bit_colour():
    image = np.arange(2 * 3 * 3, dtype=">u2").reshape(2, 3, 3) * 999
    strip = zlib.compress(np.diff(image, axis=1, prepend=np.zeros((2, 1, 3), ">u2")).astype(">u2").tobytes())
    tags = [(256, 3), (257, 2), (258, 16), (259, 8), (273, 8), (277, 3), (278, 2), (279, len(strip)), (317, 2)]
    body = b"".join(struct.pack(">HHIHH", t, 3, 1, v, 0) for t, v in tags)
    data = b"MM\0*" + struct.pack(">I", 8 + len(strip)) + strip + struct.pack(">H", len(tags)) + body + b"\0" * 4
    (page,) = tiff_pages(data)
    assert page["data"] == image.astype("=u2").astype(">u2").tobytes() and page["samples"] == 3


def test_query_columns_and_edges(spark):
    texts = [(1, "abc"), (2, ""), (3, None), (4, "é" * 32), (5, "x" * 200_000), (5, "abc"), (None, "y" * 65), (7, "z" * 64)]
    df = spark.createDataFrame([(*t, 1, "e") for t in texts], "doc_id long, text string, page int, error string")
    files = store(df)
    rows = digests(read_pages(files.selectExpr("*", "cast(length(media) as bigint) as media_bytes", "sha2(media, 256) as media_sha256"))).collect()
    got = sorted(((r.doc_id or 0, r.payload_bytes, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows))
    want = []
    for d, t in texts:
        raw = (t or "").encode()
        p = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        want.append((d or 0, len(p), len(raw), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want)
    assert next(r for r in rows if r.n_bytes == 200_000).n_pages == 4
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(b"II*\0\xff\xff\0\0"))], "doc_id long, media binary")
    assert [(r.n_pages, r.error is not None) for r in read_pages(bad).collect()] == [(0, True)] * 3
    assert read_pages(files.limit(0)).count() == 0
