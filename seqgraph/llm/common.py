"""Vectorised text helpers shared by the operators of this subpackage.

Texts stay in their Arrow buffers: words and windows are hashed with numpy over blocks of about half a MB, so memory in a
task is bounded by one block (or one text, where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 19
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
_R = U(0x9E3779B97F4A7C15 | 1)
_R_INV = U(pow(int(_R), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, limit: int = 1 << 22) -> Iterator[None]:
    """Jobs run inside hand whole texts to Arrow tasks in batches of about ``limit`` bytes, or of one row where it is longer;
    the session's own setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(parts)), F.lit(0))


def sampled(labelled: DataFrame, at_most: int, *keys: str) -> DataFrame:
    """About ``at_most`` rows by a hash of ``keys``: a share that follows from one count, the same rows each time."""
    share = min(1.0, at_most / max(1, labelled.count()))
    return labelled if share == 1.0 else labelled.where(F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) of runs of rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _power(base: U, name: str, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, U)
        have[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(have)
    return have[:n]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, the index of its first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[0] = edge[n] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:n]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z in lower case, and for each row the index of its first word."""
    starts, ends, first = word_bounds(data, at)
    return span_hashes(_LOWER[data] if lower else data, starts, ends), first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end."""
    if not len(starts):
        return np.zeros(0, U)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(_R, "up", len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_R_INV, "down", len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct 62-bit hashes of its k-word shingles; a shorter row is one shingle, an empty row none."""
    n = len(words) - k + 1
    odd = [U((0xA0761D6478BD642F * (2 * i + 3)) & (2**64 - 1) | 1) for i in range(k)]
    with np.errstate(over="ignore"):
        if n > 0:
            total = words[:n] * odd[0]
            for i in range(1, k):
                total = total + words[i : n + i] * odd[i]
            total = (mix(total) >> U(2)).astype(np.int64)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(distinct(total[a : b - k + 1]))
            elif b > a:
                x = U(b - a)
                for i in range(a, b):
                    x = mix(np.array([x * U(0xE7037ED1A0B428DB) + words[i]], U))[0]
                out.append(np.array([x >> U(2)], np.int64))
            else:
                out.append(np.zeros(0, np.int64))
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of all runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else [], kind))


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _range_bits(frame: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(1 << 10, np.uint64)
    out[frame["w"].to_numpy(np.int64) & 1023] = frame["b"].to_numpy(np.int64).astype(np.uint64)
    return pd.DataFrame({"r": frame["r"].iloc[:1], "bits": [out.tobytes()]})


def bit_map(keys: DataFrame, column: str, log2: int) -> np.ndarray:
    """A bit for each value modulo 2**log2: of fixed size, gathered in pieces of 8 kB."""
    at = F.col(column).bitwiseAND(F.lit((1 << log2) - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({column} & 63))")).alias("b"))
    out = np.zeros((1 << max(0, log2 - 16), 1 << 10), np.uint64)
    for row in words.withColumn("r", F.shiftright("w", 10)).groupBy("r").applyInPandas(_range_bits, "r long, bits binary").toLocalIterator():
        out[row.r] = np.frombuffer(row.bits, np.uint64)
    return out.reshape(-1)[: 1 << (log2 - 6)]
