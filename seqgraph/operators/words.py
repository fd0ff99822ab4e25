"""Runs of ACGT, k-mers and minimizers of each row, as arrays; functions for `mapInArrow` over rows with a column ``seq``.

A run is taken in stretches of ``STRETCH`` k-mers with margins, and rows go out when ``ROWS`` of them are there, so neither a
long sequence nor a large batch is held in arrays as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

STRETCH = 1 << 18
ROWS = 1 << 16
#: Bits of the filter of `filtered`: a fixed size, so a full one only filters less.
FILTER_BITS = 23
# Two bits a base, and 4 for anything else.
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)
_U = np.uint64

Found = Iterator[tuple]


def _told(batches: Iterator[pa.RecordBatch], find: Callable[[str], Found], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The other columns of a row beside each place that ``find`` gives for its sequence, as arrays."""
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "seq"]

        def told(held):
            at = pa.array(np.repeat([i for i, _ in held], [len(x[0]) for _, x in held]).astype(np.int64))
            cols = [pa.array(np.concatenate([x[j] for _, x in held]) if isinstance(held[0][1][j], np.ndarray) else [y for _, x in held for y in x[j]], t) for j, t in enumerate(types.values())]
            return pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in rest] + cols, names=[*rest, *types])

        held, n = [], 0
        for i, seq in enumerate(batch.column("seq")):
            for x in find(seq.as_py() or ""):
                if len(x[0]):
                    held.append((i, x))
                    n += len(x[0])
                if n >= ROWS:
                    yield told(held)
                    held, n = [], 0
        if held:
            yield told(held)


def _runs(seq: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Codes of all letters, one each, and where the maximal runs of ACGT begin and end."""
    codes = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes < 4).view(np.int8), [0]))))
    return codes, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _codes(bases: np.ndarray, k: int, factor: int = 4) -> np.ndarray:
    """The number of each k-mer, first base highest; with another factor than 4 a hash of it, for any k."""
    power, size = bases.astype(_U), 1
    out, have = None, 0
    while True:
        if k & 1:
            m = len(bases) - have - size + 1
            out = power if out is None else out[:m] * _U(pow(factor, size, 1 << 64)) + power[have : have + m]
            have += size
        k >>= 1
        if not k:
            return out
        power = power[: max(len(power) - size, 0)] * _U(pow(factor, size, 1 << 64)) + power[size:]
        size *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """`mix_hash` of each code, unsigned."""
    # fixed values: the shifts of this hash
    x = ~x + (x << _U(21))
    x ^= x >> _U(24)
    x = x + (x << _U(3)) + (x << _U(8))
    x ^= x >> _U(14)
    x = x + (x << _U(2)) + (x << _U(4))
    x ^= x >> _U(28)
    return x + (x << _U(31))


def _over(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The least or largest of each n values side by side, by windows of doubled size."""
    size = 1
    while 2 * size <= n:
        x, size = best(x[:-size], x[size:]), 2 * size
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def find(seq: str) -> Found:
        places = _runs(seq)[1]
        for i in range(0, len(places), ROWS):
            part = places[i : i + ROWS]
            yield np.array([a for a, _ in part], np.int32), [seq[a:b] for a, b in part]

    return _told(batches, find, {"run_off": pa.int32(), "run": pa.string()})


def minimizers(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    n = w - k + 1

    def find(seq: str) -> Found:
        codes, places = _runs(seq)
        for a, b in places:
            count = b - a - k + 1
            for own in range(0, count, STRETCH) if b - a >= w else ():
                upto = min(own + STRETCH, count)
                low, high = max(own - n + 1, 0), min(upto + n - 1, count)
                kmers = _codes(codes[a + low : a + high + k - 1], k)
                h = _mixed(kmers)
                # a window of zeros on either side stands for those that are not there
                lows = np.concatenate((np.zeros(n - 1, _U), _over(h, n, np.minimum), np.zeros(n - 1, _U)))
                chosen = np.flatnonzero((h == _over(lows, n, np.maximum))[own - low : upto - low]) + own - low
                yield a + low + chosen + k - 1, kmers[chosen].view(np.int64)

    return _told(batches, find, {"pos": pa.int64(), "kmer": pa.int64()})


def kmers(batches: Iterator[pa.RecordBatch], k: int, every: int) -> Iterator[pa.RecordBatch]:
    """All k-mers, of equal neighbours each ``every``-th."""

    def find(seq: str) -> Found:
        codes, places = _runs(seq)
        for a, b in places:
            begun = a
            for own in range(a, b - k + 1, STRETCH):
                part = codes[own : min(own + STRETCH, b - k + 1) + k - 1]
                # where the run of one base begins that holds each base
                new = np.concatenate(([own == a or codes[own - 1] != codes[own]], part[1:] != part[:-1]))
                first = np.maximum.accumulate(np.where(new, np.arange(own, own + len(part)), begun))
                end = np.arange(own + k - 1, own + len(part))
                earlier = end - first[k - 1 :] + 1 - k
                kept = np.flatnonzero((earlier <= 0) | (earlier % every == 0))
                yield end[kept], _codes(part, k)[kept].view(np.int64)
                begun = int(first[min(STRETCH, len(part)) - 1])

    return _told(batches, find, {"pos": pa.int64(), "kmer": pa.int64()})


def _slots(bases: np.ndarray, k: int) -> np.ndarray:
    return (_mixed(_codes(bases, k, 0x9E3779B97F4A7C15)) >> _U(64 - FILTER_BITS)).astype(np.int64)


def slots(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Words of 32 bits of the filter with the bits of a batch's k-mers, each word once: ``(word, bits)``."""
    for batch in batches:
        filled = np.zeros(1 << FILTER_BITS, bool)
        for seq in batch.column("seq"):
            codes, places = _runs(seq.as_py() or "")
            for a, b in places:
                for own in range(a, b - k + 1, STRETCH):
                    filled[_slots(codes[own : min(own + STRETCH, b - k + 1) + k - 1], k)] = True
        bits = np.packbits(filled).view(np.uint32).astype(np.int64)
        word = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits[word])], names=["word", "bits"])


def filter_of(rows: list[tuple[int, int]]) -> np.ndarray:
    """The filter from its words."""
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    if rows:
        word, value = np.array(rows, np.int64).T
        bits[word] = value
    return bits.view(np.uint8)


def filtered(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(p, lmer, before, behind)`` of the k-mers whose bit in the filter is set: start, text, and the bases beside them
    in their run."""
    held = np.unpackbits(bits).astype(bool)

    def find(seq: str) -> Found:
        codes, places = _runs(seq)
        for a, b in places:
            for own in range(a, b - k + 1, STRETCH):
                at = own + np.flatnonzero(held[_slots(codes[own : min(own + STRETCH, b - k + 1) + k - 1], k)])
                for i in range(0, len(at), ROWS):
                    p = at[i : i + ROWS]
                    one = p.tolist()
                    yield p.astype(np.int32), [seq[x : x + k] for x in one], [seq[x - 1] if x > a else "" for x in one], [seq[x + k] if x + k < b else "" for x in one]

    return _told(batches, find, {"p": pa.int32(), "lmer": pa.string(), "before": pa.string(), "behind": pa.string()})
