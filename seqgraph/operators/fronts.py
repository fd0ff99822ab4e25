"""Edit wavefronts within nodes, as arrays over all rows of a batch at once.

A cell is a diagonal (place in the node less place in the query) of a row with the furthest place that so many edits
reach. One step gives each live cell its mismatch, insertion and deletion, keeps the furthest of each diagonal, and slides
all over equal bases, eight at a time: bases are masks of four bits, so ambiguous ones are equal where they share a base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 64
LEAST = -(1 << 40)
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
# The bases that each letter stands for, in bits of A, C, G and T.
_BASES = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "K": 12, "M": 3, "S": 6, "W": 9, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}
_MASK = np.array([_BASES.get(chr(c).upper(), 0) for c in range(256)], np.uint8)
POINT = "side int, onode_id long, kind int, slice long, off long, rpos long, e int, x double, from_off long, from_rpos long, from_e int, from_hop int"
EXIT, END = 0, 1


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The masks of all texts, eight from each place on as one number, with zeros behind each text; and where each begins."""
    size = np.array([len(t) + 8 for t in texts], np.int64)
    flat = np.zeros(int(size.sum()) + 8, np.uint8)
    at = np.cumsum(size) - size
    for a, t in zip(at.tolist(), texts, strict=True):
        flat[a : a + len(t)] = _MASK[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)]
    out = np.zeros(len(flat) - 8, np.uint64)
    for k in range(8):
        out |= flat[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out, at


def runs(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal bases from places i of a and j of b on."""
    out = np.zeros(len(i), np.int64)
    on = np.arange(len(i))
    while len(on):
        both = a[i[on] + out[on]] & b[j[on] + out[on]]
        none = (both - _ONES) & ~both & _TOPS
        last = none != 0
        low = none[last] & (~none[last] + np.uint64(1))
        out[on[last]] += np.log2(low.astype(np.float64)).astype(np.int64) // 8
        on = on[~last]
        out[on] += 8
    return out


def furthest(key: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Of equal keys the index of the first by ``by``, in order of the keys."""
    order = np.lexsort((*by[::-1], key))
    return order[np.concatenate(([True], key[order][1:] != key[order][:-1]))] if len(order) else order


class Batch:
    """The rows of a batch: a piece of the query from base q0 on and one of the node from n0 up to nend, the query's length
    qlen, entries into the piece, the best score top so far, and spans of the query that are closed on the node."""

    def __init__(self, b: pa.RecordBatch, drop: float, cost: float, band: int, fraction: float):
        get = lambda c: b.column(c).to_pylist()
        self.drop, self.cost, self.band, self.fraction = drop, cost, band, fraction
        self.q, self.q_at = words(get("query"))
        self.n, self.n_at = words(get("nseq"))
        self.q0, self.n0, self.qlen, self.nend = (np.array(get(c), np.int64) for c in ("q0", "n0", "qlen", "nend"))
        self.top = np.array(get("top"), float)
        entries = [(i, x["off"], x["rpos"], x["e"], x["hop"]) for i, row in enumerate(get("entries")) for x in row]
        self.row, self.off, self.rpos, self.e, self.hop = np.array(entries, np.int64).reshape(-1, 5).T
        self.closed = np.zeros(len(self.q) + 1, bool)
        for i, spans in enumerate(get("closed") if "closed" in b.schema.names else []):
            for s in spans or []:
                lo, hi = (self.q_at[i] + max(0, x - int(self.q0[i])) for x in (s["start"], s["end"]))
                stop = self.q_at[i + 1] if i + 1 < len(self.q_at) else len(self.q)
                self.closed[min(lo, stop) : min(hi, stop)] = True
        self.bars = bool(self.closed.any())
        # a run ends at the first closed base behind its begin
        self.next_closed = np.append(np.minimum.accumulate(np.where(self.closed, np.arange(len(self.closed)), 1 << 60)[::-1])[::-1], 1 << 60) if self.bars else None

    def slid(self, row: np.ndarray, k: np.ndarray, rpos: np.ndarray) -> np.ndarray:
        i = self.q_at[row] + rpos - self.q0[row]
        far = runs(self.q, i, self.n, self.n_at[row] + rpos + k - self.n0[row])
        if self.bars:
            far = np.minimum(far, self.next_closed[i] - i)
        return rpos + far

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Exits and, for each row and slice of the read, the cell of best score: columns row, slice, off, rpos, e, entry."""
        rows, base = len(self.q0), np.maximum(self.q0 - 1, 0) // SLICE
        slices = int((np.diff(np.append(self.q_at, len(self.q))) // SLICE).max(initial=0)) + 3
        least = np.full((rows, slices), 1 << 40, np.int64)  # edits
        best, cells = np.full((rows, slices), -np.inf), np.zeros((rows, slices, 4), np.int64)
        first = np.full(rows, 1 << 40, np.int64)
        np.minimum.at(first, self.row, self.e)
        level = self.e - first[self.row]
        waits = np.unique(level).tolist()
        width = 1 << 33  # wider than any range of diagonals
        done = np.zeros(0, np.int64)  # diagonals that have come to an end of node or query
        exits = [np.zeros((6, 0), np.int64)]
        row = k = rpos = who = np.zeros(0, np.int64)
        step = 0
        while len(row) or waits:
            if waits and (waits[0] == step or not len(row)):
                step = waits.pop(0)
                new = np.flatnonzero(level == step)
                row, k, rpos, who = (np.concatenate(x) for x in ((row, self.row[new]), (k, self.off[new] - self.rpos[new]), (rpos, self.rpos[new]), (who, new)))
            key = row * width + k + (width >> 1)
            fresh = ~np.isin(key, done)
            row, k, rpos, who, key = (x[fresh] for x in (row, k, rpos, who, key))
            one = furthest(key, -rpos, who)
            row, k, rpos, who, key = (x[one] for x in (row, k, rpos, who, key))
            far = self.slid(row, k, rpos)
            e = first[row] + step
            end = np.maximum(far - 1, 0) // SLICE
            # the last base of each slice that a run passes, and the run's own end
            begin = np.maximum(rpos - 1, 0) // SLICE
            at = np.repeat(np.arange(len(row)), end - begin + 1)
            slice_ = begin[at] + np.arange(len(at)) - np.repeat(np.cumsum(end - begin + 1) - (end - begin + 1), end - begin + 1)
            here = np.minimum(far[at], (slice_ + 1) * SLICE)
            x = here - self.cost * e[at]
            top = furthest(row[at] * width + slice_, -x, k[at])
            top = top[x[top] > best[row[at][top], (slice_ - base[row[at]])[top]]]
            r, s = row[at][top], (slice_ - base[row[at]])[top]
            best[r, s] = x[top]
            cells[r, s] = np.stack([(here + k[at])[top], here[top], e[at][top], who[at][top]], 1)
            np.maximum.at(self.top, row, far - self.cost * e)
            out = far + k >= self.nend[row]
            exits.append(np.stack([row[out], end[out], (far + k)[out], far[out], e[out], who[out]]))
            over = out | (far >= self.qlen[row])
            done = np.concatenate((done, key[over]))
            np.minimum.at(least, (row, end - base[row]), e)
            live = ~over & (far - self.cost * e >= self.top[row] - self.drop) & (e <= least[row, end - base[row]] + self.band)
            live &= self.qlen[row] - self.cost * (e + 1) > self.fraction * self.top[row]
            row, k, rpos, who = row[live], k[live], far[live], who[live]
            took = ~self.closed[self.q_at[row] + rpos - self.q0[row]] if self.bars else np.ones(len(row), bool)
            # a mismatch, an insertion in the read, a deletion from it
            row, k, rpos, who = (np.concatenate(x) for x in ((row[took], row[took], row), (k[took], k[took] - 1, k + 1), (rpos[took] + 1, rpos[took] + 1, rpos), (who[took], who[took], who)))
            step += 1
        r, s = np.nonzero(best > -np.inf)
        return np.concatenate(exits, 1), np.concatenate([np.stack([r, s + base[r]]), cells[r, s].T])

    def table(self, b: pa.RecordBatch) -> pa.RecordBatch:
        exits, ends = self.points()
        row, slice_, off, rpos, e, who = np.concatenate([exits, ends], 1)
        kind = np.repeat([EXIT, END], [exits.shape[1], ends.shape[1]])
        take = pa.array(row)
        ints = lambda v, t=pa.int64(): pa.array(v, t)
        return pa.RecordBatch.from_arrays(
            [*(b.column(c).take(take) for c in ("aln_id", "side", "onode_id")), ints(kind, pa.int32()), ints(slice_), ints(off), ints(rpos), ints(e, pa.int32()), pa.array(rpos - self.cost * e), ints(self.off[who]), ints(self.rpos[who]), ints(self.e[who], pa.int32()), ints(self.hop[who], pa.int32())],
            names=["aln_id", "side", "onode_id", "kind", "slice", "off", "rpos", "e", "x", "from_off", "from_rpos", "from_e", "from_hop"],
        )


def advanced(batches: Iterator[pa.RecordBatch], drop: float, cost: float, band: int, fraction: float, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            yield Batch(part, drop, cost, band, fraction).table(part)


def steps(query: str, node: str) -> str:
    """The steps of the fewest edits that lead through both texts whole; of equal ones a mismatch, then an insertion."""
    (a, i0), (b, j0) = words([query]), words([node])
    m, n = len(query), len(node)
    slide = lambda r, k: r + runs(a, i0[0] + r, b, j0[0] + r + k)
    fronts = [(np.array([0]), slide(np.array([0]), np.array([0])))]  # by edits: places before and behind the run
    while True:
        d = len(fronts) - 1
        if abs(n - m) <= d and fronts[d][1][n - m + d] >= m:
            break
        k = np.arange(-d - 1, d + 2)
        past = np.concatenate(([LEAST] * 2, fronts[d][1], [LEAST] * 2))
        x = np.where((past[1:-1] < m) & (past[1:-1] + k < n), past[1:-1] + 1, LEAST)
        ins = np.where(past[2:] < m, past[2:] + 1, LEAST)
        dele = np.where(past[:-2] + k - 1 < n, past[:-2], LEAST)
        here = np.maximum(np.maximum(x, ins), dele)
        far, on = here.copy(), here >= 0
        far[on] = slide(here[on], k[on])
        fronts.append((here, far))
    out, k = [], n - m
    for d in range(len(fronts) - 1, -1, -1):
        here, far = fronts[d][0][k + d], fronts[d][1][k + d]
        out.append("=" * int(far - here))
        if d:
            past = lambda j: fronts[d - 1][1][j + d - 1] if -d < j < d else LEAST  # noqa: B023, E731
            if past(k) + 1 == here and past(k) + k < n:
                out.append("X")
            elif past(k + 1) + 1 == here:
                out.append("I")
                k += 1
            else:
                out.append("D")
                k -= 1
    return "".join(reversed(out))


def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the columns query and nseq by the steps between them."""
    for b in batches:
        found = ["=" * len(q) if q == n else steps(q, n) for q, n in zip(b.column("query").to_pylist(), b.column("nseq").to_pylist(), strict=True)]
        rest = [c for c in b.schema.names if c not in ("query", "nseq")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(found, pa.string())], [*rest, "ops"])
