"""Runs, k-mers and minimizers as arrays, against plain searches."""

import random
import time

import pyarrow as pa

from seqgraph.operators import words


def told(seqs, f, *args):
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(seqs))), "seq": seqs})
    return [tuple(r.values()) for b in f(iter([batch]), *args) for r in b.to_pylist()]


def test_runs_of_a_long_text_take_time_by_its_length():
    seq = "ACNx" * 200_000 + "\u00e9G"
    begun = time.time()
    got = told([seq, None, "", "NN"], words.runs)
    assert got == [(0, 4 * i, "AC") for i in range(200_000)] + [(0, 800_001, "G")]
    assert time.time() - begun < 30


def plain_minimizers(seq, k, w):
    n, out = w - k + 1, set()
    hashed = lambda s: int(words._mixed(words._codes(words._CODE[list(s.encode())], k))[0])
    for a in range(len(seq) - w + 1):
        if "N" not in seq[a : a + w]:
            h = [hashed(seq[a + i : a + i + k]) for i in range(n)]
            out |= {(0, a + i + k - 1, int(seq[a + i : a + i + k].translate(str.maketrans("ACGT", "0123")), 4)) for i in range(n) if h[i] == min(h)}
    return out


def test_stretches_join_without_a_seam(monkeypatch):
    r = random.Random(4)
    seq = "".join(r.choices("ACGT", k=300)) + "A" * 90 + "N" + "".join(r.choices("AG", k=150)) + "ACGTNACGTACGTACGTAC"
    for stretch in (7, 64, 1 << 18):
        monkeypatch.setattr(words, "STRETCH", stretch)
        assert told([seq], words.minimizers, 5, 9) == sorted(plain_minimizers(seq, 5, 9))
        want, n, last = [], 0, None
        for p in range(4, len(seq)):
            s = seq[p - 4 : p + 1]
            n, last = (n + 1, s) if s == last else (0, s)
            if "N" not in s and n % 5 == 0:
                want.append((0, p, int(s.translate(str.maketrans("ACGT", "0123")), 4)))
        assert told([seq], words.kmers, 5, 5) == want


def test_the_filter_keeps_what_the_graph_holds_and_little_else(monkeypatch):
    r = random.Random(6)
    node, other = ("".join(r.choices("ACGT", k=20_000)) for _ in range(2))
    bits = words.filter_of([(w, b) for x in words.slots(iter([pa.RecordBatch.from_pydict({"seq": [node]})]), 33) for w, b in zip(*x.to_pydict().values())])
    monkeypatch.setattr(words, "STRETCH", 1000)
    got = told([other + "N" + node[100:1500]], words.filtered, 33, bits)
    mine = [x for x in got if x[1] > 20_000]
    assert [x[1] for x in mine] == list(range(20_001, 20_001 + 1400 - 32))
    assert mine[0][2:] == (node[100:133], "", node[133]) and mine[-1][2:] == (node[1467:1500], node[1466], "")
    assert len(got) - len(mine) < 200
