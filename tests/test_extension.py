"""Fronts within nodes, closed slices, ends and steps against plain searches."""

import random

import pytest

from seqgraph.operators import extension, fronts
from seqgraph.params import AlignParams

COST = 2.94


def dna(r, k):
    return "".join(r.choices("ACGT", k=k))


def changed(r, s, share):
    out = []
    for c in s:
        u = r.random()
        out.append(dna(r, 1) if u < share / 3 else "" if u < 2 * share / 3 else c + dna(r, 1) if u < share else c)
    return "".join(out)


def matrix(q, n, band):
    """The best score of a prefix of q along n, and the edits of q along all of n."""
    best, prev = 0.0, {o: o for o in range(band + 1)}
    for i in range(1, len(q) + 1):
        cur = {}
        for o in range(max(0, i - band), min(len(n), i + band) + 1):
            v = prev.get(o, 1 << 30) + 1
            if o:
                v = min(v, cur.get(o - 1, 1 << 30) + 1, prev.get(o - 1, 1 << 30) + (q[i - 1] != n[o - 1]))
            cur[o] = v
            best = max(best, i - COST * v)
        prev = cur
    return best, prev.get(len(n))


def graph(spark, nodes, edges):
    onodes = spark.createDataFrame([(n, n // 2, n % 2 == 1, str(n // 2), s, len(s)) for n, s in nodes.items()], "onode_id long, node_id long, is_rev boolean, name string, seq string, len int")
    return onodes, spark.createDataFrame(edges, "src long, dst long, overlap int")


def steps_hold(ops, q, n):
    i = j = 0
    for op in ops:
        assert op != "=" or q[i] == n[j]
        i, j = i + (op != "D"), j + (op != "I")
    return (i, j) == (len(q), len(n))


@pytest.mark.parametrize("seed", range(6))
def test_steps_take_the_fewest_edits(seed):
    r = random.Random(seed)
    for k in range(60):
        n = dna(r, r.randint(0, 40))
        q = changed(r, n, 0.3) if k % 3 else dna(r, r.randint(0, 30))
        ops = fronts.steps(q, n)
        assert steps_hold(ops, q, n)
        assert len(ops.replace("=", "")) == matrix(q, n, 100)[1]


def test_runs_stop_where_bases_share_none():
    a, i = fronts.words(["ACGTN" * 7, "R", "", "acgu"])
    b, j = fronts.words(["ACGTA" * 7 + "C", "A", "A", "ACGT"])
    import numpy as np

    assert fronts.runs(a, np.array(i), b, np.array(j)).tolist() == [35, 1, 0, 4]


def test_long_noisy_reads_equal_a_full_search(spark):
    """Nodes of more than one piece, a read that ends within one, and one whose second half is noise."""
    r = random.Random(5)
    g = dna(r, 3400)
    nodes = {0: g[:2600], 2: g[2600 - 7 : 2650], 4: g[2650:]}
    onodes, oedges = graph(spark, nodes, [(0, 2, 7), (2, 4, 0)])
    reads = {f"r{k}": changed(r, g[: 900 * k + 700], 0.1) for k in range(4)} | {"half": changed(r, g[:1500], 0.08) + dna(r, 900)}
    starts = spark.createDataFrame([(k, 1, 0, 0, q) for k, q in reads.items()], "aln_id string, side int, onode_id long, off long, query string")
    got = {x.aln_id: x for x in extension.extend(starts, onodes, oedges, AlignParams(bandwidth=35)).collect()}
    for k, q in reads.items():
        assert round(got[k].x, 4) == round(matrix(q, g, 160)[0], 4)
        x = got[k]
        begin = {0: 0, 2: 2593, 4: 2650}[x.onode_id]
        assert steps_hold(x.ops, q[: x.rpos], g[: begin + x.off]) and len(x.ops.replace("=", "")) == x.e
        assert x.path == [0, 2, 4][: 1 + (x.onode_id > 0) + (x.onode_id > 2)]


def closed_at(spark, anchor, onodes, oedges, slices):
    told = anchor.select("aln_id", "read_id", "read_pos", "match_len").collect()
    offsets = [(x.aln_id, 1, x.read_id, x.read_pos + x.match_len) for x in told] + [(x.aln_id, 0, x.read_id, x.read_pos) for x in told]
    shut = spark.createDataFrame([(1, n, s) for n, s in slices], "read_id long, onode_id long, slice long"), spark.createDataFrame(offsets, "aln_id string, side int, read_id long, shift long")
    sides = extension.extend(extension.anchor_starts(anchor), onodes, oedges, AlignParams(), shut)
    return [(x.read_start, x.read_end, x.path_start, x.path_end_off) for x in extension.merged(sides, anchor, onodes, 0.66).collect()]


def test_a_front_stops_at_the_border_of_a_closed_slice(spark):
    r = random.Random(8)
    g = dna(r, 400)
    onodes, oedges = graph(spark, {0: g, 1: g[::-1].translate(str.maketrans("ACGT", "TGCA"))}, [(0, 2, 0)])
    anchor = spark.createDataFrame([("a", 1, 0, 400, 150, 150, 20, g)], "aln_id string, read_id long, onode_id long, onode_len int, off long, read_pos long, match_len int, seq string")
    assert closed_at(spark, anchor, onodes, oedges, [(0, 10_000)]) == [(0, 400, 0, 400)]
    # the slice behind the anchor's: it begins at 192; a run would go on into an open slice
    assert closed_at(spark, anchor, onodes, oedges, [(0, 192)]) == [(0, 192, 0, 192)]
    # the slice in which both sides begin, and one on the way back
    assert closed_at(spark, anchor, onodes, oedges, [(0, 128)]) == [(150, 170, 150, 170)]
    assert closed_at(spark, anchor, onodes, oedges, [(0, 64)]) == [(128, 400, 128, 400)]


def test_traces_beside_the_best_one(spark):
    """Two ways behind a fork, the second with two mismatches: with its share of the score it is an alignment too."""
    from seqgraph.plans import align

    r = random.Random(11)
    a, b, c = dna(r, 120), dna(r, 150), dna(r, 60)
    d = b[:40] + ("A" if b[40] != "A" else "C") + b[41:90] + ("A" if b[90] != "A" else "C") + b[91:]
    nodes = spark.createDataFrame([(0, "a", a), (1, "b", b), (2, "d", d), (3, "c", c)], "node_id long, name string, seq string")
    edges = spark.createDataFrame([(0, True, 1, True, 0), (0, True, 2, True, 0)], "from_id long, from_end boolean, to_id long, to_end boolean, overlap int")
    # read backwards: the fork lies on the left of the anchor, so both ways have a start of their own
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([(1, back(a + b), 270)], "read_id long, seq string, len int")
    how = dict(k=15, w=20, ignore_frequent=0.0, density=-1.0)
    found = {}
    for most in (1, 10):
        alns = align.align(reads, nodes, edges, AlignParams(max_traces=most, **how))
        assert extension.violations(alns).count() == 0
        found[most] = sorted((x.path_text, x.edits) for x in alns.collect())
    assert ("<b<a", 0) in found[1] and ("<b<a", 0) in found[10]
    assert set(found[1]) <= set(found[10])


def test_ends_beside_the_best_one(spark):
    """Behind a fork of two ways, the second with one mismatch: one end is traced, or both."""
    r = random.Random(12)
    a, b = dna(r, 30), dna(r, 60)
    d = b[:30] + ("A" if b[30] != "A" else "C") + b[31:]
    onodes, oedges = graph(spark, {0: a, 2: b, 4: d}, [(0, 2, 0), (0, 4, 0)])
    starts = spark.createDataFrame([("t", 1, 0, 0, a + b)], "aln_id string, side int, onode_id long, off long, query string")
    ends, entries, queries = extension.explored(starts, onodes, oedges, AlignParams(), None, 0.9)
    clusters = spark.createDataFrame([("t", 1, 1, 1, 0, True)], "aln_id string, side int, read_id long, cluster int, shift long, ahead boolean")
    told = extension.traced_ends(extension.end_points(ends, oedges, clusters, 10, 0.9), entries, queries, onodes)
    got = {(x["rank"], tuple(x.path), x.rpos, x.e, x.ops) for x in told.collect()}
    assert got == {(1, (0, 2), 90, 0, "=" * 90), (2, (0, 4), 90, 1, "=" * 60 + "X" + "=" * 29)}
    only = extension.end_points(ends, oedges, clusters, 1, 0.9)
    assert [(x["rank"], x.onode_id) for x in only.collect()] == [(1, 2)]


def test_seedless_alignment_begins_again_behind_what_fails(spark):
    """Two passages of the graph in one read, noise between and behind them: the second is found from a restart only."""
    from seqgraph.plans import align

    r = random.Random(21)
    g = [dna(r, 90) for _ in range(2)]
    noise = "".join(r.choices("AC", k=60))
    nodes = spark.createDataFrame([(k, f"n{k}", s) for k, s in enumerate(g)], "node_id long, name string, seq string")
    edges = spark.createDataFrame([], "from_id long, from_end boolean, to_id long, to_end boolean, overlap int")
    reads = spark.createDataFrame([(1, g[0] + noise + g[1][:80] + "AC" * 15, 260)], "read_id long, seq string, len int")
    how = dict(seeding="seedless", min_score=40.0, x_drop=1000)
    found = {}
    for stride in (0, 30):
        alns = align.align(reads, nodes, edges, AlignParams(restart_stride=stride, **how))
        found[stride] = {(x.path_text, x.read_start, x.read_end) for x in alns.where("xscore > 60").collect()}
    assert {p for p, _, _ in found[0]} == {">n0"}
    assert {p for p, _, _ in found[30]} == {">n0", ">n1"}
    assert any(p == ">n1" and a >= 140 and b >= 228 for p, a, b in found[30])
