"""Exact matches, chunks and circles against plain searches."""

import random

from pyspark.sql import functions as F

from seqgraph.operators import dbg, seeding


def back(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_mems(q, n, least):
    out = set()
    for i in range(len(q)):
        for j in range(len(n)):
            if q[i] == n[j] != "N" and (not i or not j or q[i - 1] != n[j - 1] or q[i - 1] == "N"):
                k = 0
                while i + k < len(q) and j + k < len(n) and q[i + k] == n[j + k] != "N":
                    k += 1
                if k >= least:
                    out.add((i, j, k))
    return out


def test_maximal_matches_equal_a_plain_search(spark):
    r = random.Random(3)
    dna = lambda k, a="ACGT": "".join(r.choices(a, k=k))
    nodes = {k: dna(r.randint(0, 700), "ACGT" if k % 2 else "AC") for k in range(6)} | {6: "A" * 60, 7: "AC" * 40, 8: dna(30) + "N" + dna(20)}
    reads = {k: nodes[k][r.randint(0, 40) :][: r.randint(0, 600)] + dna(9) + nodes[k + 1][:50] for k in range(6)} | {6: "A" * 45 + "N" + "A" * 20, 7: "CA" * 30, 8: ""}
    df = lambda rows, key: spark.createDataFrame(sorted(rows.items()), f"{key} long, seq string")
    got = {tuple(x) for x in seeding.mems(df(reads, "read_id"), df(nodes, "onode_id"), 11).select("read_id", "onode_id", "read_pos", "off", "match_len").collect()}
    assert got == {(a, b, *m) for a, q in reads.items() for b, n in nodes.items() for m in plain_mems(q, n, 11)}


def test_a_run_of_one_base_has_a_match_for_each_diagonal(spark):
    """The rows before the match ends are paired are as many as the matches, not as the pairs of places."""
    n = 20_000
    one = lambda key: spark.createDataFrame([(1, "A" * n)], f"{key} long, seq string")
    got = seeding.mems(one("read_id"), one("onode_id"), 20)
    assert got.count() == 2 * (n - 20) + 1
    assert got.agg(F.max("match_len")).first()[0] == n


def test_chunks_join_without_a_seam(spark, monkeypatch):
    monkeypatch.setattr(seeding, "CHUNK", 512)
    r = random.Random(9)
    seq = "".join(r.choices("ACGT", k=700)) + "T" * 1100 + "N" + "".join(r.choices("AG", k=1500)) + "A" * 512
    df = spark.createDataFrame([(1, seq)], "read_id long, seq string")
    got = sorted((x.pos, x.kmer) for x in seeding.read_kmers(df, 15, 20).collect())
    want, n, last = [], 0, None
    for p in range(14, len(seq)):
        s = seq[p - 14 : p + 1]
        if "N" in s:
            last = None
            continue
        n = n + 1 if s == last else 0
        last = s
        if n % 6 == 0:
            want.append((p, int(s.translate(str.maketrans("ACGT", "0123")), 4)))
    assert got == want
    minis = {x.pos for x in seeding.minimizers(df, "read_id", 15, 20).collect()}
    monkeypatch.setattr(seeding, "CHUNK", 1 << 20)
    assert minis == {x.pos for x in seeding.minimizers(df, "read_id", 15, 20).collect()}


def test_circles_are_told_once(spark):
    r = random.Random(5)
    k = 11
    rings = []
    while len(rings) < 3:
        s = "".join(r.choices("ACGT", k=(60, 37, 500)[len(rings)]))
        if all(w != back(w) for i in range(len(s)) for w in [(s + s)[i : i + k - 1]]):  # else both strands meet there
            rings.append(s)
    solid = {min(w, back(w)) for s in rings for i in range(len(s)) for w in [(s + s)[i : i + k]]}
    line = "".join(r.choices("ACGT", k=80))
    solid |= {min(w, back(w)) for i in range(len(line) - k + 1) for w in [line[i : i + k]]}
    nodes, _ = dbg.unitigs(spark.createDataFrame([(w,) for w in sorted(solid)], "kmer string"), k)
    seqs = [x.seq for x in nodes.collect()]
    told = [min(w, back(w)) for s in seqs for i in range(len(s) - k + 1) for w in [s[i : i + k]]]
    assert sorted(told) == sorted(solid)
    assert sorted(len(s) - k + 1 for s in seqs) == sorted([60, 37, 500, len(line) - k + 1])
    for s in seqs[:]:
        if len(s) - k + 1 != len(line) - k + 1:
            words = [s[i : i + k] for i in range(len(s) - k + 1)]
            assert words[0] == min(words + [back(w) for w in words])
