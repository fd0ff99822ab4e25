"""The published example: a small bubble graph and one read."""

import pytest

from seqgraph.operators import correction, extension, graph
from seqgraph.params import AlignParams, preset
from seqgraph.plans import align
from seqgraph.sources.gfa import check, read_gfa
from seqgraph.sources.reads import read_reads

# The example's graph and read, and the result to match.
NODES = ["ACGTCATGCAGTCGTAACGTAGTCGTCACAGTCAGTCGTAGCTA", "A", "T", "GTAGCGTCAGTCAGTCAGTCGTAGCGTAACGTCGTAGTCAGT"]
LINKS = [(1, 2), (1, 3), (2, 4), (3, 4)]
READ = "TCATCCACGTCGTAACGTAGTCGTCACAGTCAGTCGTAGCTAAGTACGTCAAGTCAGACAGTCGTAGCGTA"


@pytest.fixture(scope="module")
def example(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("example")
    (d / "graph.gfa").write_text("H\tVN:Z:1.0\n" + "".join(f"S\t{i}\t{s}\n" for i, s in enumerate(NODES, 1)) + "".join(f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in LINKS))
    (d / "read.fa").write_text(f">read some tags\n{READ[:50]}\r\n{READ[50:]} \n")
    nodes, edges = read_gfa(spark, str(d / "graph.gfa"))
    return nodes, edges, read_reads(spark, str(d / "read.fa"))


def test_scans(example):
    nodes, edges, reads = example
    assert {(r.name, r.seq) for r in nodes.collect()} == {(str(i), s) for i, s in enumerate(NODES, 1)}
    assert edges.count() == 4 and check(nodes, edges).count() == 0
    assert [tuple(r) for r in reads.select("read_id", "seq", "len").collect()] == [("read", READ, 71)]


def test_published_result(example):
    nodes, edges, reads = example
    alns = align.align(reads, nodes, edges, preset("vg")).cache()
    (r,) = alns.collect()
    assert (r.read_start, r.read_end, r.path_text, r.path_len, r.path_start, r.path_end) == (0, 71, ">1>2>4", 87, 3, 73)
    assert (r.matches, r.block_len, r.mapq, r.edits, round(r.xscore, 6)) == (67, 72, 60, 5, 56.3)
    (line,) = [x.value for x in align.gaf(alns).collect()]
    fields = line.split("\t")
    assert fields[:12] == ["read", "71", "0", "71", "+", ">1>2>4", "87", "3", "73", "67", "72", "60"]
    assert fields[12:16] == ["NM:i:5", "AS:f:56.3", "dv:f:0.0694444", "id:f:0.930556"] and fields[16].startswith("cg:Z:4=1X2=1I")
    assert extension.violations(alns).count() == 0
    fixed = align.corrected_reads(reads, alns).first().corrected
    assert fixed == (NODES[0][3:] + "A" + NODES[3][:28]) and fixed.isupper()


@pytest.mark.parametrize("seeding", ["mem", "seedless"])
def test_other_seedings(example, seeding):
    nodes, edges, reads = example
    alns = align.align(reads, nodes, edges, AlignParams(seeding=seeding, mxm_length=12)).collect()
    best = max(alns, key=lambda r: r.xscore)
    assert best.xscore >= (56.0 if seeding == "mem" else 0)


def test_parameters_are_checked():
    with pytest.raises(ValueError, match="k < 32"):
        AlignParams(k=40, w=50).checked()
    with pytest.raises(ValueError):
        preset("vg", seeding="guess")


def matrix_best(query, nodes, edges, node, off, cost):
    """Best score of aligning a prefix of query from a place, by Dijkstra over (node, off, pos)."""
    import heapq

    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    heap, seen, best = [(0, node, off, 0)], set(), 0.0
    while heap:
        e, n, o, p = heapq.heappop(heap)
        if (n, o, p) in seen:
            continue
        seen.add((n, o, p))
        best = max(best, p - cost * e)
        if e >= 12:
            continue
        if o == len(nodes[n]):
            for m in out.get(n, []):
                heapq.heappush(heap, (e, m, 0, p))
            continue
        if p < len(query):
            heapq.heappush(heap, (e + (query[p] != nodes[n][o]), n, o + 1, p + 1))
            heapq.heappush(heap, (e + 1, n, o, p + 1))
        heapq.heappush(heap, (e + 1, n, o + 1, p))
    return best


def test_extension_equals_full_search(spark):
    import random

    r = random.Random(4)
    dna = lambda k: "".join(r.choices("ACGT", k=k))
    seqs = {2 * i: dna(r.randint(1, 12)) for i in range(7)}
    edges = [(2 * i, 2 * j) for i in range(7) for j in (i + 1, i + 2) if j < 7]
    onodes = spark.createDataFrame([(n, n // 2, False, str(n), s, len(s)) for n, s in seqs.items()], "onode_id long, node_id long, is_rev boolean, name string, seq string, len int")
    oedges = spark.createDataFrame([(a, b, 0) for a, b in edges], "src long, dst long, overlap int")
    starts, want = [], {}
    for k in range(12):
        walk, n = "", 0
        while n < 7:
            walk += seqs[2 * n]
            n += r.choice((1, 2))
        q = list(walk)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(q))
            q[i : i + 1] = r.choice(["", dna(1), dna(2)])
        starts.append((f"a{k}", 1, 0, 0, "".join(q)))
        want[f"a{k}"] = matrix_best("".join(q), seqs, edges, 0, 0, 2.94)
    df = spark.createDataFrame(starts, "aln_id string, side int, onode_id long, off long, query string")
    got = {x.aln_id: x.x for x in extension.extend(df, onodes, oedges, AlignParams(bandwidth=100)).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {k: round(v, 4) for k, v in want.items()}


def test_strands_mirror(example):
    nodes, edges, _ = example
    e = graph.orient_edges(edges).collect()
    assert {(r.src, r.dst) for r in e} == {(r.dst ^ 1, r.src ^ 1) for r in e}


def test_slide_goes_on_to_the_last_node(spark):
    n = 9
    onodes = spark.createDataFrame([(2 * i, "A", 1) for i in range(n)], "onode_id long, seq string, len int")
    oedges = spark.createDataFrame([(2 * i, 2 * i + 2, 0) for i in range(n - 1)], "src long, dst long, overlap int")
    queries = spark.createDataFrame([("a", 1, "A" * n)], "aln_id string, side int, query string")
    start = spark.createDataFrame([("a", 1, 0, 0, 0, 0, "", [0])], "aln_id string, side int, onode_id long, off long, rpos long, e int, ops string, path array<long>")
    assert extension.slide(start, queries, onodes, oedges, max_hops=3).agg({"rpos": "max"}).first()[0] == n


def test_whole_plan_is_registered():
    from seqgraph.plans import catalog

    assert {"x2_alignments", "r1_corrected_alignments"} <= set(catalog.QUERIES)


def test_a_wrong_first_base_needs_no_seed(example):
    nodes, edges, reads = example
    wrong = reads.selectExpr("read_id", "concat('G', substring(seq, 30)) as seq").selectExpr("*", "length(seq) as len")
    best = max(align.align(wrong, nodes, edges, AlignParams(seeding="seedless")).collect(), key=lambda r: r.xscore)
    assert best.read_start <= 1 and best.read_end == 43 and best.path_text == ">1>2>4"


def test_kmers_of_a_long_run_of_one_base(spark):
    from seqgraph.operators import seeding

    rows = [(1, "A" * 100_000), (2, "C" * 700 + "G" * 13 + "T" * 900), (3, "ACGT" * 9)]
    got = {}
    for r in seeding.read_kmers(spark.createDataFrame(rows, "read_id long, seq string"), 15, 20).collect():
        got.setdefault(r.read_id, set()).add(r.pos)
    want = {}
    for i, s in rows:
        n, last = 0, None
        for p in range(14, len(s)):
            k = s[p - 14 : p + 1]
            n = n + 1 if k == last else 0
            last = k
            if n % 6 == 0:
                want.setdefault(i, set()).add(p)
    assert got == want


def test_trimmed_equals_a_walk(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    lens, overlap = {0: 5, 2: 4, 4: 6, 6: 3}, {(0, 2): 0, (2, 4): 2, (4, 6): 1}
    places = [(0, o) for o in range(5)]
    for a, b in overlap:
        places += [(b, o) for o in range(overlap[a, b], lens[b])]
    rows, want = [], {}
    for k in range(40):
        ops = "".join(r.choices("=XID", k=r.randint(3, 14)))
        start = r.randrange(4)
        used = [c for c in ops if c != "I"]
        if start + len(used) > len(places) or not used:
            continue
        first = r.randrange(len(ops))
        last = r.randint(first + 1, len(ops))
        end = places[start + len(used) - 1]
        path = [0]
        for n, _ in places[: start + len(used)]:
            path += [n] if n != path[-1] else []
        rows.append((k, 1, 10, 10 + len(ops.replace("D", "")), len(ops.replace("=", "")), 0.0, ops, path, start, end[1] + 1, first, last))
        gone, kept = ops[:first], ops[first:last]
        g0, g1 = start + len(gone.replace("I", "")), len(kept.replace("I", ""))
        if g1:
            there = places[g0 : g0 + g1]
            r0 = 10 + len(gone.replace("D", ""))
            walk = list(dict.fromkeys(n for n, _ in there))
            want[k] = (r0, r0 + len(kept.replace("D", "")), len(kept.replace("=", "")), kept, walk, there[0][1], there[-1][1] + 1)
    alns = spark.createDataFrame(rows, "aln_id long, read_id long, read_start long, read_end long, edits int, xscore double, ops string, path array<long>, path_start long, path_end_off long, a int, b int")
    onodes = spark.createDataFrame(list(lens.items()), "onode_id long, len int")
    oedges = spark.createDataFrame([(a, b, o) for (a, b), o in overlap.items()], "src long, dst long, overlap int")
    got = {x.aln_id: (x.read_start, x.read_end, x.edits, x.ops, x.path, x.path_start, x.path_end_off) for x in extension.trimmed(alns, onodes, oedges, 0.66, F.col("a"), F.col("b")).collect()}
    assert got == want and len(want) > 20


def test_options_run_through_the_plan(example):
    nodes, edges, reads = example
    changes = [{"clip_ambiguous": 5.0}, {"hpc_reads": True, "min_score": 5.0}, {"diploid_k": (11,)}]
    for how in changes:
        alns = align.align(reads, nodes, edges, preset("vg", **how))
        assert extension.violations(alns).count() == 0


def test_steps_are_checked_by_runs(spark):
    """Equal bases must be known ones and share a base; a long run costs one step."""
    rows = [("ok", "ACRN", "acgT", "====", 0), ("bad", "ACGT", "ACGA", "====", 0), ("gap", "AC-T", "AC-T", "====", 0), ("short", "ACG", "ACG", "====", 0), ("edit", "ATCGG", "ACCGG", "=X===", 1), ("indel", "ATCG", "TCCG", "I==D=", 2), ("indel_bad", "ATCG", "TACG", "I=D=X", 3)]
    rows.append(("long", "ACGT" * 50_000, "ACGT" * 50_000, "=" * 200_000, 0))
    df = spark.createDataFrame(rows, "aln_id string, seq string, graph_seq string, ops string, edits int").selectExpr("*", "0 as read_start", "length(replace(ops, 'D', '')) as read_end")
    assert {r.aln_id for r in extension.violations(df).select("aln_id").collect()} == {"bad", "gap", "short"}


def test_corrected_segments_are_cut_within_a_row(spark):
    df = spark.createDataFrame([(1, "=I=DX", "ACGTTT"), (2, "II", "AC")], "aln_id int, ops string, graph_seq string")
    got = correction.corrected_segments(df)
    assert [tuple(r) for r in got.collect()] == [(1, "ACGT")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
