"""Scans, sinks and streams on small files."""

import gzip
import json

import pytest

from seqgraph.operators import correction, dbg, haplotype
from seqgraph.operators.components import connected_components
from seqgraph.operators import graph
from seqgraph.operators.graph import assign_ids
from seqgraph.sinks import writers
from seqgraph.sources import gfa, reads, seeds
from seqgraph.streaming import intake


def test_fastq_and_sam(spark, tmp_path):
    (tmp_path / "a.fq").write_text("junk\n@r1 x\nACGT\n+\nIIII\r\n@r2\nGG\n+\n@@\n")
    with gzip.open(tmp_path / "b.FASTQ.gz", "wt") as f:
        f.write("@r3\nTT\n+\nII\n")
    (tmp_path / "c.sam").write_text("@HD\tx\n" + "\n".join("\t".join([n, str(flag), "*", "0", "0", "*", "*", "0", "0", s, "*"]) for n, flag, s in (("r4", 0, "AC"), ("r5", 256, "AC"), ("r6", 2048, "AC"), ("r7", 16, "GG"))))
    got = reads.read_reads(spark, *(str(tmp_path / n) for n in ("a.fq", "b.FASTQ.gz", "c.sam"))).collect()
    assert sorted((r.read_id, r.seq, r.qual) for r in got) == [("r1", "ACGT", "IIII"), ("r2", "GG", "@@"), ("r3", "TT", "II"), ("r4", "AC", None), ("r7", "GG", None)]
    with pytest.raises(ValueError):
        reads.read_reads(spark, "x.bam")


def test_graph_check_and_renumbering(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("S\tb\tACGT\nS\ta\tAC!\nS\tc\t*\nL\tb\t+\ta\t-\t2M\nL\ta\t-\tz\t+\t0M\nL\tb\t-\tb\t+\t9M\n\nL\ta\t+\ta\t+\tx\n")
    nodes, edges = gfa.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert {r.name: r.node_id for r in nodes.collect()} == {"b": 0, "a": 1, "c": 2}
    assert {(r.problem, r.name) for r in gfa.check(nodes, edges).collect()} == {("no sequence", "c"), ("illegal base", "a"), ("bad overlap", "1"), ("missing node", "3"), ("overlap too long", "b")}
    lines, names = writers.renumbered_gfa(nodes, edges.where("overlap = 2"))
    assert {r.value for r in lines.collect()} == {"S\t1\tACGT", "S\t2\tAC!", "S\t3\t*", "L\t1\t+\t2\t-\t2M"}
    assert {(r.node, r.name) for r in names.collect()} == {(1, "b"), (2, "a"), (3, "c")}


def test_vg_json_and_seeds(spark, tmp_path):
    parts = [{"node": [{"id": 1, "sequence": "ac"}, {"id": 2, "sequence": "G", "name": "x"}], "edge": [{"from": 1, "to": 2, "from_start": True}]}, {"node": [{"id": 1, "sequence": "ac"}]}]
    (tmp_path / "g.json").write_text("\n".join(map(json.dumps, parts)))
    nodes, edges = gfa.read_vg_json(spark, str(tmp_path / "g.json"))
    assert {(r.node_id, r.name, r.seq) for r in nodes.collect()} == {(1, "1", "AC"), (2, "x", "G")}
    assert [tuple(r) for r in edges.collect()] == [(1, False, 2, True, 0)]
    aln = {"name": "r1 tag", "query_position": 3, "path": {"mapping": [{"position": {"node_id": 2, "offset": 5, "is_reverse": True}, "edit": [{"from_length": 7}]}]}}
    (tmp_path / "s.json").write_text(json.dumps(aln))
    assert [tuple(r) for r in seeds.read_seeds_json(spark, str(tmp_path / "s.json")).collect()] == [("r1", 2, 5, 3, 7, True)]
    (tmp_path / "o.gaf").write_text("r1\t9\t2\t8\t+\t<x>1\t20\t4\t11\t6\t7\t60")
    assert [tuple(r) for r in seeds.read_gaf_seeds(spark, str(tmp_path / "o.gaf"), nodes).collect()] == [("r1", 2, 4, 2, 6, True)]
    index = spark.createDataFrame([(1, 2, 3)], "kmer long, onode_id long, off long")
    seeds.write_index(index, str(tmp_path / "index"), 15, 20)
    assert seeds.read_index(spark, str(tmp_path / "index"), 15, 20).collect() == index.collect()
    with pytest.raises(ValueError):
        seeds.read_index(spark, str(tmp_path / "index"), 17, 20)


def test_corrected_output(spark, tmp_path):
    r = spark.createDataFrame([("a", "AACCGGTT"), ("b", "ACGT")], "read_id string, seq string")
    c = spark.createDataFrame([("a", 2, 5, "cta"), ("a", 4, 7, "tag")], "read_id string, start int, end int, corrected string")
    fixed = correction.patched(r, c)
    assert {x.read_id: x.corrected for x in fixed.collect()} == {"a": "aaCTAGt", "b": "acgt"}
    writers.write_lines(writers.fasta_lines(fixed), str(tmp_path / "out"), compressed=True)
    assert sorted((x.read_id, x.seq) for x in reads.read_fasta(spark, str(tmp_path / "out")).collect()) == [("a", "aaCTAGt"), ("b", "acgt")]


def test_parts_join_by_the_bases_both_cover(spark):
    """A run of one base there makes the longest overlap longer than these."""
    r = spark.createDataFrame([("a", "CGAAAAAATG"), ("b", "CGTAAACTTG")], "read_id string, seq string")
    c = spark.createDataFrame([("a", 0, 6, "CGAAAA"), ("a", 4, 9, "AAAAT"), ("b", 0, 5, "CGTAA"), ("b", 4, 9, "GTAAC")], "read_id string, start int, end int, corrected string")
    assert {x.read_id: x.corrected for x in correction.patched(r, c).collect()} == {"a": "CGAAAAAATg", "b": "CGTAACg"}


def test_components_both_ways(spark):
    import random

    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500), (None, 3)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    want = {x: x for p in pairs if p[0] is not None for x in p}
    for a, b in pairs * 60:
        if a is not None:
            want[a] = want[b] = min(want[a], want[b])
    for local in (0, 1 << 19):
        assert {x.node: x.component for x in connected_components(df, local_edges=local).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_vote_clusters_anchor_at_their_first(spark):
    votes = [("r", 1, d) for d in (0, 50, 100, 101, 150, 160, 500)]
    got = haplotype.vote_clusters(spark.createDataFrame(votes, "read_id string, onode_id long, diag long")).collect()
    assert sorted((x.diag, x.n_votes) for x in got) == [(50, 3), (130, 3)]


def test_homologous_strings(spark):
    rows = [(n, p, k) for n, ks in ((0, "A x1 x2 B y C"), (2, "A z B w C")) for p, k in enumerate(ks.split())]
    found = haplotype.flanked(spark.createDataFrame(rows, "onode_id long, pos long, kmer string"))
    assert {(x.onode_id, x.k1, x.k2) for x in found.collect()} == {(0, "A", "B"), (2, "A", "B")}
    pairs = haplotype.homologous(found)
    assert [tuple(x) for x in pairs.collect()] == [("A", "B", 0, 2)]
    assert {tuple(x) for x in haplotype.conflicts(pairs).collect()} == {(0, 2), (2, 0)}


def test_unitigs_hold_each_kmer_once(spark):
    import random

    r = random.Random(2)
    k, text = 7, "".join(r.choices("ACGT", k=120))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    solid = {min(text[i : i + k], rc(text[i : i + k])) for i in range(len(text) - k + 1)}
    df = spark.createDataFrame([(x, 3) for x in solid], "kmer string, n int")
    nodes, edges = dbg.unitigs(df, k)
    got = [min(s[i : i + k], rc(s[i : i + k])) for s in (x.seq for x in nodes.collect()) for i in range(len(s) - k + 1)]
    assert sorted(got) == sorted(solid)
    assert all(x.overlap == k - 1 for x in edges.collect())


def test_streams_equal_the_batch(spark, tmp_path):
    rows = [(i, "ACGT" * (i % 5), 4 * (i % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, intake.READS)
    for part in range(5):
        df.where(f"read_id % 5 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: intake.read_stream(spark, str(tmp_path / "in"), 2)
    intake.kept_totals(stream(), "totals", str(tmp_path / "c1")).awaitTermination()
    assert tuple(spark.table("totals").first()) == (50, sum(r[2] for r in rows))
    intake.seeded(stream(), lambda b: b.where("len > 4").select("read_id"), str(tmp_path / "seeds"), str(tmp_path / "c2")).awaitTermination()
    assert {r.read_id for r in spark.read.parquet(str(tmp_path / "seeds")).collect()} == {r[0] for r in rows if r[2] > 4}
    intake.appended(stream(), str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_ids_follow_first_mention(spark):
    df = spark.createDataFrame([("b", 5), ("a", 9), ("b", 1), ("c", 3), (None, 0)], "name string, place long")
    assert {r.name: r.node_id for r in assign_ids(df, 1).collect()} == {"b": 1, "c": 2, "a": 3}


def test_fastq_of_many_blocks(spark, tmp_path):
    """One file in some twenty splits: records run over their edges."""
    path = tmp_path / "many.fq"
    path.write_text("comment\n" + "".join(f"@r{i} tag\n{'ACGT' * (i % 30 + 1)}\n+\n{'I' * 4 * (i % 30 + 1)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 10))
    try:
        got = reads.read_reads(spark, str(path))
        assert got.count() == 3000
        assert {(r.read_id, r.seq, len(r.qual)) for r in got.collect()} == {(f"r{i}", "ACGT" * (i % 30 + 1), 4 * (i % 30 + 1)) for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ids_by_first_mention_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_ROWS", 100)
    rows = [(f"n{i % 1500}", (i * 7919) % 100_003) for i in range(4000)]
    first = {}
    for name, place in rows:
        first[name] = min(place, first.get(name, place))
    want = {n: i for i, n in enumerate(sorted(first, key=lambda n: (first[n], n)))}
    got = {r.name: r.node_id for r in graph.assign_ids(spark.createDataFrame(rows, "name string, place long")).collect()}
    assert got == want


def test_text_streams_and_replayed_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.fq").write_text(f"some words\n@a{k} t\r\nACGT\r\n+\r\n@@II\r\n@b{k}\n\n+\n\n" + "@cut\nAC\n")
        (tmp_path / "in" / f"{k}.fasta").write_text(f">c{k} t\nAC\nGT \r\n\n>d{k}\nA\n")
    for suffix, want in ((".fq", {(f"a{k}", "ACGT", "@@II", 4) for k in range(3)} | {(f"b{k}", "", "", 0) for k in range(3)}), (".fasta", {(f"c{k}", "ACGT", None, 4) for k in range(3)} | {(f"d{k}", "A", None, 1) for k in range(3)})):
        for again in range(2):
            stream = intake.read_text_stream(spark, str(tmp_path / "in" / f"*{suffix}"), 2)
            intake.by_batch(stream, str(tmp_path / f"out{suffix}"), str(tmp_path / f"mark{suffix}{again}")).awaitTermination()
        back = spark.read.parquet(str(tmp_path / f"out{suffix}"))
        assert {tuple(r) for r in back.select("read_id", "seq", "qual", "len").collect()} == want and back.count() == len(want)
        assert back.select("batch").distinct().count() == 2
    with pytest.raises(ValueError, match="unknown kind"):
        intake.read_text_stream(spark, str(tmp_path / "*.bam"))


def test_a_large_fastq_file_is_many_tasks_in_a_stream(spark, tmp_path):
    want = {(f"r{i}", "ACGT"[: i % 5], "@@@@"[: i % 5], i % 5) for i in range(900)}
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.fq").write_text("words\n" + "".join(f"@{n} t\n{s}\n+\n{q}\n" for n, s, q, _ in sorted(want) if int(n[1:]) % 3 == k) + "@cut\nAC\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for again in range(2):
            intake.fastq_by_batch(spark, str(tmp_path / "in" / "*.fq"), str(tmp_path / "out"), str(tmp_path / f"mark{again}"), 2).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in back.select("read_id", "seq", "qual", "len").collect()} == want and back.count() == 900


def test_evidence_is_kept_by_k_and_graph(spark, tmp_path):
    from dataclasses import replace

    from seqgraph.params import AlignParams
    from seqgraph.plans import align

    import random

    r = random.Random(6)
    a = "".join(r.choices("ACGT", k=900))
    b = "".join(c if i % 97 else {"A": "C", "C": "G", "G": "T", "T": "A"}[c] for i, c in enumerate(a))
    onodes = spark.createDataFrame([(0, a, 900), (2, b, 900)], "onode_id long, seq string, len int")
    params = AlignParams(diploid_k=(11, 15), diploid_cache=str(tmp_path / "kept"))
    fresh = {k: (i.count(), c.count()) for k, i, c in align.kept_evidence(onodes, replace(params, diploid_cache=""))}
    made = {k: (i.count(), c.count()) for k, i, c in align.kept_evidence(onodes, params)}
    files = {f for f in (tmp_path / "kept").rglob("*.parquet")}
    again = {k: (i.count(), c.count()) for k, i, c in align.kept_evidence(onodes, params)}
    assert fresh == made == again and sum(n for n, _ in fresh.values())
    assert files == {f for f in (tmp_path / "kept").rglob("*.parquet")}
    with pytest.raises(ValueError, match="another graph"):
        align.kept_evidence(onodes.where("onode_id = 0"), params)
