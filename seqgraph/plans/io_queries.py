"""Registered queries that write projections of the tables in a format, scan them back, stream them, and align."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved, shared_dir
from seqgraph.functions.sequences import trim_name
from seqgraph.operators import extension, graph, seeding
from seqgraph.params import AlignParams
from seqgraph.plans import align
from seqgraph.plans import fixtures as fx
from seqgraph.plans.align_queries import IGNORE, INDEX, K, READ_KMERS, WIN
from seqgraph.plans.fixtures import with_
from seqgraph.sinks import writers
from seqgraph.sources import gfa, reads, seeds
from seqgraph.streaming import intake

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def place(spark: SparkSession, suffix: str) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}{suffix}"


def written(lines: DataFrame, suffix: str) -> str:
    path = place(lines.sparkSession, suffix)
    writers.write_lines(lines, path)
    return path


READ_BACK = with_("reads") + "SELECT CAST(read_id AS VARCHAR) AS read_id, seq, len FROM reads"


@query(with_("nodes") + "SELECT CAST(node_id + 1 AS VARCHAR) AS name, seq FROM nodes")
def s1_read_gfa(spark, sf):
    lines, _ = writers.renumbered_gfa(fx.nodes(spark, sf), fx.edges(spark, sf))
    return gfa.read_gfa(spark, written(lines, ".gfa"))[0].select("name", "seq")


@query(with_("nodes") + "SELECT node_id, name, seq FROM nodes")
def s3_read_vg_json(spark, sf):
    node = F.array(F.struct(F.col("node_id").alias("id"), F.col("seq").alias("sequence"), "name"))
    return gfa.read_vg_json(spark, written(fx.nodes(spark, sf).select(F.to_json(F.struct(node.alias("node"))).alias("value")), ".json"))[0]


def fasta(spark, sf) -> str:
    return written(writers.fasta_lines(fx.reads(spark, sf), "read_id", "seq"), ".fa")


@query(READ_BACK)
def s4_read_fasta(spark, sf):
    return reads.read_fasta(spark, fasta(spark, sf)).select("read_id", "seq", "len")


@query(READ_BACK)
def s5_read_fastq(spark, sf):
    lines = fx.reads(spark, sf).select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit(" tag\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.col("len"))).alias("value"))
    return reads.read_fastq(spark, written(lines, ".fq")).select("read_id", "seq", "len")


def sam(spark, sf) -> str:
    rows = fx.reads(spark, sf).withColumn("flag", F.when(F.col("read_id") % 5 == 0, 256).otherwise(16))
    return written(rows.select(F.concat_ws("\t", "read_id", "flag", *[F.lit("*")] * 7, "seq", F.lit("*")).alias("value")), ".sam")


@query(READ_BACK + " WHERE read_id % 5 <> 0")
def s6_read_sam(spark, sf):
    return reads.read_sam(spark, sam(spark, sf)).select("read_id", "seq", "len")


@query(with_("reads") + "SELECT read_id, count(*) AS n, CAST(sum(len) AS BIGINT) AS bp FROM (SELECT CAST(read_id AS VARCHAR) AS read_id, len FROM reads UNION ALL SELECT CAST(read_id AS VARCHAR), len FROM reads WHERE read_id % 5 <> 0) GROUP BY read_id")
def s7_read_any(spark, sf):
    return reads.read_reads(spark, fasta(spark, sf), sam(spark, sf)).groupBy("read_id").agg(F.count("*").alias("n"), F.sum("len").alias("bp"))


@query(with_("alns") + "SELECT CAST(read_id AS VARCHAR) AS read_id, path AS node_id, CAST(edits AS BIGINT) AS off, CAST(read_start AS BIGINT) AS read_pos, CAST(read_end - read_start AS INT) AS match_len, aln_id % 2 = 0 AS is_rev FROM alns")
def s8_seeds_json(spark, sf):
    position = F.struct(F.col("path").alias("node_id"), F.col("edits").alias("offset"), (F.col("aln_id") % 2 == 0).alias("is_reverse"))
    mapping = F.array(F.struct(position.alias("position"), F.array(F.struct((F.col("read_end") - F.col("read_start")).alias("from_length"))).alias("edit")))
    rows = fx.alignments(spark, sf).select(F.to_json(F.struct(F.concat("read_id", F.lit(" x")).alias("name"), F.col("read_start").alias("query_position"), F.struct(mapping.alias("mapping")).alias("path"))).alias("value"))
    return seeds.read_seeds_json(spark, written(rows, ".json"))


@query(with_("alns", "nodes") + "SELECT CAST(read_id AS VARCHAR) AS read_id, path AS node_id, CAST(edits AS BIGINT) AS off, CAST(read_start AS BIGINT) AS read_pos, CAST(read_end - read_start AS INT) AS match_len, aln_id % 2 = 0 AS is_rev FROM alns WHERE path IN (SELECT node_id FROM nodes)")
def s9_gaf_seeds(spark, sf):
    step = F.concat(F.when(F.col("aln_id") % 2 == 0, "<").otherwise(">"), F.lit("n"), F.col("path"), F.lit(">n9"))
    rows = fx.alignments(spark, sf).select(F.concat_ws("\t", "read_id", F.lit(900), "read_start", "read_end", F.lit("+"), step, F.lit(999), "edits").alias("value"))
    return seeds.read_gaf_seeds(spark, written(rows, ".gaf"), fx.nodes(spark, sf))


@query(with_("onodes") + ", " + INDEX + " SELECT CAST(kmer AS BIGINT) AS kmer, onode_id, CAST(pos AS BIGINT) AS off FROM idx")
def s10_kept_index(spark, sf):
    path = place(spark, "-index")
    seeds.write_index(seeding.kmer_index(fx.oriented(spark, sf)[0], K, WIN), path, K, WIN)
    return seeds.read_index(spark, path, K, WIN)


@query(r"SELECT doc_id, regexp_extract(text, '^[^ \t\r\n]*') AS name FROM documents")
def s11_trim_name(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", trim_name("text").alias("name"))


def six(x: str) -> str:
    """Six digits without closing zeros, seven for numbers under 0.1."""
    return f"CASE WHEN abs({x}) < 0.1 THEN regexp_replace(printf('%.7f', {x}), '\\.?0+$', '') ELSE regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\\.$', '') END"


SPAN = "(read_end - read_start)"


@query(with_("alns") + f"""SELECT concat_ws(chr(9), read_id, 1500, read_start, read_end, '+', '>n' || path, 900, 0, {SPAN}, {SPAN} - edits, {SPAN}, 60, 'NM:i:' || edits,
  CASE WHEN xscore <> -1 THEN 'AS:f:' || regexp_replace(regexp_replace(printf('%.6f', xscore), '0+$', ''), '\\.$', '') END, 'dv:f:' || {six(f'(1 - ({SPAN} - edits) / {SPAN}::DOUBLE)')}, 'id:f:' || {six(f'(({SPAN} - edits) / {SPAN}::DOUBLE)')}, 'cg:Z:' || {SPAN} || 'M') AS value FROM alns""")
def k1_gaf_lines(spark, sf):
    a = fx.alignments(spark, sf).selectExpr("read_id", "1500 as read_len", "read_start", "read_end", "concat('>n', path) as path", "900 as path_len", "0 as path_start", "read_end - read_start as path_end", "read_end - read_start - edits as matches", "read_end - read_start as block_len", "60 as mapq", "edits", "xscore", "concat(read_end - read_start, 'M') as cigar")
    return writers.gaf_lines(a)


@query(with_("onodes") + "SELECT onode_id, name, is_rev, node_id AS out_id FROM onodes")
def k3_restored(spark, sf):
    onodes = fx.oriented(spark, sf)[0]
    return writers.restored(onodes.select("onode_id"), onodes)


@query(with_("reads") + "SELECT '>' || read_id || chr(10) || seq AS value FROM reads")
def k4_fasta_lines(spark, sf):
    return writers.fasta_lines(fx.reads(spark, sf), "read_id", "seq")


@query(with_("nodes", "edges") + "SELECT 'S' || chr(9) || (node_id + 1) || chr(9) || seq AS value FROM nodes UNION ALL SELECT 'L' || chr(9) || (from_id + 1) || chr(9) || '+' || chr(9) || (to_id + 1) || chr(9) || '+' || chr(9) || overlap || 'M' FROM edges")
def k7_renumbered_gfa(spark, sf):
    return writers.renumbered_gfa(fx.nodes(spark, sf), fx.edges(spark, sf))[0]


def arrived(spark, sf) -> str:
    path = place(spark, "-stream")
    fx.reads(spark, sf).repartition(10, F.col("read_id") % 10).write.parquet(path)
    return path


@query(with_("reads", "onodes") + ", " + READ_KMERS + ", " + INDEX + " SELECT read_id, onode_id, count(*) AS n FROM read_kmers r JOIN idx i ON i.kmer = r.kmer GROUP BY ALL")
def w2_stream_seeding(spark, sf):
    index, out = saved(seeding.kmer_index(fx.oriented(spark, sf)[0], K, WIN), "index"), place(spark, "-seeds")
    intake.seeded(intake.read_stream(spark, arrived(spark, sf), 4), lambda batch: seeding.lookup(seeding.read_kmers(batch, K, WIN), index), out, place(spark, "-mark")).awaitTermination()
    return spark.read.parquet(out).groupBy("read_id", "onode_id").agg(F.count("*").alias("n"))


@query(with_("reads") + "SELECT count(*) AS reads, CAST(sum(len) AS BIGINT) AS bp FROM reads")
def w3_stream_totals(spark, sf):
    name = "totals_" + uuid.uuid4().hex
    intake.kept_totals(intake.read_stream(spark, arrived(spark, sf), 4), name, place(spark, "-mark")).awaitTermination()
    return spark.table(name)


@query(with_("reads") + "SELECT read_id, seq, len FROM reads")
def w4_stream_sink(spark, sf):
    out = place(spark, "-out")
    intake.appended(intake.read_stream(spark, arrived(spark, sf), 4), out, place(spark, "-mark")).awaitTermination()
    return spark.read.parquet(out)


@query(with_("reads") + "SELECT 'r' || read_id AS read_id, seq, len FROM reads UNION ALL SELECT 'f' || read_id, seq, len FROM reads")
def w1_text_streams(spark, sf):
    """Reads written as FASTQ and FASTA files, taken in as streams of text a few files at a time."""
    rows = fx.reads(spark, sf).repartition(10, F.col("read_id") % 10)
    found = []
    for suffix, line in ((".fq", "concat('@r', read_id, ' tag\n', seq, '\n+\n', repeat('I', len))"), (".fa", "concat('>f', read_id, '\n', seq)")):
        path, out = place(spark, "-text"), place(spark, "-out")
        rows.selectExpr(f"{line} as value").write.text(path)
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)):
            if f.getPath().getName().startswith("part-"):
                fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{f.getPath().getName()}{suffix}"))
        if suffix == ".fq":
            intake.fastq_by_batch(spark, f"{path}/*{suffix}", out, place(spark, "-mark"), 4).awaitTermination()
        else:
            intake.by_batch(intake.read_text_stream(spark, f"{path}/*{suffix}", 4), out, place(spark, "-mark")).awaitTermination()
        found.append(spark.read.parquet(out).select("read_id", "seq", "len"))
    return found[0].union(found[1])


@query(with_("reads") + "SELECT read_id, seq, len FROM reads")
def w4_replayed_sink(spark, sf):
    """All batches written, then all played again from a lost checkpoint: nothing is there twice."""
    out, path = place(spark, "-out"), arrived(spark, sf)
    for _ in range(2):
        intake.by_batch(intake.read_stream(spark, path, 4), out, place(spark, "-mark")).awaitTermination()
    return spark.read.parquet(out).select("read_id", "seq", "len")


#: A short X-drop: reads are long and share only passages with the graph.
PARAMS = AlignParams(k=K, w=WIN, ignore_frequent=IGNORE, x_drop=600, bandwidth=5)


#: The whole plan goes on through longer poor stretches.
WHOLE = AlignParams(k=K, w=WIN, ignore_frequent=IGNORE, x_drop=1500, bandwidth=5, min_score=15.0)


def alignments(spark, sf) -> DataFrame:
    edges = fx.edges(spark, sf).withColumn("overlap", F.lit(0))
    return align.align(fx.reads(spark, sf), fx.nodes(spark, sf), edges, WHOLE)


@query()
def x2_alignments(spark, sf):
    """All selected alignments of each read, by the whole plan."""
    return alignments(spark, sf).select("read_id", "read_start", "read_end", "path_text", "path_len", "path_start", "path_end", "matches", "block_len", "edits", "xscore", "mapq", "cigar")


@query()
def r1_corrected_alignments(spark, sf):
    return extension.corrected(alignments(spark, sf))


@query()
def x2_extension(spark, sf):
    """Both sides of each read's best seed, merged, cleaned and described."""
    nodes, edges = fx.nodes(spark, sf), fx.edges(spark, sf).withColumn("overlap", F.lit(0))
    onodes, oedges = saved(graph.orient_nodes(nodes), "onodes"), saved(graph.orient_edges(edges), "oedges")
    found = seeding.seed_hits(fx.reads(spark, sf), onodes, K, WIN, PARAMS.density, IGNORE)
    order = W.partitionBy("read_id").orderBy(F.desc("goodness"), "read_pos", "onode_id", "off")
    best = found.withColumn("r", F.row_number().over(order)).where("r = 1")
    anchor = best.select(F.col("read_id").cast("string").alias("aln_id"), "read_id", "onode_id", (F.col("off") - K + 1).alias("off"), (F.col("read_pos") - K + 1).alias("read_pos"), "match_len")
    anchor = saved(anchor.join(onodes.select("onode_id", F.col("len").alias("onode_len")), "onode_id").join(fx.reads(spark, sf).select("read_id", "seq"), "read_id"), "anchors")
    sides = extension.extend(extension.anchor_starts(anchor), onodes, oedges, PARAMS)
    alns = extension.cancelled(extension.merged(sides, anchor, onodes, PARAMS.identity), PARAMS.identity)
    told = extension.described(alns, fx.reads(spark, sf), onodes, oedges)
    return told.select("read_id", "read_start", "read_end", "path_text", "path_len", "path_start", "path_end", "matches", "block_len", "edits", "xscore")
