"""Registered queries on seeding, clustering, selection, haplotypes and correction, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.functions.sequences import karlin_altschul
from seqgraph.operators import clustering, correction, dbg, haplotype, intervals, seeding, selection, stats
from seqgraph.plans import fixtures as fx
from seqgraph.plans.fixtures import with_
from seqgraph.sinks import writers

QUERIES: dict = {}
SQL: dict = {}
K, WIN, DENSITY, IGNORE = 15, 20, 10.0, 0.001


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def code(x: str) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, [strpos('ACGT', c) - 1 for c in string_split({x}, '')]), lambda a, b: a * 4 + b)"


MASK = "18446744073709551615"


def mixed(x: str) -> str:
    """The 64-bit mix in 128-bit arithmetic, step by step in nested queries over column x."""
    m = lambda e: f"(({e}) & {MASK}::HUGEINT)"
    steps = [m(f"({MASK}::HUGEINT - x) + x * 2097152"), "xor(x, x >> 24)", m("x + x * 8 + x * 256"), "xor(x, x >> 14)", m("x + x * 4 + x * 16"), "xor(x, x >> 28)", m("x + x * 2147483648::HUGEINT")]
    for s in steps:
        x = f"(SELECT * REPLACE ({s} AS x) FROM {x})"
    return x


def kmer_cte(name: str, source: str, key: str, k: int) -> str:
    return f"{name} AS (SELECT {key}, i + {k - 1} AS pos, {code(f'substr(seq, CAST(i + 1 AS INT), {k})')} AS kmer FROM (SELECT {key}, seq, unnest(range(0, length(seq) - {k - 1})) AS i FROM {source} WHERE length(seq) >= {k}))"


def minimizer_cte(name: str, source: str, key: str, k: int = K, w: int = WIN) -> str:
    n = w - k + 1
    return f"""{kmer_cte(name + '_k', source, key, k)},
{name}_h AS (SELECT {key}, pos, kmer, x AS h FROM {mixed(f'(SELECT *, kmer::HUGEINT AS x FROM {name}_k)')}),
{name}_w AS (SELECT *, min(h) OVER v AS low, count(*) OVER v AS c FROM {name}_h WINDOW v AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
{name} AS (SELECT {key}, pos, kmer FROM (SELECT *, max(CASE WHEN c = {n} THEN low END) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS top FROM {name}_w) WHERE top = h)"""


READ_KMERS = kmer_cte("rk_k", "reads", "read_id", K) + f""",
rk_r AS (SELECT *, kmer <> coalesce(lag(kmer) OVER (PARTITION BY read_id ORDER BY pos), -1) AS fresh FROM rk_k),
rk_g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY read_id ORDER BY pos) AS run FROM rk_r),
read_kmers AS (SELECT read_id, pos, kmer FROM (SELECT *, row_number() OVER (PARTITION BY read_id, run ORDER BY pos) - 1 AS i FROM rk_g) WHERE i % {WIN - K + 1} = 0)"""
INDEX = minimizer_cte("idx", "onodes", "onode_id")
CUT = f"""cnt AS (SELECT kmer, count(*) AS freq FROM idx GROUP BY kmer),
cut AS (SELECT list_extract(list_sort(list(freq)), CAST(floor(count(*) * (1 - {IGNORE})) AS BIGINT) + 1) AS cutoff FROM cnt),
kept AS (SELECT i.kmer, i.onode_id, i.pos AS off, freq FROM idx i JOIN cnt c ON c.kmer = i.kmer, cut WHERE cutoff IS NULL OR freq <= cutoff)"""
BUDGET = f"""known AS (SELECT r.*, f.freq FROM read_kmers r JOIN (SELECT kmer, count(*) AS freq FROM kept GROUP BY kmer) f ON f.kmer = r.kmer),
rar AS (SELECT *, coalesce(sum(freq) OVER (PARTITION BY read_id ORDER BY freq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rarer FROM known),
budget AS (SELECT rar.read_id, pos, kmer, freq FROM rar JOIN reads ON reads.read_id = rar.read_id WHERE rarer < floor(len * {DENSITY}))"""
HITS = f"""hits AS (SELECT b.read_id, k.onode_id, k.off, b.pos AS read_pos, {K} AS match_len, max(b.freq) OVER (PARTITION BY b.read_id) - b.freq AS goodness FROM budget b JOIN kept k ON k.kmer = b.kmer)"""
SEEDED = with_("reads", "onodes") + ",\n" + ",\n".join((READ_KMERS, INDEX, CUT, BUDGET, HITS)) + "\n"


def index(spark, sf) -> DataFrame:
    return seeding.kmer_index(fx.oriented(spark, sf)[0], K, WIN)


def hits(spark, sf) -> DataFrame:
    return seeding.seed_hits(fx.reads(spark, sf), fx.oriented(spark, sf)[0], K, WIN, DENSITY, IGNORE)


@query(with_("reads") + ", " + kmer_cte("k", "reads", "read_id", K) + "SELECT read_id, count(*) AS n, CAST(min(kmer) AS BIGINT) AS low, CAST(max(kmer) AS BIGINT) AS high FROM k GROUP BY read_id")
def f6_kmer_codes(spark, sf):
    runs = seeding.acgt_runs(fx.reads(spark, sf).select("read_id", "seq"))
    blocks = seeding._blocks(runs, K, 0, K - 1).withColumn("codes", seeding._codes(K))
    return blocks.select("read_id", F.explode_outer("codes").alias("kmer")).groupBy("read_id").agg(F.count("kmer").alias("n"), F.min("kmer").alias("low"), F.max("kmer").alias("high"))


@query("SELECT k, CAST(x - CASE WHEN x > 9223372036854775807 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) AS h FROM " + mixed("(SELECT l_orderkey * 1048583 + l_partkey AS k, (l_orderkey * 1048583 + l_partkey)::HUGEINT AS x FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))"))
def f7_mix_hash(spark, sf):
    keys = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().select((F.col("l_orderkey") * 1048583 + F.col("l_partkey")).alias("k"))
    return keys.select("k", F.transform(seeding._hashed(F.array("k")), lambda x: x.bitwiseXOR(F.lit(-(2**63))))[0].alias("h"))


PAGE_RUNS = "translate(regexp_replace(lower(html), '[^a-z]', 'N', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


@query(f"""WITH b AS (SELECT page_id, i - 1 AS i, substr(seq, CAST(i AS INT), 1) AS x FROM (SELECT page_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM (SELECT page_id, {PAGE_RUNS} AS seq FROM pages))),
g AS (SELECT *, i - row_number() OVER (PARTITION BY page_id ORDER BY i) AS run FROM b WHERE x <> 'N')
SELECT page_id, CAST(min(i) AS INT) AS run_off, string_agg(x, '' ORDER BY i) AS run FROM g GROUP BY page_id, g.run""")
def f5_acgt_runs(spark, sf):
    html = F.translate(F.regexp_replace(F.lower("html"), "[^a-z]", "N"), fx.LETTERS, fx.BASES)
    return seeding.acgt_runs(fx.table(spark, sf, "pages").select("page_id", html.alias("seq")))


@query(with_("reads") + ", " + READ_KMERS + " SELECT read_id, CAST(pos AS BIGINT) AS pos, CAST(kmer AS BIGINT) AS kmer FROM read_kmers")
def d1_read_kmers(spark, sf):
    return seeding.read_kmers(fx.reads(spark, sf), K, WIN)


@query(with_("reads") + ", " + minimizer_cte("m", "reads", "read_id") + " SELECT read_id, CAST(pos AS BIGINT) AS pos, CAST(kmer AS BIGINT) AS kmer FROM m")
def d2_minimizers(spark, sf):
    return seeding.minimizers(fx.reads(spark, sf), "read_id", K, WIN)


@query(with_("onodes") + ", " + INDEX + " SELECT CAST(kmer AS BIGINT) AS kmer, onode_id, CAST(pos AS BIGINT) AS off FROM idx")
def d3_kmer_index(spark, sf):
    return index(spark, sf)


@query(with_("onodes", "oedges") + ", " + INDEX + " SELECT CAST(kmer AS BIGINT) AS kmer, onode_id, CAST(pos AS BIGINT) AS off FROM idx LEFT JOIN (SELECT dst, max(overlap) AS o FROM oedges GROUP BY dst) ON dst = onode_id WHERE o IS NULL OR pos >= o")
def d4_skip_shared(spark, sf):
    onodes, oedges = fx.oriented(spark, sf)
    return seeding.skip_shared(seeding.kmer_index(onodes, K, WIN), oedges)


@query(with_("onodes") + ", " + INDEX + ", " + CUT + " SELECT CAST(kmer AS BIGINT) AS kmer, onode_id, CAST(off AS BIGINT) AS off, freq FROM kept")
def d5_without_frequent(spark, sf):
    return seeding.without_frequent(index(spark, sf), IGNORE)


@query(with_("reads", "onodes") + ", " + READ_KMERS + ", " + INDEX + " SELECT CAST(r.kmer AS BIGINT) AS kmer, r.read_id, CAST(r.pos AS BIGINT) AS pos, i.onode_id, CAST(i.pos AS BIGINT) AS off FROM read_kmers r JOIN idx i ON i.kmer = r.kmer")
def d6_lookup(spark, sf):
    return seeding.lookup(seeding.read_kmers(fx.reads(spark, sf), K, WIN), index(spark, sf)).select("kmer", "read_id", "pos", "onode_id", "off")


@query(with_("reads", "onodes") + ",\n" + ",\n".join((READ_KMERS, INDEX, CUT, BUDGET)) + " SELECT read_id, CAST(pos AS BIGINT) AS pos, CAST(kmer AS BIGINT) AS kmer, freq FROM budget")
def d7_budget(spark, sf):
    r = fx.reads(spark, sf)
    kept = seeding.without_frequent(index(spark, sf), IGNORE).drop("freq")
    return seeding.within_budget(r, seeding.read_kmers(r, K, WIN), kept, DENSITY).select("read_id", "pos", "kmer", "freq")


@query(SEEDED + "SELECT read_id, onode_id, CAST(off AS BIGINT) AS off, CAST(read_pos AS BIGINT) AS read_pos, match_len, goodness FROM hits")
def d8_seed_hits(spark, sf):
    return hits(spark, sf)


@query(with_("onodes") + ", " + INDEX + " SELECT count(*) > 0 AS usable, count(DISTINCT kmer) AS kmers, count(*) AS places FROM idx")
def d9_usable(spark, sf):
    return index(spark, sf).agg((F.count("*") > 0).alias("usable"), F.count_distinct("kmer").alias("kmers"), F.count("*").alias("places"))


L = 20
MEMS = with_("reads", "onodes") + f""", rl AS (SELECT read_id, i AS p, substr(seq, CAST(i + 1 AS INT), {L}) AS l FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {L - 1})) AS i FROM reads WHERE length(seq) >= {L})),
ol AS (SELECT onode_id, i AS p, substr(seq, CAST(i + 1 AS INT), {L}) AS l FROM (SELECT onode_id, seq, unnest(range(0, length(seq) - {L - 1})) AS i FROM onodes WHERE length(seq) >= {L})),
j AS (SELECT read_id, onode_id, rl.p AS rp, ol.p AS op FROM rl JOIN ol ON rl.l = ol.l),
g AS (SELECT *, op - row_number() OVER (PARTITION BY read_id, onode_id, rp - op ORDER BY op) AS run FROM j),
mems AS (SELECT read_id, onode_id, min(rp) AS read_pos, min(op) AS off, count(*) + {L - 1} AS match_len FROM g GROUP BY read_id, onode_id, rp - op, run)
"""
MEM_COLS = "read_id, onode_id, CAST(read_pos AS INT) AS read_pos, CAST(off AS INT) AS off, match_len"


def mems(spark, sf):
    return seeding.mems(fx.reads(spark, sf), fx.oriented(spark, sf)[0], L)


@query(MEMS + f"SELECT {MEM_COLS} FROM mems")
def d10_mems(spark, sf):
    return mems(spark, sf)


@query(MEMS + f""", t AS (SELECT m.*, substr(seq, CAST(read_pos + 1 AS INT), CAST(match_len AS INT)) AS text FROM mems m JOIN reads r ON r.read_id = m.read_id),
g2 AS (SELECT text, count(*) AS places FROM (SELECT DISTINCT onode_id, off, text FROM t) GROUP BY text)
SELECT {MEM_COLS} FROM (SELECT t.*, count(*) OVER (PARTITION BY read_id, t.text) AS inr, places FROM t JOIN g2 ON g2.text = t.text) WHERE inr = 1 AND places = 1""")
def d11_mums(spark, sf):
    return seeding.mums(mems(spark, sf), fx.reads(spark, sf)).select("read_id", "onode_id", "read_pos", "off", "match_len")


@query(MEMS + f"SELECT {MEM_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY match_len DESC, read_pos, onode_id, off) AS r FROM mems) WHERE r <= 3")
def d12_longest(spark, sf):
    return seeding.longest(mems(spark, sf), 3)


@query(MEMS + "SELECT read_id, xor(m.onode_id, 1) AS onode_id, CAST(read_pos AS INT) AS read_pos, o.len - off - match_len AS off, match_len FROM mems m JOIN onodes o ON o.onode_id = m.onode_id")
def d13_flip_match(spark, sf):
    return seeding.flip_match(mems(spark, sf), fx.oriented(spark, sf)[0]).select("read_id", "onode_id", "read_pos", "off", "match_len")


@query(with_("reads") + ", seeds AS (SELECT l_orderkey AS read_id, l_partkey AS node_id, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL) SELECT * FROM seeds WHERE read_id IN (SELECT read_id FROM reads)")
def d14_external_seeds(spark, sf):
    seeds = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("node_id")).agg(F.count("*").alias("n"))
    return seeding.external_seeds(fx.reads(spark, sf), seeds)


@query(with_("onodes") + ", " + kmer_cte("s", "onodes", "onode_id", 5) + ", sh AS (SELECT onode_id, pos - 4 AS p, x AS h FROM " + mixed("(SELECT *, kmer::HUGEINT AS x FROM s)") + """),
sw AS (SELECT onode_id, p - 16 AS start, list(h) OVER v AS hs, count(*) OVER v AS c FROM sh WINDOW v AS (PARTITION BY onode_id ORDER BY p ROWS BETWEEN 16 PRECEDING AND CURRENT ROW))
SELECT w.onode_id, CAST(start AS BIGINT) AS pos, substr(seq, CAST(start + 1 AS INT), 21) AS kmer FROM sw w JOIN onodes o ON o.onode_id = w.onode_id WHERE c = 17 AND list_position(hs, list_min(hs)) IN (1, 17)""")
def d15_syncmers(spark, sf):
    return seeding.syncmers(fx.oriented(spark, sf)[0], "onode_id", 21, 5)


CHAINS = """chains AS (SELECT onode_id, 0 AS chain, coalesce(sum(len) OVER (ORDER BY onode_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain_pos FROM onodes WHERE NOT is_rev
UNION ALL SELECT onode_id, 1, coalesce(sum(len) OVER (ORDER BY onode_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) FROM onodes WHERE is_rev)"""
SESSIONS = SEEDED + f""", {CHAINS}, dg AS (SELECT h.*, chain, chain_pos + off - read_pos AS diag FROM hits h JOIN chains c ON c.onode_id = h.onode_id),
gp AS (SELECT *, CASE WHEN diag - lag(diag) OVER v > 100 THEN 1 ELSE 0 END AS opens FROM dg WINDOW v AS (PARTITION BY read_id, chain ORDER BY diag, read_pos, onode_id, off)),
ses AS (SELECT *, sum(opens) OVER (PARTITION BY read_id, chain ORDER BY diag, read_pos, onode_id, off ROWS UNBOUNDED PRECEDING) AS session FROM gp),
cov AS (SELECT *, max(read_pos) OVER (PARTITION BY read_id, chain, session ORDER BY read_pos, match_len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef, read_pos - match_len + 1 AS beg FROM ses),
good AS (SELECT read_id, chain, session, sum(greatest(read_pos - greatest(beg, coalesce(bef, beg)), 0)) AS goodness, min(diag) AS diag, count(*) AS n_hits FROM cov GROUP BY ALL)
"""


def chain_table(spark, sf):
    onodes = fx.oriented(spark, sf)[0]
    # the fixture's graph is a line of few nodes: a chain for each strand, laid out by id
    order = W.partitionBy("is_rev").orderBy(F.when(F.col("is_rev"), -F.col("onode_id")).otherwise(F.col("onode_id"))).rowsBetween(W.unboundedPreceding, -1)
    return onodes.select("onode_id", F.col("is_rev").cast("int").alias("chain"), F.coalesce(F.sum("len").over(order), F.lit(0)).alias("chain_pos"))


def sessions(spark, sf):
    return clustering.sessions(clustering.diagonals(hits(spark, sf), chain_table(spark, sf)))


@query(SESSIONS + "SELECT read_id, onode_id, chain, CAST(diag AS BIGINT) AS diag, CAST(session AS BIGINT) AS session, count(*) AS n FROM ses GROUP BY ALL")
def c2_sessions(spark, sf):
    return sessions(spark, sf).groupBy("read_id", "onode_id", "chain", "diag", "session").agg(F.count("*").alias("n"))


@query(SESSIONS + "SELECT read_id, chain, CAST(session AS BIGINT) AS session, n_hits AS n FROM good WHERE n_hits >= 3")
def c3_large_enough(spark, sf):
    return clustering.large_enough(sessions(spark, sf), 3).groupBy("read_id", "chain", "session").agg(F.count("*").alias("n"))


@query(SESSIONS + "SELECT read_id, chain, CAST(session AS BIGINT) AS session, CAST(goodness AS BIGINT) AS goodness, CAST(diag AS BIGINT) AS diag, n_hits FROM good")
def c4_goodness(spark, sf):
    return clustering.goodness(sessions(spark, sf))


@query(SESSIONS + "SELECT DISTINCT read_id, chain, CAST(session AS BIGINT) AS session, CAST(floor(read_pos / 64) * 64 AS BIGINT) AS slice, onode_id, CAST(off // 64 AS BIGINT) AS seg_off FROM ses")
def c5_slices(spark, sf):
    return clustering.slices(sessions(spark, sf).withColumn("seg_off", F.expr("off div 64")))


RANKED = SESSIONS + ", rk AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY goodness DESC, chain, diag, session) AS rank FROM good) "


@query(RANKED + "SELECT read_id, chain, CAST(session AS BIGINT) AS session, CAST(rank AS INT) AS rank FROM rk")
def c6_ranked(spark, sf):
    return clustering.ranked(clustering.goodness(sessions(spark, sf)), 5).select("read_id", "chain", "session", "rank")


@query(RANKED + "SELECT read_id, CAST(least(rank, 5) AS INT) AS cluster, CAST(CASE WHEN count(*) = 1 THEN max(goodness) ELSE 0 END AS BIGINT) AS goodness, CAST(sum(n_hits) AS BIGINT) AS n_hits FROM rk GROUP BY ALL")
def c7_folded(spark, sf):
    return clustering.folded(clustering.goodness(sessions(spark, sf)), 5)


@query(with_("pairs") + "SELECT read_id, aln_id, CAST(count(*) AS BIGINT) AS n, max(other_score) AS best FROM pairs GROUP BY ALL")
def a1_incompatible(spark, sf):
    return selection.incompatible_pairs(fx.alignments(spark, sf)).groupBy("read_id", "aln_id").agg(F.count("*").alias("n"), F.max("other_score").alias("best"))


ALN = "read_id, aln_id, read_start, read_end, edits, path, xscore"


@query(with_("alns") + f"SELECT {ALN} FROM alns WHERE xscore >= 250")
def a2_min_score(spark, sf):
    return selection.min_score(fx.alignments(spark, sf), 250.0)


@query(with_("alns") + "SELECT read_id, aln_id FROM alns WHERE ln({k!r}::DOUBLE * 1e6::DOUBLE * 1500.0::DOUBLE) - {l!r}::DOUBLE * ((read_end - read_start) + edits * {m!r}::DOUBLE) <= ln(1e-30::DOUBLE)".format(k=karlin_altschul()[1], l=karlin_altschul()[0], m=-0.66 / 0.34 - 1))
def a3_e_value(spark, sf):
    return selection.max_e_value(fx.alignments(spark, sf).withColumn("len", F.lit(1500)), 1_000_000, 1e-30).select("read_id", "aln_id")


@query(with_("pairs") + f"SELECT {ALN} FROM alns a WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.read_id = a.read_id AND p.aln_id = a.aln_id AND p.xscore < p.other_score * 0.9)")
def a4_multimap(spark, sf):
    return selection.multimap(fx.alignments(spark, sf))


@query(with_("alns") + f"SELECT {ALN} FROM (SELECT *, row_number() OVER (PARTITION BY read_id, read_start // 50, read_end // 100, path ORDER BY xscore DESC, aln_id) AS r FROM alns) WHERE r = 1")
def a5_deduplicated(spark, sf):
    rows = fx.alignments(spark, sf).withColumns({"s": F.col("read_start"), "e": F.col("read_end"), "read_start": F.expr("read_start div 50"), "read_end": F.expr("read_end div 100")})
    return selection.deduplicated(rows, "path").select("read_id", "aln_id", F.col("s").alias("read_start"), F.col("e").alias("read_end"), "edits", "path", "xscore")


MAPQ = with_("pairs") + """, o AS (SELECT read_id, aln_id, max(other_score - xscore) AS lead, sum(pow(10.0::DOUBLE, least(other_score - xscore, 1.0))) AS s FROM pairs GROUP BY ALL),
q AS (SELECT a.*, CAST(CASE WHEN s IS NULL OR s <= 1e-6 THEN 60 WHEN lead >= 1 OR s >= 10 THEN 0 ELSE least(floor(10 * ln((1 + s) / s)), 60) END AS INT) AS mapq FROM alns a LEFT JOIN o ON o.read_id = a.read_id AND o.aln_id = a.aln_id)
"""


@query(MAPQ + f"SELECT {ALN}, mapq FROM q")
def a6_mapping_quality(spark, sf):
    return selection.mapping_quality(fx.alignments(spark, sf))


@query(MAPQ + f"""SELECT {ALN}, mapq, CAST(row_number() OVER (PARTITION BY read_id ORDER BY xscore DESC, read_start, aln_id) AS INT) AS rank FROM q a
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.read_id = a.read_id AND p.aln_id = a.aln_id AND p.xscore < p.other_score * 0.9 AND p.other_score >= 200) AND xscore >= 200""")
def a7_select(spark, sf):
    from seqgraph.params import AlignParams

    return selection.select(fx.alignments(spark, sf), AlignParams(min_score=200.0).checked())


@query(with_("alns") + "SELECT read_id, aln_id, CAST(row_number() OVER (PARTITION BY read_id ORDER BY xscore DESC, read_start, aln_id) AS INT) AS rank FROM alns")
def a8_rank(spark, sf):
    return selection.ranked(fx.alignments(spark, sf)).select("read_id", "aln_id", "rank")


COVERED = """cv AS (SELECT read_id, CAST(sum(greatest(read_end - greatest(read_start, coalesce(bef, read_start)), 0)) AS BIGINT) AS aligned_bp FROM (SELECT *, max(read_end) OVER (PARTITION BY read_id ORDER BY read_start, read_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM alns) GROUP BY read_id)"""


@query(with_("alns") + ", " + COVERED + """, rd AS (SELECT o_orderkey AS read_id, 700 + o_orderkey % 900 AS len FROM orders), sd AS (SELECT l_orderkey AS read_id, count(*) AS n FROM lineitem WHERE l_linenumber < 3 GROUP BY 1),
al AS (SELECT a.read_id, count(*) AS n, sum(read_end - read_start) AS bp, sum(CASE WHEN read_start = 0 AND read_end = len THEN 1 ELSE 0 END) AS f, sum(CASE WHEN read_start = 0 AND read_end = len THEN len ELSE 0 END) AS fb FROM alns a JOIN rd ON rd.read_id = a.read_id GROUP BY a.read_id)
SELECT count(*) AS reads, CAST(sum(len) AS BIGINT) AS bp_reads, CAST(coalesce(sum(sd.n), 0) AS BIGINT) AS seeds, CAST(count(sd.n) AS BIGINT) AS reads_with_seed, CAST(count(al.n) AS BIGINT) AS reads_with_alignment, CAST(coalesce(sum(al.n), 0) AS BIGINT) AS alignments, CAST(coalesce(sum(bp), 0) AS BIGINT) AS bp_alignments,
CAST(coalesce(sum(f), 0) AS BIGINT) AS end_to_end, CAST(coalesce(sum(fb), 0) AS BIGINT) AS bp_end_to_end, CAST(coalesce(sum(aligned_bp), 0) AS BIGINT) AS bp_reads_aligned FROM rd LEFT JOIN sd ON sd.read_id = rd.read_id LEFT JOIN al ON al.read_id = rd.read_id LEFT JOIN cv ON cv.read_id = rd.read_id""")
def t1_summary(spark, sf):
    rd = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), (700 + F.col("o_orderkey") % 900).alias("len"))
    seeds = fx.table(spark, sf, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("read_id"))
    return stats.summary(rd, seeds, fx.alignments(spark, sf))


@query(with_("alns") + ", " + COVERED + " SELECT * FROM cv")
def t2_aligned_bases(spark, sf):
    return stats.aligned_bases(fx.alignments(spark, sf))


SHORT = f"sr AS (SELECT conv_id * 100 + turn AS read_id, {fx.SQL_DNA.format('text')} AS seq FROM conversations)"


def short_reads(spark, sf):
    return fx.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("read_id"), fx.dna("text").alias("seq"))


@query(f"WITH {SHORT}, k AS (SELECT substr(seq, CAST(i AS INT), 21) AS k FROM (SELECT seq, unnest(range(1, length(seq) - 19)) AS i FROM sr WHERE length(seq) >= 21)) SELECT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 3")
def t3_spectrum(spark, sf):
    return dbg.spectrum(short_reads(spark, sf), 21, 3)


@query()
def t4_unitigs(spark, sf):
    return dbg.unitigs(dbg.spectrum(short_reads(spark, sf), 21, 3), 21)[0]


@query(with_("alns") + """, o AS (SELECT *, CASE WHEN read_start <= max(read_end) OVER (PARTITION BY read_id ORDER BY read_start, read_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS op FROM alns),
r AS (SELECT *, sum(op) OVER (PARTITION BY read_id ORDER BY read_start, read_end ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT read_id, min(read_start) AS read_start, max(read_end) AS read_end FROM r GROUP BY read_id, run""")
def h10_merged_spans(spark, sf):
    return intervals.merged(fx.alignments(spark, sf), ["read_id"], "read_start", "read_end")


HK = with_("onodes") + ", hn AS (SELECT onode_id, seq FROM onodes), " + kmer_cte("hk", "hn", "onode_id", 11) + ", tm AS (SELECT kmer, CAST(least(count(*), 3) AS INT) AS times FROM hk GROUP BY kmer)"


def node_kmers(spark, sf):
    nodes = fx.oriented(spark, sf)[0]
    return seeding.read_kmers(nodes.select(F.col("onode_id").alias("read_id"), "seq"), 11, 11).select(F.col("read_id").alias("onode_id"), "pos", "kmer")


@query(HK + " SELECT CAST(kmer AS BIGINT) AS kmer, times FROM tm")
def h1_multiplicity(spark, sf):
    return haplotype.multiplicity(node_kmers(spark, sf))


@query(HK + " SELECT CAST(hk.kmer AS BIGINT) AS kmer, array_to_string(list_sort(list(onode_id)), ',') AS onodes FROM hk JOIN tm ON tm.kmer = hk.kmer AND times <= 2 GROUP BY hk.kmer")
def h2_locations(spark, sf):
    k = node_kmers(spark, sf)
    return haplotype.locations(k, haplotype.multiplicity(k)).select("kmer", F.array_join(F.transform("onodes", lambda x: x.cast("string")), ",").alias("onodes"))


VOTES = SEEDED + ", vt AS (SELECT read_id, onode_id, CAST(read_pos - off AS BIGINT) AS diag FROM hits)"


def votes(spark, sf):
    kept = index(spark, sf).select("kmer", "onode_id", F.col("off").alias("pos"))
    return haplotype.votes(seeding.read_kmers(fx.reads(spark, sf), K, WIN), kept)


@query(with_("reads", "onodes") + ", " + READ_KMERS + ", " + INDEX + " SELECT r.read_id, i.onode_id, CAST(r.pos - i.pos AS BIGINT) AS diag, count(*) AS n FROM read_kmers r JOIN idx i ON i.kmer = r.kmer GROUP BY ALL")
def h7_votes(spark, sf):
    return votes(spark, sf).groupBy("read_id", "onode_id", "diag").agg(F.count("*").alias("n"))


SOLID = with_("alns") + ", sp AS (SELECT read_id, path AS onode_id, read_start AS start, read_end AS \"end\" FROM alns), cf AS (SELECT i AS onode_id, xor(i, 1) AS other FROM range(0, 4) t(i)), rv AS (SELECT DISTINCT read_id, other AS onode_id, start, \"end\" FROM sp JOIN cf ON cf.onode_id = sp.onode_id), fb AS (SELECT * FROM rv WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.read_id = rv.read_id AND sp.onode_id = rv.onode_id AND rv.start < sp.\"end\" AND sp.start < rv.\"end\"))"


def solid(spark, sf):
    return fx.alignments(spark, sf).select("read_id", F.col("path").alias("onode_id"), F.col("read_start").alias("start"), F.col("read_end").alias("end"))


def forbidden(spark, sf):
    return haplotype.forbidden(solid(spark, sf), spark.range(4).select(F.col("id").alias("onode_id"), F.col("id").bitwiseXOR(F.lit(1)).alias("other")))


@query(SOLID + " SELECT * FROM fb")
def h9_forbidden(spark, sf):
    return forbidden(spark, sf)


@query(SOLID + " SELECT DISTINCT * FROM (SELECT * FROM fb UNION ALL SELECT * FROM rv)")
def h11_over_all(spark, sf):
    conflict = spark.range(4).select(F.col("id").alias("onode_id"), F.col("id").bitwiseXOR(F.lit(1)).alias("other"))
    rivals = solid(spark, sf).join(conflict, "onode_id").select("read_id", F.col("other").alias("onode_id"), "start", "end")
    return haplotype.over_all(forbidden(spark, sf), rivals)


@query(SOLID + ", s AS (SELECT read_id, path AS onode_id, read_start + 17 AS read_pos, aln_id FROM alns) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fb.read_id = s.read_id AND fb.onode_id = s.onode_id AND s.read_pos >= greatest(floor(fb.start / 64) * 64, 0) AND s.read_pos < ceil(fb.\"end\" / 64) * 64)")
def h12_allowed_seeds(spark, sf):
    seeds = fx.alignments(spark, sf).select("read_id", F.col("path").alias("onode_id"), (F.col("read_start") + 17).alias("read_pos"), "aln_id")
    return haplotype.allowed_seeds(seeds, forbidden(spark, sf))


@query(SOLID + " SELECT DISTINCT read_id, onode_id, unnest(range(CAST(ceil(start / 64) * 64 AS BIGINT), CAST(floor(\"end\" / 64) * 64 AS BIGINT), 64)) AS slice FROM fb")
def h13_forbidden_slices(spark, sf):
    return haplotype.forbidden_slices(forbidden(spark, sf))


def corrections(spark, sf):
    """Aligned parts of short reads: every second 40 bases of 100, shifted by the read.

    Reads are told apart by name and bases: turns from 100 on have the names of the next conversation's.
    """
    r = short_reads(spark, sf).where("length(seq) >= 60").distinct()
    at = F.explode(F.sequence((F.col("read_id") % 10).cast("int"), F.length("seq") - 40, F.lit(60)))
    return r.withColumn("start", at).selectExpr("read_id", "start", "start + 40 + int(read_id % 2) * 30 as e0", "seq").selectExpr("read_id", "seq", "start", "least(e0, length(seq)) as end", "substring(seq, start + 1, least(e0, length(seq)) - start) as corrected").withColumn("read_id", F.struct("read_id", "seq")).drop("seq")


def patched(r, c) -> DataFrame:
    return correction.patched(r.withColumn("read_id", F.struct("read_id", "seq")), c).select("read_id.read_id", "corrected")


@query(f"WITH {SHORT} SELECT read_id, CASE WHEN length(seq) < 60 THEN lower(seq) WHEN read_id % 2 = 1 THEN lower(substr(seq, 1, CAST(read_id % 10 AS INT))) || upper(substr(seq, CAST(read_id % 10 AS INT) + 1, e - CAST(read_id % 10 AS INT))) || lower(substr(seq, e + 1)) END AS corrected FROM (SELECT *, CAST(least(((length(seq) - 40 - read_id % 10) // 60) * 60 + read_id % 10 + 70, length(seq)) AS INT) AS e FROM sr) WHERE length(seq) < 60 OR read_id % 2 = 1")
def r2_patched(spark, sf):
    """Odd reads only have parts that overlap by their own bases; the longest overlap joins them as they were."""
    r = short_reads(spark, sf).where("length(seq) < 60 or read_id % 2 = 1")
    c = corrections(spark, sf).where("read_id.read_id % 2 = 1")
    return patched(r, c)


@query(f"WITH {SHORT} SELECT read_id, lower(seq) AS corrected FROM sr")
def r3_unaligned(spark, sf):
    return patched(short_reads(spark, sf), corrections(spark, sf).limit(0))


@query(with_("alns") + "SELECT concat_ws('_', read_id, row_number() OVER (PARTITION BY read_id ORDER BY xscore DESC, read_start, aln_id) - 1, read_start, read_end) AS name, repeat('ACGGT', CAST(edits + 1 AS INT)) AS corrected FROM alns")
def r4_clipped(spark, sf):
    ranked = selection.ranked(fx.alignments(spark, sf)).select("read_id", "rank", F.col("read_start").alias("start"), F.col("read_end").alias("end"), F.expr("repeat('acggt', int(edits + 1))").alias("corrected"))
    return correction.clipped(ranked)


OPS = "ops AS (SELECT l_orderkey AS aln_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step, substr('=XID', CAST(l_quantity AS INT) % 4 + 1, 1) AS op FROM lineitem)"


@query(f"WITH {OPS}, g AS (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY step) - row_number() OVER (PARTITION BY aln_id, op ORDER BY step) AS d FROM ops), r AS (SELECT aln_id, op, d, count(*) AS n, min(step) AS s FROM g GROUP BY ALL) SELECT aln_id, string_agg(n || op, '' ORDER BY s) AS cigar FROM r GROUP BY aln_id")
def f12_cigar(spark, sf):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    ops = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("aln_id"), F.row_number().over(order).alias("step"), F.expr("substring('=XID', cast(l_quantity as int) % 4 + 1, 1)").alias("op"))
    return writers.cigar(ops)


@query(with_("onodes") + "SELECT node_id % 7 AS aln_id, string_agg(CASE WHEN is_rev THEN '<' ELSE '>' END || name, '' ORDER BY onode_id) AS path FROM onodes GROUP BY 1")
def f13_path_text(spark, sf):
    return writers.path_text(fx.oriented(spark, sf)[0].select((F.col("node_id") % 7).alias("aln_id"), F.col("onode_id").alias("step"), "name", "is_rev"))


@query()
def r2_patched_whole(spark, sf):
    return patched(short_reads(spark, sf), corrections(spark, sf))


@query()
def t1_summary_whole(spark, sf):
    rd = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), (700 + F.col("o_orderkey") % 900).alias("len"))
    return stats.summary(rd, fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id")), fx.alignments(spark, sf))
