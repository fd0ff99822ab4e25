"""Registered queries on alignment traces, their clean-up, states of the extension, sinks and haplotypes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.checkpoints import shared_dir
from seqgraph.operators import clustering, correction, extension, haplotype, seeding, selection, stats
from seqgraph.params import AlignParams
from seqgraph.plans import fixtures as fx
from seqgraph.plans.align_queries import CHAINS, K, SEEDED, VOTES, WIN, chain_table, hits, minimizer_cte, votes
from seqgraph.plans.fixtures import with_
from seqgraph.sinks import writers
from seqgraph.sources import seeds

QUERIES: dict = {}
SQL: dict = {}
IDENTITY = 0.66
COST = 2.94


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- alignments with steps, from lineitem -------------------------------------------------------------------------------

TRACED = with_("alns") + """, tr0 AS (SELECT read_id, read_id * 1000 + aln_id AS aln_id, read_start // 300 * 300 AS read_start, repeat('=', CAST((read_end - read_start) // 10 AS INT)) || substr('XIDIX=DIXDDX', CAST(edits % 9 + 1 AS INT), 4) || repeat('=', CAST(read_start % 23 AS INT)) AS ops,
  [2 * (read_id % 40), 2 * (read_id % 40) + 2] AS path, read_id % 3 AS path_start, edits % 9 AS path_end_off FROM alns),
tr AS (SELECT *, CAST(length(replace(ops, '=', '')) AS INT) AS edits, CAST(read_start + length(replace(ops, 'D', '')) AS BIGINT) AS read_end, (100 * length(replace(ops, 'D', '')) - 294 * length(replace(ops, '=', ''))) / 100.0::DOUBLE AS xscore FROM tr0)
"""


def traced(spark, sf) -> DataFrame:
    rows = fx.alignments(spark, sf).selectExpr(
        "read_id", "read_id * 1000 + aln_id as aln_id", "read_start div 300 * 300 as read_start", "concat(repeat('=', int((read_end - read_start) div 10)), substring('XIDIX=DIXDDX', int(edits % 9 + 1), 4), repeat('=', int(read_start % 23))) as ops",
        "array(2 * (read_id % 40), 2 * (read_id % 40) + 2) as path", "read_id % 3 as path_start", "edits % 9 as path_end_off",
    )
    rows = rows.withColumn("edits", F.expr("int(length(replace(ops, '=', '')))")).withColumn("read_end", F.expr("read_start + length(replace(ops, 'D', ''))"))
    return rows.withColumn("xscore", F.expr("(100 * (read_end - read_start) - 294 * edits) / 100.0D"))


@query(TRACED + "SELECT aln_id, op, count(*) AS n, CAST(sum(step) AS BIGINT) AS places FROM (SELECT aln_id, step, substr(ops, CAST(step + 1 AS INT), 1) AS op FROM (SELECT aln_id, ops, unnest(range(0, length(ops))) AS step FROM tr)) GROUP BY ALL")
def x7_trace(spark, sf):
    return extension.trace(traced(spark, sf)).groupBy("aln_id", "op").agg(F.count("*").alias("n"), F.sum("step").alias("places"))


@query(TRACED + "SELECT aln_id, read_id, xscore FROM (SELECT *, row_number() OVER (PARTITION BY read_id, read_start, path[1], path_start ORDER BY xscore DESC, aln_id) AS r FROM tr) WHERE r = 1")
def x8_distinct_starts(spark, sf):
    return extension.distinct_starts(traced(spark, sf)).select("aln_id", "read_id", "xscore")


@query(TRACED + """, rv AS (SELECT a.aln_id, a.ops AS x, b.ops AS y FROM tr a JOIN tr b ON a.read_id = b.read_id AND a.read_start = b.read_start AND a.path[1] = b.path[1] AND a.path_start = b.path_start AND a.aln_id <> b.aln_id AND abs(a.xscore - b.xscore) <= 20),
sh AS (SELECT aln_id, x, y, unnest(range(1, greatest(length(x), length(y)) + 1)) AS i FROM rv),
df AS (SELECT aln_id, x, y, min(CASE WHEN substr(x, CAST(i AS INT), 1) <> substr(y, CAST(i AS INT), 1) THEN i - 1 ELSE length(x) END) AS n FROM sh GROUP BY ALL)
SELECT tr.aln_id, CAST(coalesce(min(n), length(ops)) AS BIGINT) AS sure_steps FROM tr LEFT JOIN df ON df.aln_id = tr.aln_id GROUP BY tr.aln_id, ops""")
def x9_ambiguous_end(spark, sf):
    return extension.ambiguous_end(traced(spark, sf), 20.0).select("aln_id", "sure_steps")


@query(TRACED + ", c AS (SELECT aln_id, read_start, read_end, regexp_replace(regexp_replace(ops, 'ID', 'X', 'g'), 'DI', 'X', 'g') AS ops FROM tr) SELECT aln_id, ops, CAST(length(replace(ops, '=', '')) AS INT) AS edits, (100 * (read_end - read_start) - 294 * length(replace(ops, '=', ''))) / 100.0::DOUBLE AS xscore FROM c")
def x10_cancelled(spark, sf):
    return extension.cancelled(traced(spark, sf), IDENTITY).select("aln_id", "ops", "edits", "xscore")


# each node (10 i) overlaps a short one (10 i + 2) by 5 bases, of which the first may differ, and that one the next by 6
LAID = with_("nodes") + """, sh AS (SELECT node_id, seq AS a, CASE WHEN node_id % 4 = 0 THEN translate(right(seq, 5)[1], 'ACGT', 'CGTA') ELSE right(seq, 5)[1] END || right(seq, 4) || 'ACG' AS s FROM nodes WHERE length(seq) > 20),
al AS (SELECT node_id * 100 + v AS aln_id, node_id, a, s, 3 AS path_start, v + 1 AS path_end_off FROM (SELECT *, unnest(range(0, 10)) AS v FROM sh) UNION ALL SELECT node_id * 100 + 50 + v, node_id, a, s, length(a) - 7 + v, 30 FROM (SELECT *, unnest(range(0, 7)) AS v FROM sh)),
e1 AS (SELECT *, path_end_off <= 6 AS drop_b FROM al), e2 AS (SELECT *, drop_b AND 2 + path_end_off <= 5 AND left(right(a, 5), 2 + path_end_off) = left(s, 2 + path_end_off) AS drop_s FROM e1),
s1 AS (SELECT *, path_start >= length(a) - 5 AND substr(a, CAST(path_start + 1 AS INT)) = substr(s, CAST(path_start - length(a) + 6 AS INT), CAST(length(a) - path_start AS INT)) AND NOT drop_s AS lose_a FROM e2),
s2 AS (SELECT *, lose_a AND path_start - length(a) + 5 >= 2 AND NOT drop_b AS lose_s FROM s1)
"""


def laid(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = fx.nodes(spark, sf).where("length(seq) > 20").selectExpr("node_id", "seq as a", "concat(case when node_id % 4 = 0 then translate(left(right(seq, 5), 1), 'ACGT', 'CGTA') else left(right(seq, 5), 1) end, right(seq, 4), 'ACG') as s")
    node = lambda k, seq: n.selectExpr(f"10 * node_id + {k} as onode_id", f"{seq} as seq").withColumn("len", F.length("seq"))
    onodes = node(0, "a").union(node(2, "s")).union(node(4, "concat(right(s, 6), left(a, 40))"))
    oedges = n.selectExpr("10 * node_id as src", "10 * node_id + 2 as dst", "5 as overlap").union(n.selectExpr("10 * node_id + 2", "10 * node_id + 4", "6"))
    ends = n.selectExpr("node_id", "a", "explode(sequence(0, 9)) as v").selectExpr("node_id * 100 + v as aln_id", "node_id", "bigint(3) as path_start", "bigint(v + 1) as path_end_off")
    starts = n.selectExpr("node_id", "a", "explode(sequence(0, 6)) as v").selectExpr("node_id * 100 + 50 + v", "node_id", "bigint(length(a) - 7 + v)", "bigint(30)")
    return ends.union(starts).selectExpr("aln_id", "array(10 * node_id, 10 * node_id + 2, 10 * node_id + 4) as path", "path_start", "path_end_off"), onodes, oedges


@query(LAID + """SELECT aln_id, CAST(path_start - CASE WHEN lose_s THEN length(a) - 5 + 2 WHEN lose_a THEN length(a) - 5 ELSE 0 END AS BIGINT) AS path_start, CAST(CASE WHEN drop_s THEN length(a) - 5 + 2 + path_end_off WHEN drop_b THEN 2 + path_end_off ELSE path_end_off END AS BIGINT) AS path_end_off,
  10 * node_id + CASE WHEN lose_s THEN 4 WHEN lose_a THEN 2 ELSE 0 END AS first, 10 * node_id + CASE WHEN drop_s THEN 0 WHEN drop_b THEN 2 ELSE 4 END AS last FROM s2""")
def x11_normalised_ends(spark, sf):
    """Ends and starts at each base of two overlaps one behind the other, some of them with a base that differs."""
    return extension.normalised_ends(*laid(spark, sf)).select("aln_id", "path_start", "path_end_off", F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"))


@query(with_("alns") + """, sp AS (SELECT read_id, read_start AS s, read_end AS e FROM alns UNION ALL SELECT DISTINCT read_id, 0, 0 FROM alns),
iv AS (SELECT read_id, e AS s, coalesce(lead(s) OVER (PARTITION BY read_id ORDER BY s, e), 1500) AS e FROM (SELECT read_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(o) OVER (PARTITION BY read_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY read_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM sp)) GROUP BY read_id, g))
SELECT read_id, s AS start, CAST(e AS BIGINT) AS end, s + 40 AS point FROM iv WHERE s + 40 < e AND s + 40 < 1499""")
def x1_restarts(spark, sf):
    """What a read's alignments leave, and where a seedless alignment begins again there."""
    spans = fx.alignments(spark, sf).select("read_id", F.col("read_start").cast("long").alias("start"), F.col("read_end").cast("long").alias("end"))
    reads = spans.select("read_id").distinct().withColumn("len", F.lit(1500))
    return extension.restarts(reads, spans.union(reads.selectExpr("read_id", "0l", "0l")), 40)


@query(TRACED + """, t1 AS (SELECT aln_id, ops, 'ACGGTCATTGCA'[CAST(read_id % 5 + 1 AS INT):] AS g, unnest(range(0, length(ops))) AS step FROM tr),
t2 AS (SELECT *, substr(ops, CAST(step + 1 AS INT), 1) AS op FROM t1), t3 AS (SELECT *, sum(CASE WHEN op = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY aln_id ORDER BY step) AS n FROM t2)
SELECT aln_id, string_agg(substr(g, CAST((n - 1) % length(g) + 1 AS INT), 1), '' ORDER BY step) AS corrected FROM t3 WHERE op <> 'I' GROUP BY aln_id""")
def r1_corrected_segments(spark, sf):
    """The graph's bases under each alignment's steps; insertions in the read have none. The graph repeats a short text."""
    g = "substring('ACGGTCATTGCA', int(read_id % 5 + 1))"
    rows = traced(spark, sf).withColumn("graph_seq", F.expr(f"repeat({g}, int(length(ops) div length({g}) + 1))"))
    return correction.corrected_segments(rows)


@query(TRACED + f""", st AS (SELECT aln_id, step, substr(ops, CAST(step + 1 AS INT), 1) AS op FROM (SELECT aln_id, ops, unnest(range(0, length(ops))) AS step FROM tr)),
su AS (SELECT aln_id, step, round(sum(CASE op WHEN '=' THEN 1.0::DOUBLE WHEN 'D' THEN -{COST}::DOUBLE ELSE 1.0::DOUBLE - {COST}::DOUBLE END) OVER (PARTITION BY aln_id ORDER BY step DESC), 6) AS s FROM st)
SELECT aln_id, CAST(step AS INT) AS clip_steps FROM (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY s DESC, step) AS r FROM su) WHERE r = 1""")
def x12_start_clip(spark, sf):
    return extension.start_clip(traced(spark, sf), IDENTITY).select("aln_id", "clip_steps")


@query(TRACED + """, d AS (SELECT aln_id, ops, edits + CAST(aln_id % 2 AS INT) AS edits, read_start, read_end - CASE WHEN aln_id % 5 = 0 THEN 1 ELSE 0 END AS read_end FROM tr) SELECT aln_id FROM d WHERE length(replace(ops, '=', '')) <> edits OR length(replace(ops, 'D', '')) <> read_end - read_start""")
def x13_violations(spark, sf):
    """Alignments of a read of A to a graph of A, some with a wrong count of edits or a wrong end."""
    rows = traced(spark, sf).withColumn("edits", F.expr("edits + int(aln_id % 2)")).withColumn("read_end", F.expr("read_end - int(aln_id % 5 = 0)"))
    rows = rows.withColumn("seq", F.expr("repeat('A', int(read_end + 2))")).withColumn("graph_seq", F.expr("repeat('A', length(replace(ops, 'I', '')))"))
    return extension.violations(rows).select("aln_id")


@query(TRACED + """, side AS (SELECT aln_id, read_id, read_start, CAST(length(replace(ops, 'D', '')) AS BIGINT) AS r, edits, ops, path, path_start, path_end_off FROM tr)
SELECT aln_id, read_start + 1000 - r AS read_start, read_start + 1015 + r AS read_end, 2 * edits AS edits, (100 * (2 * r + 15) - 294 * 2 * edits) / 100.0::DOUBLE AS xscore, reverse(ops) || repeat('=', 15) || ops AS ops, array_to_string(list_concat(list_reverse(list_transform(path, lambda n: xor(n, 1))), path[2:]), ',') AS path, CAST(100 - path_start AS BIGINT) AS path_start, CAST(path_end_off AS BIGINT) AS path_end_off FROM side""")
def x14_merged(spark, sf):
    """Both sides of anchors of 15 bases; the left one has the steps of the right one."""
    rows = traced(spark, sf)
    anchors = rows.select("aln_id", "read_id", (F.col("read_start") + 1000).alias("read_pos"), F.lit(15).alias("match_len"))
    side = lambda s, off: rows.select("aln_id", F.lit(s).alias("side"), F.element_at("path", 2).alias("onode_id"), F.col(off).cast("long").alias("off"), F.expr("bigint(length(replace(ops, 'D', '')))").alias("rpos"), F.col("edits").alias("e"), "ops", "path")
    ends = rows.select(F.element_at("path", 2).alias("onode_id"), F.lit(100).alias("len")).distinct()
    got = extension.merged(side(extension.BACKWARD, "path_start").union(side(extension.FORWARD, "path_end_off")), anchors, ends, IDENTITY)
    return got.select("aln_id", "read_start", "read_end", "edits", "xscore", "ops", F.array_join(F.transform("path", lambda n: n.cast("string")), ",").alias("path"), F.col("path_start").cast("long").alias("path_start"), "path_end_off")


# -- states of the extension --------------------------------------------------------------------------------------------

STATES = with_("alns") + ", sta AS (SELECT read_id AS aln_id, aln_id % 2 AS side, path AS onode_id, read_end % 97 AS off, read_start AS rpos, edits AS e, aln_id AS id FROM alns) "


def states(spark, sf) -> DataFrame:
    return fx.alignments(spark, sf).selectExpr("read_id as aln_id", "aln_id % 2 as side", "path as onode_id", "read_end % 97 as off", "read_start as rpos", "edits as e", "aln_id as id")


@query(STATES + "SELECT aln_id, id, e FROM (SELECT *, min(e) OVER (PARTITION BY aln_id, side, rpos // 64) AS low FROM sta) WHERE e <= low + 2")
def x3_within_band(spark, sf):
    return extension.within_band(states(spark, sf), 2).select("aln_id", "id", "e")


@query(STATES + f"SELECT aln_id, id FROM (SELECT *, max(rpos - e * {COST}::DOUBLE) OVER (PARTITION BY aln_id, side) AS top FROM sta) WHERE rpos - e * {COST}::DOUBLE >= top - 300 AND 900 - (e + 1) * {COST}::DOUBLE > top")
def x4_alive(spark, sf):
    scored = extension.scored(states(spark, sf), IDENTITY)
    best = scored.groupBy("aln_id", "side").agg(F.max("x").alias("top"))
    return extension.alive(scored.join(best, ["aln_id", "side"]).withColumn("qlen", F.lit(900)), 300.0, COST).select("aln_id", "id")


@query(STATES + "SELECT aln_id, e, rpos FROM (SELECT *, row_number() OVER (PARTITION BY aln_id, side, rpos // 64 ORDER BY e, rpos DESC, onode_id, off) AS r FROM sta) WHERE r <= 1")
def x5_within_budget(spark, sf):
    return extension.within_budget(states(spark, sf), 1).select("aln_id", "e", "rpos")


# sides of 5 to 35 bases of each node and what follows it, with a mismatch, a deletion and an insertion
SIDES = with_("onodes", "oedges") + """, st AS (SELECT onode_id, onode_id * 100 + back AS aln_id, len - back AS off, substr(seq, CAST(len - back + 1 AS INT)) AS here, back FROM (SELECT *, unnest([5, 15, 25, 35]) AS back FROM onodes)),
wk AS (SELECT aln_id, here AS w FROM st UNION SELECT aln_id, here || substr(seq, CAST(overlap + 1 AS INT), 60) FROM st JOIN oedges ON src = st.onode_id JOIN onodes o ON o.onode_id = dst),
qu AS (SELECT aln_id, substr(w, 1, 10) || 'A' || substr(w, 12, 9) || substr(w, 22, 7) || 'GC' || substr(w, 29, 18) AS q FROM (SELECT aln_id, max(w) AS w FROM wk GROUP BY aln_id)),
ce AS (SELECT aln_id, r, levenshtein(substr(q, 1, CAST(r AS INT)), substr(w, 1, CAST(o AS INT))) AS e FROM (SELECT aln_id, q, w, r, unnest(range(0, least(length(w), 60) + 1)) AS o FROM (SELECT qu.aln_id, q, w, unnest(range(0, length(q) + 1)) AS r FROM qu JOIN wk USING (aln_id)))),
be AS (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY round(r - e * 2.94::DOUBLE, 6) DESC, e, r DESC) AS k FROM ce)
"""


def sides(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    onodes, oedges = fx.oriented(spark, sf)
    st = onodes.withColumn("back", F.explode(F.array(*map(F.lit, (5, 15, 25, 35))))).selectExpr("onode_id", "onode_id * 100 + back as aln_id", "bigint(len - back) as off", "substring(seq, len - back + 1) as here")
    on = st.join(oedges, st["onode_id"] == oedges["src"]).join(onodes.select(F.col("onode_id").alias("dst"), "seq"), "dst").selectExpr("aln_id", "concat(here, substring(seq, overlap + 1, 60)) as w")
    walk = st.selectExpr("aln_id", "here as w").union(on).groupBy("aln_id").agg(F.max("w").alias("w"))
    query = walk.selectExpr("aln_id", "concat(substring(w, 1, 10), 'A', substring(w, 12, 9), substring(w, 22, 7), 'GC', substring(w, 29, 18)) as query")
    return st.join(query, "aln_id").select("aln_id", F.lit(extension.FORWARD).alias("side"), "onode_id", "off", "query"), onodes, oedges


def extended(spark, sf) -> DataFrame:
    return extension.extend(*sides(spark, sf), AlignParams(bandwidth=100))


@query(SIDES + "SELECT aln_id, round(r - e * 2.94::DOUBLE, 6) AS x, CAST(e AS INT) AS e, r AS rpos FROM be WHERE k = 1")
def x2_sides(spark, sf):
    """The best end of each side, over all that a full search finds."""
    return extended(spark, sf).select("aln_id", F.round("x", 6).alias("x"), "e", "rpos")


@query(SIDES + "SELECT aln_id, CAST(e AS INT) AS edits, r AS read_bases FROM be WHERE k = 1")
def x7_steps(spark, sf):
    """The steps traced back over the pointers take the edits and the bases of the best end."""
    return extended(spark, sf).select("aln_id", F.length(F.regexp_replace("ops", "=", "")).alias("edits"), F.length(F.regexp_replace("ops", "D", "")).cast("long").alias("read_bases"))


CELLS = with_("oedges") + """, ce AS (SELECT l_orderkey AS aln_id, CAST(l_suppkey % 2 AS INT) AS side, CAST(2 * (l_partkey % 40) AS BIGINT) AS onode_id, CAST(l_linenumber // 2 + l_suppkey % 3 AS BIGINT) AS slice, ((l_partkey * 37 + l_suppkey) % 900 + l_linenumber * 100) / 5.0::DOUBLE - 60 AS x, CAST(l_partkey % 7 AS INT) AS e, CAST((l_linenumber // 2 + l_suppkey % 3) * 64 + l_partkey % 64 AS BIGINT) AS rpos, CAST(l_suppkey % 11 AS BIGINT) AS off FROM lineitem),
c1 AS (SELECT *, row_number() OVER (PARTITION BY aln_id, side, onode_id, slice ORDER BY x DESC, e, rpos DESC, off) AS k FROM ce), c2 AS (SELECT * EXCLUDE (k) FROM c1 WHERE k = 1), po AS (SELECT * FROM c2 WHERE x > 0),
be AS (SELECT DISTINCT src, dst FROM oedges),
ne AS (SELECT aln_id, side, onode_id, slice + 1 AS slice, x, false AS tie FROM po UNION ALL SELECT aln_id, side, onode_id, slice - 1, x, true FROM po
  UNION ALL SELECT aln_id, side, dst, slice, x, false FROM po JOIN be ON src = onode_id UNION ALL SELECT aln_id, side, dst, slice + 1, x, false FROM po JOIN be ON src = onode_id
  UNION ALL SELECT aln_id, side, src, slice, x, false FROM po JOIN be ON dst = onode_id UNION ALL SELECT aln_id, side, src, slice - 1, x, false FROM po JOIN be ON dst = onode_id),
hi AS (SELECT aln_id, side, onode_id, slice, max(x) AS above, max(CASE WHEN tie THEN x END) AS level FROM ne GROUP BY ALL),
t1 AS (SELECT *, max(x) OVER (PARTITION BY aln_id, side, slice) AS top, aln_id // 4 AS read_id, aln_id % 4 AS cluster, CAST(floor((CASE WHEN side = 1 THEN aln_id % 9 * 50 + slice * 64 ELSE aln_id % 9 * 50 - slice * 64 - 1 END) / 64.0) AS BIGINT) AS place FROM po),
t2 AS (SELECT *, coalesce(max(top) OVER (PARTITION BY read_id, side, place ORDER BY cluster RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t1),
s1 AS (SELECT t2.* FROM t2 LEFT JOIN hi USING (aln_id, side, onode_id, slice) WHERE t2.x >= 0.9::DOUBLE * top AND t2.x >= 0.9::DOUBLE * 0.5::DOUBLE * before AND coalesce(above <= t2.x, true) AND coalesce(level < t2.x, true)),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aln_id, side, slice ORDER BY x DESC, e, rpos DESC, onode_id, off) AS k FROM s1) WHERE k <= 3),
s3 AS (SELECT * FROM s2 s WHERE NOT EXISTS (SELECT 1 FROM s2 w WHERE w.aln_id = s.aln_id AND w.side = s.side AND s.slice >= ceil(w.rpos * 0.05::DOUBLE / 64) + 1 AND s.slice < w.slice AND s.x < 0.9::DOUBLE * w.x)),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aln_id, side ORDER BY x DESC, e, rpos DESC, onode_id, off) AS k FROM c2) WHERE k = 1),
al AS (SELECT aln_id, side, onode_id, slice, x, e, rpos, off FROM s3 UNION SELECT aln_id, side, onode_id, slice, x, e, rpos, off FROM b1)
SELECT aln_id, side, onode_id, slice, x, CAST(row_number() OVER (PARTITION BY aln_id, side ORDER BY x DESC, e, rpos DESC, onode_id, off) AS INT) AS rank FROM al"""


@query(CELLS)
def x6_end_points(spark, sf):
    ends = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey as aln_id", "int(l_suppkey % 2) as side", "bigint(2 * (l_partkey % 40)) as onode_id", "bigint(l_linenumber div 2 + l_suppkey % 3) as slice", "((l_partkey * 37 + l_suppkey) % 900 + l_linenumber * 100) / 5.0D - 60 as x", "int(l_partkey % 7) as e", "bigint((l_linenumber div 2 + l_suppkey % 3) * 64 + l_partkey % 64) as rpos", "bigint(l_suppkey % 11) as off")
    clusters = ends.select("aln_id", "side").distinct().selectExpr("aln_id", "side", "aln_id div 4 as read_id", "aln_id % 4 as cluster", "aln_id % 9 * 50 as shift", "side = 1 as ahead")
    return extension.end_points(ends, fx.oriented(spark, sf)[1], clusters, 3, 0.9).select("aln_id", "side", "onode_id", "slice", "x", "rank")


@query(SEEDED + f", {CHAINS} SELECT h.read_id, h.onode_id, chain, CAST(chain_pos + off - read_pos AS BIGINT) AS diag, count(*) AS n FROM hits h JOIN chains c ON c.onode_id = h.onode_id GROUP BY ALL")
def c1_diagonals(spark, sf):
    return clustering.diagonals(hits(spark, sf), chain_table(spark, sf)).groupBy("read_id", "onode_id", "chain", "diag").agg(F.count("*").alias("n"))


SHORT_STARTS = """, rs AS (SELECT o_orderkey AS read_id, substr(repeat('ACGTTGCAGGATCCTA', 9), CAST(o_custkey % 16 + 1 AS INT), CAST(30 + o_orderkey % 60 AS INT)) AS seq FROM orders),
wi AS (SELECT read_id, seq, unnest(range(0, length(seq) - 2, 40)) AS w FROM rs), bl AS (SELECT read_id, seq, w, unnest([w, w + 3, w + 6]) AS p FROM wi),
pl AS (SELECT onode_id, off, substr(seq, CAST(off + 1 AS INT), 3) AS b FROM (SELECT onode_id, seq, unnest(range(0, len - 2)) AS off FROM onodes WHERE len >= 3))
"""


@query(with_("onodes") + SHORT_STARTS + "SELECT read_id, count(*) AS n, CAST(sum(off) AS BIGINT) AS offs, CAST(sum(p) AS BIGINT) AS places FROM bl JOIN pl ON pl.b = substr(bl.seq, CAST(p + 1 AS INT), 3) WHERE p + 3 <= length(bl.seq) GROUP BY read_id")
def x1_free_starts(spark, sf):
    reads = fx.table(spark, sf, "orders").selectExpr("o_orderkey as read_id", "substring(repeat('ACGTTGCAGGATCCTA', 9), int(o_custkey % 16 + 1), int(30 + o_orderkey % 60)) as seq").withColumn("len", F.length("seq"))
    found = extension.free_anchors(reads, fx.oriented(spark, sf)[0], stride=40)
    return found.groupBy("read_id").agg(F.count("*").alias("n"), F.sum("off").alias("offs"), F.sum("read_pos").cast("long").alias("places"))


# -- sinks --------------------------------------------------------------------------------------------------------------


def place(spark, suffix: str) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}{suffix}"


@query(TRACED + "SELECT CAST(read_id AS VARCHAR) AS name, xscore AS score, 60 AS mapping_quality, CAST(read_start AS BIGINT) AS query_position, CAST(path[1] // 2 AS BIGINT) AS first_node, CAST(path_start AS BIGINT) AS first_offset, CAST(edits AS BIGINT) AS edits, 2 AS n_mappings FROM tr WHERE path[1] IN (SELECT 2 * item_id FROM benchmark) AND path[2] IN (SELECT 2 * item_id FROM benchmark)")
def k2_json(spark, sf):
    """Alignments written as nested JSON and scanned back."""
    rows = traced(spark, sf).withColumn("sequence", F.lit("ACGT")).withColumn("mapq", F.lit(60)).withColumn("matches", F.length("ops") - F.col("edits")).withColumn("block_len", F.length("ops")).withColumn("read_id", F.col("read_id").cast("string"))
    onodes = fx.oriented(spark, sf)[0]
    steps = rows.select("aln_id", F.posexplode("path").alias("at", "onode_id"), "path_start", "edits").select("aln_id", (F.col("at") + 1).alias("rank"), "onode_id", F.when(F.col("at") == 0, F.col("path_start")).otherwise(0).alias("offset"), "edits")
    path = place(spark, ".json")
    writers.write_json(writers.json_rows(rows, steps, onodes), path)
    back = spark.read.schema("name string, score double, mapping_quality int, query_position long, path struct<mapping:array<struct<position:struct<node_id:long,offset:long>,edit:long,rank:int>>>").json(path)
    return back.where("size(path.mapping) = 2").select("name", "score", "mapping_quality", "query_position", F.expr("path.mapping[0].position.node_id").alias("first_node"), F.expr("path.mapping[0].position.offset").alias("first_offset"), F.expr("path.mapping[0].edit").alias("edits"), F.expr("size(path.mapping)").alias("n_mappings"))


@query(with_("alns") + "SELECT '>' || concat_ws('_', read_id, row_number() OVER (PARTITION BY read_id ORDER BY xscore DESC, read_start, aln_id) - 1, read_start, read_end) || chr(10) || repeat('ACGGT', CAST(edits + 1 AS INT)) AS value FROM alns")
def k5_clipped_fasta(spark, sf):
    ranked = selection.ranked(fx.alignments(spark, sf)).select("read_id", "rank", F.col("read_start").alias("start"), F.col("read_end").alias("end"), F.expr("repeat('acggt', int(edits + 1))").alias("corrected"))
    return writers.fasta_lines(correction.clipped(ranked), "name", "corrected")


@query(with_("alns") + "SELECT count(DISTINCT read_id) AS reads, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS seeds, count(*) AS alns FROM alns")
def k6_summary(spark, sf):
    """The run's totals written and scanned back."""
    a = fx.alignments(spark, sf)
    rd = a.select("read_id").distinct().withColumn("len", F.lit(3000))
    path = place(spark, "-summary")
    writers.write_summary(stats.summary(rd, fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id")), a), path)
    got = spark.read.json(path)
    return got.select(F.col("reads").cast("long").alias("reads"), F.col("seeds").cast("long").alias("seeds"), F.col("alignments").cast("long").alias("alns"))


# -- haplotypes: each node beside a copy with single bases changed ------------------------------------------------------

DIPLOID = with_("nodes") + f""", two AS (SELECT node_id AS onode_id, seq FROM nodes UNION ALL SELECT node_id + 1000000, regexp_replace(seq, '(ACG)(.)', '\\1C', 'g') FROM nodes),
{minimizer_cte('hm', 'two', 'onode_id', K, WIN)}, tm AS (SELECT kmer, least(count(*), 3) AS times, list_sort(list(onode_id)) AS spots FROM hm GROUP BY kmer),
tl AS (SELECT onode_id, pos, h.kmer, times, CASE WHEN times = 2 THEN CASE WHEN spots[1] = onode_id THEN spots[2] ELSE spots[1] END END AS other FROM hm h JOIN tm ON tm.kmer = h.kmer),
mk AS (SELECT *, CASE WHEN times > 2 OR other = onode_id THEN 2 WHEN times = 2 THEN 1 ELSE 0 END AS mark FROM tl),
pt AS (SELECT *, sum(CASE WHEN mark > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY onode_id ORDER BY pos) AS part FROM mk),
sg AS (SELECT onode_id, part, count(*) FILTER (WHERE mark = 0) AS single FROM pt GROUP BY ALL),
fl AS (SELECT p.*, single, lead(mark) OVER v AS mark2, lead(kmer) OVER v AS kmer2, lead(other) OVER v AS other2, lead(pos) OVER v AS pos2 FROM pt p JOIN sg s ON s.onode_id = p.onode_id AND s.part = p.part WHERE mark > 0 WINDOW v AS (PARTITION BY p.onode_id ORDER BY pos)),
vl AS (SELECT *, coalesce(mark = 1 AND mark2 = 1 AND other = other2 AND single > 0, false) AS valid FROM fl),
rn AS (SELECT *, sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER (PARTITION BY onode_id ORDER BY pos) AS run FROM vl),
str AS (SELECT onode_id, kmer AS k1, kmer2 AS k2, other, pos AS from_pos, pos2 AS to_pos FROM (SELECT *, row_number() OVER (PARTITION BY onode_id, run ORDER BY pos) AS n FROM rn WHERE valid) WHERE n % 2 = 1),
hom AS (SELECT k1, k2, min(onode_id) AS a, max(onode_id) AS b FROM str GROUP BY k1, k2 HAVING count(*) = 2)
"""


def diploid_kmers(spark, sf) -> DataFrame:
    n = fx.nodes(spark, sf)
    two = n.select(F.col("node_id").alias("onode_id"), "seq").union(n.select(F.col("node_id") + 1_000_000, F.regexp_replace("seq", "(ACG)(.)", "$1C")))
    return seeding.minimizers(two, "onode_id", K, WIN)


@query(DIPLOID + "SELECT onode_id, CAST(k1 AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2, other, CAST(from_pos AS BIGINT) AS from_pos, CAST(to_pos AS BIGINT) AS to_pos FROM str")
def h3_flanked(spark, sf):
    return haplotype.flanked(diploid_kmers(spark, sf))


@query(DIPLOID + "SELECT CAST(k1 AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2, a, b FROM hom")
def h4_homologous(spark, sf):
    return haplotype.homologous(h3_flanked(spark, sf))


@query(DIPLOID + "SELECT DISTINCT CAST(h.kmer AS BIGINT) AS kmer, h.onode_id, CAST(h.pos AS BIGINT) AS pos FROM hm h JOIN str s ON s.onode_id = h.onode_id AND h.pos > s.from_pos AND h.pos < s.to_pos JOIN hom ON hom.k1 = s.k1 AND hom.k2 = s.k2")
def h5_informative(spark, sf):
    s = h3_flanked(spark, sf)
    return haplotype.informative(diploid_kmers(spark, sf), s, haplotype.homologous(s))


@query(DIPLOID + "SELECT DISTINCT CAST(h.kmer AS BIGINT) AS kmer, h.onode_id, CAST(h.pos AS BIGINT) AS pos FROM hm h JOIN str s ON s.onode_id = h.onode_id AND h.pos > s.from_pos AND h.pos < s.to_pos JOIN hom ON hom.k1 = s.k1 AND hom.k2 = s.k2")
def s10_kept_evidence(spark, sf):
    """Evidence of two k kept side by side, and that of one read back."""
    path, mark = place(spark, "-evidence"), seeds.fingerprint(fx.oriented(spark, sf)[0])
    for k in (K, K + 2):
        seeds.write_evidence(h5_informative(spark, sf), h6_conflicts(spark, sf), path, k, mark)
    return seeds.read_evidence(spark, path, K, mark)[0]


@query(DIPLOID + "SELECT DISTINCT a AS onode_id, b AS other FROM hom WHERE a <> b UNION SELECT DISTINCT b, a FROM hom WHERE a <> b")
def h6_conflicts(spark, sf):
    return haplotype.conflicts(h4_homologous(spark, sf))


VOTE_FOLD = VOTES.replace("WITH ", "WITH RECURSIVE ", 1) + """, sv AS (SELECT read_id, onode_id, diag, count(*) AS c FROM (SELECT r.read_id, i.onode_id, CAST(r.pos - i.pos AS BIGINT) AS diag FROM read_kmers r JOIN idx i ON i.kmer = r.kmer) GROUP BY ALL),
cl AS (SELECT read_id, onode_id, min(diag) AS first FROM sv GROUP BY ALL UNION ALL SELECT cl.read_id, cl.onode_id, (SELECT min(diag) FROM sv WHERE sv.read_id = cl.read_id AND sv.onode_id = cl.onode_id AND sv.diag > cl.first + 100) AS nxt FROM cl WHERE EXISTS (SELECT 1 FROM sv WHERE sv.read_id = cl.read_id AND sv.onode_id = cl.onode_id AND sv.diag > cl.first + 100))
SELECT cl.read_id, cl.onode_id, CAST(floor((first + max(diag)) / 2.0) AS BIGINT) AS diag, CAST(sum(c) AS INT) AS n_votes FROM cl JOIN sv ON sv.read_id = cl.read_id AND sv.onode_id = cl.onode_id AND sv.diag BETWEEN cl.first AND cl.first + 100 GROUP BY cl.read_id, cl.onode_id, first HAVING sum(c) >= 3"""


@query(VOTE_FOLD)
def h8_vote_clusters(spark, sf):
    return haplotype.vote_clusters(votes(spark, sf))
