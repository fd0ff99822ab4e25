"""Registered queries on graphs and sequence functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqgraph.functions import sequences as fn
from seqgraph.operators import graph, topology
from seqgraph.plans import fixtures as fx
from seqgraph.plans.fixtures import with_
from seqgraph.sources import gfa

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(with_("nodes", "edges") + """
SELECT 'overlap too long' AS problem, n.name AS name, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN nodes n ON n.node_id IN (e.from_id, e.to_id) WHERE e.overlap + 75 >= length(n.seq) GROUP BY ALL""")
def s2_check_gfa(spark, sf):
    longer = fx.edges(spark, sf).withColumn("overlap", F.col("overlap") + 75)
    return gfa.check(fx.nodes(spark, sf), longer).groupBy("problem", "name").agg(F.count("*").alias("n"))


@query("""SELECT name, row_number() OVER (ORDER BY place, name) - 1 AS node_id FROM (SELECT CAST(l_partkey AS VARCHAR) AS name, min(l_orderkey * 8 + l_linenumber) AS place FROM lineitem GROUP BY 1)""")
def g1_assign_ids(spark, sf):
    return graph.assign_ids(fx.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("name"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place")))


@query(with_("nodes", "onodes") + "SELECT * FROM onodes")
def g2_orient_nodes(spark, sf):
    return fx.oriented(spark, sf)[0]


@query(with_("oedges") + "SELECT * FROM oedges")
def g3_orient_edges(spark, sf):
    return fx.oriented(spark, sf)[1]


@query(with_("edges") + "SELECT DISTINCT from_id AS src, to_id AS dst, overlap FROM edges")
def g4_distinct_edges(spark, sf):
    e = fx.edges(spark, sf)
    return e.union(e).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "overlap").dropDuplicates(["src", "dst", "overlap"])


@query(with_("segs") + "SELECT onode_id, seg_off, seg_len, seq FROM segs")
def g5_segments(spark, sf):
    return graph.segments(*fx.oriented(spark, sf))


PAGES = "translate(regexp_replace(lower(html), '[^a-z]', 'N', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


@query(f"""WITH p AS (SELECT page_id AS onode_id, {PAGES} AS seq FROM pages),
c AS (SELECT onode_id, unnest(range(0, length(seq), 64)) AS a, seq FROM p WHERE length(seq) > 0),
b AS (SELECT onode_id, a, unnest(range(a + 1, least(a + 64, length(seq)) + 1)) AS i, seq FROM c),
f AS (SELECT onode_id, a, i, substr(seq, i, 1) AS x, substr(seq, i, 1) = 'N' AS amb FROM b),
g AS (SELECT *, i - row_number() OVER (PARTITION BY onode_id, a, amb ORDER BY i) AS run FROM f)
SELECT onode_id, 0 AS seg_off, CAST(min(i) - 1 AS INT) AS chunk_off, CAST(count(*) AS INT) AS chunk_len, string_agg(x, '' ORDER BY i) AS seq, amb AS ambiguous FROM g GROUP BY onode_id, a, amb, run""")
def g6_chunks(spark, sf):
    html = F.translate(F.regexp_replace(F.lower("html"), "[^a-z]", "N"), fx.LETTERS, fx.BASES)
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("onode_id"), F.lit(0).alias("seg_off"), html.alias("seq"))
    return graph.chunks(pages.withColumn("seg_len", F.length("seq")))


SEG_EDGES = with_("segs") + """, sedges AS (SELECT e.src, l.src_off, e.dst, s.seg_off AS dst_off FROM oedges e JOIN (SELECT onode_id, max(seg_off) AS src_off FROM segs GROUP BY 1) l ON l.onode_id = e.src JOIN segs s ON s.onode_id = e.dst AND s.seg_off = e.overlap
UNION SELECT onode_id, seg_off, onode_id, nxt FROM (SELECT onode_id, seg_off, lead(seg_off) OVER (PARTITION BY onode_id ORDER BY seg_off) AS nxt FROM segs) WHERE nxt IS NOT NULL)
"""


@query(SEG_EDGES + "SELECT * FROM sedges")
def g7_segment_edges(spark, sf):
    onodes, oedges = fx.oriented(spark, sf)
    return graph.segment_edges(graph.segments(onodes, oedges), oedges)


@query(with_("directed") + "SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM directed UNION ALL SELECT dst, 0, 1 FROM directed) GROUP BY node")
def g8_neighbors(spark, sf):
    return graph.neighbors(fx.directed(spark, sf))


PLACES = "places AS (SELECT o.onode_id, CAST(l_partkey % o.len AS BIGINT) AS off, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN onodes o ON o.onode_id = l_suppkey % (SELECT count(*) FROM onodes) GROUP BY ALL)"


def places(spark, sf):
    onodes = fx.oriented(spark, sf)[0].select("onode_id", "len")
    n = onodes.count()
    return fx.table(spark, sf, "lineitem").withColumn("onode_id", F.col("l_suppkey") % n).join(onodes, "onode_id").select("onode_id", (F.col("l_partkey") % F.col("len")).alias("off")).groupBy("onode_id", "off").agg(F.count("*").alias("n"))


@query(with_("segs") + ", " + PLACES + " SELECT p.onode_id, p.off, p.n, s.seg_off FROM places p JOIN segs s ON s.onode_id = p.onode_id AND p.off >= s.seg_off AND p.off < s.seg_off + s.seg_len")
def g9_locate(spark, sf):
    return graph.locate(places(spark, sf), graph.segments(*fx.oriented(spark, sf)))


@query(with_("onodes") + ", " + PLACES + " SELECT xor(p.onode_id, 1) AS onode_id, o.len - p.off - 1 AS off, p.n FROM places p JOIN onodes o ON o.onode_id = p.onode_id")
def g10_flip(spark, sf):
    return graph.flipped(places(spark, sf), fx.oriented(spark, sf)[0]).select("onode_id", "off", "n")


REACH = with_("directed", recursive=True) + """, nodes_ AS (SELECT src AS node FROM directed UNION SELECT dst FROM directed),
reach AS (SELECT src AS a, dst AS b FROM directed UNION SELECT r.a, d.dst FROM reach r JOIN directed d ON d.src = r.b),
scc AS (SELECT n.node, least(n.node, coalesce(min(f.b), n.node)) AS component FROM nodes_ n LEFT JOIN (SELECT f.a, f.b FROM reach f JOIN reach g ON f.a = g.b AND f.b = g.a) f ON f.a = n.node GROUP BY n.node)
"""


@query(REACH + "SELECT node, component FROM scc")
def g11_strong_components(spark, sf):
    return topology.strong_components(fx.directed(spark, sf))


@query(REACH + """, dag AS (SELECT DISTINCT x.component AS a, y.component AS b FROM directed d JOIN scc x ON x.node = d.src JOIN scc y ON y.node = d.dst WHERE x.component <> y.component),
lv AS (SELECT DISTINCT component AS c, 0 AS level FROM scc UNION SELECT dag.b, lv.level + 1 FROM lv JOIN dag ON dag.a = lv.c)
SELECT node, component, CAST(max(level) AS INT) AS level FROM scc JOIN lv ON c = component GROUP BY node, component""")
def g11_component_order(spark, sf):
    e = fx.directed(spark, sf)
    return topology.component_order(e, topology.strong_components(e))


@query(REACH + "SELECT node, EXISTS (SELECT 1 FROM reach WHERE a = node AND b = node) AS cyclic FROM nodes_")
def g12_in_cycle(spark, sf):
    e = fx.directed(spark, sf)
    return topology.in_cycle(e, topology.strong_components(e))


TIPS = REACH + """, cyc AS (SELECT a AS node FROM reach WHERE a = b),
tips AS (SELECT node, node NOT IN (SELECT node FROM cyc UNION SELECT a FROM reach WHERE b IN (SELECT node FROM cyc)) AS forward_tip, node NOT IN (SELECT node FROM cyc UNION SELECT b FROM reach WHERE a IN (SELECT node FROM cyc)) AS backward_tip FROM nodes_)
"""


@query(TIPS + "SELECT * FROM tips")
def g13_tips(spark, sf):
    return topology.tips(fx.directed(spark, sf))


@query(TIPS + """SELECT tip, min(nb) AS neighbor FROM (SELECT dst AS tip, src AS nb FROM directed JOIN tips t ON t.node = dst AND t.forward_tip WHERE src <> dst
UNION SELECT src, dst FROM directed JOIN tips t ON t.node = src AND t.backward_tip WHERE src <> dst) GROUP BY tip HAVING count(DISTINCT nb) = 1""")
def g14_tip_neighbors(spark, sf):
    e = fx.directed(spark, sf)
    return topology.unique_neighbors(e, topology.tips(e))


@query(TIPS + """, inn AS (SELECT src, dst FROM directed JOIN tips a ON a.node = src AND NOT a.forward_tip AND NOT a.backward_tip JOIN tips b ON b.node = dst AND NOT b.forward_tip AND NOT b.backward_tip WHERE src <> dst)
SELECT f.node, f.a AS neighbor FROM (SELECT src AS node, min(dst) AS a FROM inn GROUP BY 1 HAVING count(DISTINCT dst) = 1) f JOIN (SELECT dst AS node, min(src) AS b FROM inn GROUP BY 1 HAVING count(DISTINCT src) = 1) g ON f.node = g.node AND a = b""")
def g15_cycle_spurs(spark, sf):
    e = fx.directed(spark, sf)
    return topology.cycle_spurs(e, topology.tips(e))


def bubble_sql(edges: str, aside: str) -> str:
    """Tables bub (s, t) and ins (s, u) of a graph of many small parts, by all pairs within a part (node // 16).

    in_ is what s reaches without passing t. All that leads into it, and to t, comes from it; nothing leads back to s; it
    has no cycle and no dead end. Of several ends the nearest counts.
    """
    return f"""part AS (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges}),
w AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst AND dst NOT IN (SELECT node FROM {aside})),
par AS (SELECT src, dst FROM w WHERE src NOT IN (SELECT node FROM {aside})),
in_ AS (SELECT a.node AS s, b.node AS t, a.node AS u FROM part a JOIN part b ON a.node // 16 = b.node // 16 AND a.node <> b.node WHERE a.node IN (SELECT src FROM w)
  UNION SELECT in_.s, in_.t, w.dst FROM in_ JOIN w ON w.src = in_.u WHERE w.dst <> in_.t),
led AS (SELECT DISTINCT in_.s, in_.t FROM in_ JOIN w ON w.src = in_.u AND w.dst = in_.t),
bad AS (SELECT l.s, l.t FROM led l JOIN par p ON p.dst = l.t LEFT JOIN in_ ON in_.s = l.s AND in_.t = l.t AND in_.u = p.src WHERE in_.u IS NULL
  UNION SELECT i.s, i.t FROM in_ i JOIN par p ON p.dst = i.u AND i.u <> i.s LEFT JOIN in_ j ON j.s = i.s AND j.t = i.t AND j.u = p.src WHERE j.u IS NULL
  UNION SELECT i.s, i.t FROM in_ i JOIN w ON w.src = i.u AND w.dst = i.s
  UNION SELECT l.s, l.t FROM led l JOIN {edges} e ON e.src = l.t AND e.dst = l.s
  UNION SELECT i.s, i.t FROM in_ i WHERE i.u NOT IN (SELECT src FROM w)),
maybe AS (SELECT s, t FROM led EXCEPT SELECT s, t FROM bad),
lo AS (SELECT i.s, i.t, i.u AS a, w.dst AS b FROM maybe m JOIN in_ i ON i.s = m.s AND i.t = m.t JOIN w ON w.src = i.u AND w.dst <> i.t
  UNION SELECT lo.s, lo.t, lo.a, w.dst FROM lo JOIN w ON w.src = lo.b AND w.dst <> lo.t),
fine AS (SELECT s, t FROM maybe EXCEPT SELECT s, t FROM lo WHERE a = b),
bub AS (SELECT f.s, arg_min(f.t, n) AS t FROM fine f JOIN (SELECT s, t, count(*) AS n FROM in_ GROUP BY s, t) c ON c.s = f.s AND c.t = f.t GROUP BY f.s),
ins AS (SELECT i.s, i.u FROM in_ i JOIN bub ON bub.s = i.s AND bub.t = i.t WHERE i.u <> i.s AND i.s NOT IN (SELECT node FROM {aside}))"""


NOBODY = "nobody AS (SELECT src AS node FROM knots WHERE false)"


@query(with_("knots", recursive=True) + f", {NOBODY}, {bubble_sql('knots', 'nobody')} SELECT s AS start, t AS finish FROM bub")
def g16_superbubbles(spark, sf):
    return topology.superbubbles(fx.knots(spark, sf))[0]


@query(with_("knots", recursive=True) + f", {NOBODY}, {bubble_sql('knots', 'nobody')} SELECT s AS start, u AS node FROM ins")
def g17_bubble_insides(spark, sf):
    return topology.superbubbles(fx.knots(spark, sf))[1]


# tips, spurs and bubbles of the small parts, then what they hold together
CHAINS = with_("knots", recursive=True) + """, rea AS (SELECT src AS a, dst AS b FROM knots UNION SELECT r.a, k.dst FROM rea r JOIN knots k ON k.src = r.b),
cyc AS (SELECT a AS node FROM rea WHERE a = b),
fore AS (SELECT src AS node FROM knots UNION SELECT dst FROM knots EXCEPT (SELECT node FROM cyc UNION SELECT a FROM rea WHERE b IN (SELECT node FROM cyc))),
back AS (SELECT src AS node FROM knots UNION SELECT dst FROM knots EXCEPT (SELECT node FROM cyc UNION SELECT b FROM rea WHERE a IN (SELECT node FROM cyc))),
tip AS (SELECT node FROM fore UNION SELECT node FROM back),
near AS (SELECT dst AS node, src AS nb FROM knots WHERE src <> dst AND dst IN (SELECT node FROM fore) UNION SELECT src, dst FROM knots WHERE src <> dst AND src IN (SELECT node FROM back)),
core AS (SELECT src, dst FROM knots WHERE src <> dst AND src NOT IN (SELECT node FROM tip) AND dst NOT IN (SELECT node FROM tip)),
spur AS (SELECT f.node, a AS nb FROM (SELECT src AS node, min(dst) AS a FROM core GROUP BY 1 HAVING count(DISTINCT dst) = 1) f JOIN (SELECT dst AS node, min(src) AS b FROM core GROUP BY 1 HAVING count(DISTINCT src) = 1) g ON f.node = g.node AND a = b),
aside AS (SELECT node FROM tip UNION SELECT node FROM spur), """ + bubble_sql("knots", "aside") + """,
held AS (SELECT src AS a, dst AS b FROM knots WHERE src IN (SELECT node FROM fore) OR dst IN (SELECT node FROM back) UNION SELECT node, min(nb) FROM near GROUP BY node HAVING count(DISTINCT nb) = 1
  UNION SELECT node, nb FROM spur UNION SELECT s, t FROM bub UNION SELECT s, u FROM ins),
two AS (SELECT a, b FROM held UNION SELECT b, a FROM held),
touch AS (SELECT node, node AS c FROM part UNION SELECT two.b, touch.c FROM touch JOIN two ON two.a = touch.node),
chain AS (SELECT node, min(c) AS chain FROM touch GROUP BY node)"""


@query(CHAINS + " SELECT node, chain FROM chain")
def g18_chains(spark, sf):
    return topology.chains(fx.knots(spark, sf))


@query(CHAINS + """, mv AS (SELECT DISTINCT k.src AS a, k.dst AS b, 5 + k.src % 16 AS d FROM knots k JOIN chain x ON x.node = k.src JOIN chain y ON y.node = k.dst WHERE x.chain = y.chain AND k.src <> k.dst),
mo AS (SELECT a, b, d FROM mv UNION SELECT b, a, -d FROM mv),
hops AS (SELECT node, 0 AS h FROM chain WHERE node = chain UNION SELECT mo.b, h + 1 FROM hops JOIN mo ON mo.a = hops.node WHERE h < 16),
lay AS (SELECT node, min(h) AS h FROM hops GROUP BY node),
pos AS (SELECT node, h, CAST(0 AS BIGINT) AS p FROM lay WHERE h = 0 UNION ALL (SELECT y.node, y.h, CAST(min(pos.p + mo.d) AS BIGINT) FROM pos JOIN mo ON mo.a = pos.node JOIN lay y ON y.node = mo.b AND y.h = pos.h + 1 GROUP BY y.node, y.h))
SELECT pos.node, chain, p AS chain_pos FROM pos JOIN chain ON chain.node = pos.node""")
def g19_chain_positions(spark, sf):
    knots = fx.knots(spark, sf)
    return topology.chain_positions(knots, topology.chains(knots), topology.nodes_of(knots).withColumn("len", (5 + F.col("node") % 16).cast("int")))


@query(with_("nodes") + "SELECT CAST(sum(length(seq)) AS BIGINT) AS bp, count(*) AS n_nodes, bool_and(regexp_matches(name, '^[1-9][0-9]*$')) AS all_numeric FROM nodes")
def g20_graph_size(spark, sf):
    return graph.graph_size(fx.nodes(spark, sf))


@query(f"SELECT page_id AS onode_id, {PAGES} AS seq FROM pages WHERE length(html) > 0")
def g21_reassembled(spark, sf):
    return graph.reassembled(g6_chunks(spark, sf))


WALK = "steps AS (SELECT node_id % 5 AS path_id, node_id AS step, 2 * node_id AS onode_id FROM nodes UNION ALL SELECT 100 + node_id % 3, -node_id, 2 * node_id + 1 FROM nodes)"


@query(with_("onodes", "oedges") + f""", {WALK}, w AS (SELECT path_id, step, onode_id, lag(onode_id) OVER (PARTITION BY path_id ORDER BY step) AS src FROM steps),
p AS (SELECT w.path_id, w.step, substr(o.seq, coalesce(e.overlap, 0) + 1) AS part FROM w JOIN onodes o ON o.onode_id = w.onode_id LEFT JOIN (SELECT src, dst, min(overlap) AS overlap FROM oedges GROUP BY ALL) e ON e.src = w.src AND e.dst = w.onode_id)
SELECT path_id, string_agg(part, '' ORDER BY step) AS seq, CAST(sum(length(part)) AS BIGINT) AS path_len FROM p GROUP BY path_id""")
def g22_spelled(spark, sf):
    onodes, oedges = fx.oriented(spark, sf)
    steps = onodes.select(F.when(F.col("is_rev"), 100 + F.col("node_id") % 3).otherwise(F.col("node_id") % 5).alias("path_id"), F.when(F.col("is_rev"), -F.col("node_id")).otherwise(F.col("node_id")).alias("step"), "onode_id")
    return graph.spelled(steps, onodes, oedges)


@query(with_("reads") + "SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def f1_revcomp(spark, sf):
    return fx.reads(spark, sf).select("read_id", fn.revcomp("seq").alias("rc"))


IUPAC = "(VALUES ('A',1),('C',2),('G',4),('T',8),('U',8),('R',5),('Y',10),('K',12),('M',3),('S',6),('W',9),('B',14),('V',7),('D',13),('H',11),('N',15)) m(c, b)"


@query(f"WITH p AS (SELECT page_id, upper(substr(html, CAST(page_id % 9 AS INT) + 1, 1)) AS x, upper(substr(html, CAST(page_id % 7 AS INT) + 12, 1)) AS y FROM pages) SELECT page_id, coalesce(a.b & b.b, 0) <> 0 AS hit FROM p LEFT JOIN {IUPAC} ON false LEFT JOIN {IUPAC.replace('m(', 'a(')} ON a.c = x LEFT JOIN {IUPAC.replace('m(', 'b(')} ON b.c = y")
def f2_iupac_match(spark, sf):
    p = fx.table(spark, sf, "pages").selectExpr("page_id", "substring(html, int(page_id % 9) + 1, 1) as x", "substring(html, int(page_id % 7) + 12, 1) as y")
    return p.select("page_id", fn.iupac_match("x", "y").alias("hit"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)
SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(word, '^[ACGTNRYKMSWBVDHacgtnrykmswbvdh]+$') THEN 1 ELSE 0 END) AS BIGINT) AS legal, count(*) AS words FROM w GROUP BY doc_id""")
def f3_is_nucleotides(spark, sf):
    """How many of a whole text's words are made of letters for bases only."""
    words = fx.table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("doc_id").agg(F.sum(fn.is_nucleotides(F.col("word")).cast("long")).alias("legal"), F.count("*").alias("words"))


@query(with_("reads") + ", b AS (SELECT read_id, i, substr(seq, i, 1) AS x FROM (SELECT read_id, seq, unnest(range(1, len + 1)) AS i FROM reads)), g AS (SELECT *, lag(x) OVER (PARTITION BY read_id ORDER BY i) AS p FROM b) SELECT read_id, string_agg(x, '' ORDER BY i) AS seq FROM g WHERE p IS NULL OR p <> x GROUP BY read_id")
def f4_hpc_collapse(spark, sf):
    return fx.reads(spark, sf).where("len > 0").select("read_id", fn.hpc_collapse("seq").alias("seq"))


@query(with_("reads") + "SELECT read_id, lower(seq) AS lo, upper(lower(seq)) AS up FROM reads")
def f8_marking(spark, sf):
    return fx.reads(spark, sf).select("read_id", F.lower("seq").alias("lo"), F.upper(F.lower("seq")).alias("up"))


@query(with_("nodes") + """, p AS (SELECT a.node_id, a.seq AS l, b.seq AS r FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 1)
SELECT node_id, CAST(coalesce(max(i), 0) AS INT) AS o FROM p LEFT JOIN (SELECT unnest(range(1, 401)) AS i) ON i <= least(length(l), length(r)) AND right(l, CAST(i AS INT)) = left(r, CAST(i AS INT)) GROUP BY node_id""")
def f9_longest_overlap(spark, sf):
    n = fx.nodes(spark, sf)
    return n.select("node_id", F.col("seq").alias("l")).join(n.select((F.col("node_id") - 1).alias("node_id"), F.col("seq").alias("r")), "node_id").select("node_id", fn.longest_overlap("l", "r", 400).alias("o"))


@query(with_("alns") + "SELECT read_id, aln_id, (100 * (read_end - read_start) - 294 * edits) / 100.0::DOUBLE AS x, 1 - edits / (read_end - read_start)::DOUBLE AS id FROM alns")
def f10_scores(spark, sf):
    a = fx.alignments(spark, sf)
    span = F.col("read_end") - F.col("read_start")
    zero = F.lit(0)
    return a.select("read_id", "aln_id", fn.x_score(span, F.col("edits")).alias("x"), (1 - (1 - fn.identity(span - F.col("edits"), F.col("edits"), zero, zero))).alias("id_")).select("read_id", "aln_id", "x", (1 - (F.lit(1) - F.col("id_"))).alias("id"))


LAM, K = fn.karlin_altschul()


@query(with_("alns") + f"SELECT read_id, aln_id, round(ln({K!r}::DOUBLE * 1000000 * 1500.0::DOUBLE * exp(-{LAM!r}::DOUBLE * ((read_end - read_start) + edits * {-0.66 / 0.34 - 1!r}::DOUBLE))), 6) AS ln_e FROM alns WHERE edits < 8")
def f11_e_value(spark, sf):
    a = fx.alignments(spark, sf).where("edits < 8")
    return a.select("read_id", "aln_id", F.round(F.ln(fn.e_value(F.lit(1e6), F.lit(1500.0), F.col("read_end") - F.col("read_start"), F.col("edits"))), 6).alias("ln_e"))


@query(with_("reads") + "SELECT read_id, len FROM reads WHERE len >= 500")
def f14_min_length(spark, sf):
    return fx.reads(spark, sf).where("len >= 500").select("read_id", "len")


def on_whole(name: str, f) -> None:
    """A query over all orders, for which the recursive SQL of its namesake is too slow."""
    QUERIES[f"{name}_whole"] = lambda spark, sf: f(fx.directed(spark, sf, whole=True))


on_whole("g8_neighbors", graph.neighbors)
SQL["g8_neighbors_whole"] = SQL["g8_neighbors"].replace(" WHERE o_orderkey % 8 = 0", "")
on_whole("g11_strong_components", topology.strong_components)
on_whole("g11_component_order", lambda e: topology.component_order(e, topology.strong_components(e)))
on_whole("g12_in_cycle", lambda e: topology.in_cycle(e, topology.strong_components(e)))
on_whole("g13_tips", topology.tips)
on_whole("g14_tip_neighbors", lambda e: topology.unique_neighbors(e, topology.tips(e)))
on_whole("g15_cycle_spurs", lambda e: topology.cycle_spurs(e, topology.tips(e)))
on_whole("g16_superbubbles", lambda e: topology.superbubbles(e)[0])
on_whole("g17_bubble_insides", lambda e: topology.superbubbles(e)[1])
on_whole("g18_chains", topology.chains)


@query()
def f3_is_nucleotides_whole(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", fn.is_nucleotides(F.col("text")).alias("legal"))


@query(with_("alns") + f"SELECT read_id, aln_id, round(ln({K!r}::DOUBLE * 1000000 * 1500.0::DOUBLE * exp(-{LAM!r}::DOUBLE * ((read_end - read_start) + edits * {-0.66 / 0.34 - 1!r}::DOUBLE))), 6) AS ln_e FROM alns")
def f11_e_value_whole(spark, sf):
    a = fx.alignments(spark, sf)
    return a.select("read_id", "aln_id", F.round(F.ln(fn.e_value(F.lit(1e6), F.lit(1500.0), F.col("read_end") - F.col("read_start"), F.col("edits"))), 6).alias("ln_e"))
