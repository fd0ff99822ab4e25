"""Reads, graphs and alignments as projections of the supplied tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.operators import graph

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: str) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), dna("text").alias("seq")).withColumn("len", F.length("seq"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"), F.concat(F.lit("n"), F.col("item_id")).alias("name"), dna("text").alias("seq"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path over the nodes with overlaps of 0 to 6 bases, and skips of one node without overlap."""
    one = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("from_id"))
    both = one.select("from_id", (F.col("from_id") + 1).alias("to_id"), (F.col("from_id") % 7).cast("int").alias("overlap")).union(one.select("from_id", F.col("from_id") + 2, F.lit(0)))
    return both.join(one.select(F.col("from_id").alias("to_id")), "to_id", "left_semi").select("from_id", F.lit(True).alias("from_end"), "to_id", F.lit(True).alias("to_end"), "overlap")


def oriented(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.orient_nodes(nodes(spark, sf_dir)), graph.orient_edges(edges(spark, sf_dir))


def directed(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """A general directed graph of customers, with tips, cycles and a core; of every eighth order unless ``whole``."""
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").where(F.lit(whole) | (F.col("o_orderkey") % 8 == 0)).select("o_custkey", "o_orderkey")
    return orders.join(F.broadcast(n), F.lit(True)).selectExpr("o_custkey % n as src", "(o_orderkey * 13 + o_custkey) % n as dst").distinct()


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small graph of at most 16 nodes for each customer, by its orders: rings, bubbles in bubbles, tips, self-loops."""
    to = "o_custkey * 16 + case o_orderkey % 7 when 0 then a when 1 then (a + 2) % 7 when 2 then (a + 3) % 7 when 3 then a + 7 else (a + 1) % 7 end as dst"
    return table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "(o_orderkey div 7) % 7 as a").selectExpr("o_custkey * 16 + a as src", to).distinct()


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select("*", F.row_number().over(order).alias("aln_id"))
    rows = rows.selectExpr("l_orderkey as read_id", "aln_id", "(l_partkey * 37) % 900 as read_start", "(l_partkey * 37) % 900 + 60 + 10 * cast(l_quantity as int) as read_end", "cast(round(l_discount * 100) as int) as edits", "l_suppkey % 5 as path")
    return rows.withColumn("xscore", F.expr("(100 * (read_end - read_start) - 294 * edits) / 100.0D"))


SQL_DNA = "translate(regexp_replace(lower({}), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
SQL = {
    "reads": f"reads AS (SELECT doc_id AS read_id, {SQL_DNA.format('text')} AS seq, CAST(length({SQL_DNA.format('text')}) AS INT) AS len FROM documents)",
    "nodes": f"nodes AS (SELECT item_id AS node_id, 'n' || item_id AS name, {SQL_DNA.format('text')} AS seq FROM benchmark)",
    "edges": "edges AS (SELECT from_id, to_id, overlap FROM (SELECT item_id AS from_id, item_id + 1 AS to_id, CAST(item_id % 7 AS INT) AS overlap FROM benchmark UNION ALL SELECT item_id, item_id + 2, 0 FROM benchmark) WHERE to_id IN (SELECT item_id FROM benchmark))",
    "onodes": "onodes AS (SELECT 2 * node_id AS onode_id, node_id, false AS is_rev, name, seq, CAST(length(seq) AS INT) AS len FROM nodes UNION ALL SELECT 2 * node_id + 1, node_id, true, name, reverse(translate(seq, 'ACGT', 'TGCA')), CAST(length(seq) AS INT) FROM nodes)",
    "oedges": "oedges AS (SELECT DISTINCT src, dst, overlap FROM (SELECT 2 * from_id AS src, 2 * to_id AS dst, overlap FROM edges UNION ALL SELECT 2 * to_id + 1, 2 * from_id + 1, overlap FROM edges))",
    "directed": "directed AS (SELECT DISTINCT o_custkey % n AS src, (o_orderkey * 13 + o_custkey) % n AS dst FROM orders, (SELECT count(*) AS n FROM customer) WHERE o_orderkey % 8 = 0)",
    "knots": "knots AS (SELECT DISTINCT o_custkey * 16 + a AS src, o_custkey * 16 + CASE o_orderkey % 7 WHEN 0 THEN a WHEN 1 THEN (a + 2) % 7 WHEN 2 THEN (a + 3) % 7 WHEN 3 THEN a + 7 ELSE (a + 1) % 7 END AS dst FROM (SELECT o_custkey, o_orderkey, (o_orderkey // 7) % 7 AS a FROM orders))",
    "alns": "alns AS (SELECT *, (100 * (read_end - read_start) - 294 * edits) / 100.0::DOUBLE AS xscore FROM (SELECT l_orderkey AS read_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS aln_id, (l_partkey * 37) % 900 AS read_start, (l_partkey * 37) % 900 + 60 + 10 * CAST(l_quantity AS INT) AS read_end, CAST(round(l_discount * 100) AS INT) AS edits, l_suppkey % 5 AS path FROM lineitem))",
    "segs": """cuts AS (SELECT onode_id, 0 AS cut FROM onodes UNION SELECT onode_id, len FROM onodes UNION SELECT dst, overlap FROM oedges WHERE overlap > 0
  UNION SELECT src, len - overlap FROM oedges JOIN onodes ON onode_id = src WHERE overlap > 0),
spans AS (SELECT onode_id, cut, lead(cut) OVER (PARTITION BY onode_id ORDER BY cut) AS nxt FROM cuts),
segs AS (SELECT s.onode_id, cut AS seg_off, nxt - cut AS seg_len, substr(seq, cut + 1, nxt - cut) AS seq FROM spans s JOIN onodes o ON o.onode_id = s.onode_id WHERE nxt IS NOT NULL)""",
    "pairs": """pairs AS (SELECT a.read_id, a.aln_id, b.aln_id AS other_id, a.xscore, b.xscore AS other_score FROM alns a JOIN alns b ON a.read_id = b.read_id AND a.aln_id <> b.aln_id
  AND least(a.read_end, b.read_end) - greatest(a.read_start, b.read_start) > 0.3 * least(a.read_end - a.read_start, b.read_end - b.read_start))""",
}
NEEDS = {"onodes": ["nodes"], "oedges": ["edges"], "segs": ["nodes", "onodes", "edges", "oedges"], "pairs": ["alns"]}


def with_(*names: str, recursive: bool = False) -> str:
    """A WITH clause of these projections and of what they need."""
    order: list[str] = []
    for name in names:
        for x in [*NEEDS.get(name, []), name]:
            if x not in order:
                order.append(x)
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(SQL[x] for x in order)
