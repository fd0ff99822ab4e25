"""GFA and JSON graph scans, their check, and the text they are written from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.functions.sequences import is_nucleotides
from seqgraph.operators.graph import assign_ids


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty S and L lines as arrays ``v``, with ``place`` in the order of the input."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    return lines.withColumn("v", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).where("v[0] in ('S', 'L')").select("place", "v")


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(node_id, name, seq)`` and ``(from_id, from_end, to_id, to_end, overlap)`` of a GFA file, plain or gzip.

    Ids are dense by first mention. An end is True for +. Names that only links mention have an id but no node row;
    an overlap that is no ``<n>M`` is null: `check` tells of both.
    """
    rows = _lines(spark, path)
    s = rows.where("v[0] = 'S'").selectExpr("place", "v[1] as name", "v[2] as seq")
    links = rows.where("v[0] = 'L'").selectExpr("place", "v[1] as a", "v[2] = '+' as from_end", "v[3] as b", "v[4] = '+' as to_end", "cast(nullif(regexp_extract(v[5], '^([0-9]+)M$', 1), '') as int) as overlap")
    mentions = s.selectExpr("name", "place * 2 as place").union(links.selectExpr("a", "place * 2")).union(links.selectExpr("b", "place * 2 + 1"))
    ids = assign_ids(mentions)
    nodes = s.join(ids, "name").select("node_id", "name", F.upper("seq").alias("seq"))
    edges = links.join(ids.toDF("a", "from_id"), "a").join(ids.toDF("b", "to_id"), "b").select("from_id", "from_end", "to_id", "to_end", "overlap")
    return nodes, edges


VG = "node array<struct<id:bigint,sequence:string,name:string>>, edge array<struct<`from`:bigint,`to`:bigint,from_start:boolean,to_end:boolean,overlap:int>>"


def read_vg_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same tables from JSON lines of sub-graphs, which are put together; ids are the file's own."""
    graphs = spark.read.schema(VG).json(path)
    nodes = graphs.select(F.explode("node").alias("n")).select(F.col("n.id").alias("node_id"), F.coalesce(F.when(F.col("n.name") != "", F.col("n.name")), F.col("n.id").cast("string")).alias("name"), F.upper("n.sequence").alias("seq")).dropDuplicates(["node_id"])
    edges = graphs.select(F.explode("edge").alias("e")).select(F.col("e.from").alias("from_id"), (~F.coalesce("e.from_start", F.lit(False))).alias("from_end"), F.col("e.to").alias("to_id"), (~F.coalesce("e.to_end", F.lit(False))).alias("to_end"), F.coalesce("e.overlap", F.lit(0)).alias("overlap")).distinct()
    return nodes, edges


def check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(problem, name)``: a row for each violation; an empty result means a sound graph."""
    size = nodes.select("node_id", "name", F.length("seq").alias("len"))
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id"), "overlap")
    found = [
        nodes.where("seq = '*'").select(F.lit("no sequence").alias("problem"), "name"),
        nodes.where("seq <> '*'").where(~is_nucleotides("seq")).select(F.lit("illegal base"), "name"),
        edges.where("overlap is null or overlap < 0").select(F.lit("bad overlap"), F.col("from_id").cast("string")),
        ends.join(size, "node_id", "left_anti").select(F.lit("missing node"), F.col("node_id").cast("string")),
        ends.join(size, "node_id").where("overlap >= len").select(F.lit("overlap too long"), "name"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
