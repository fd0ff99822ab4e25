"""Graph construction: ids, orientation, segments, chunks, landing edges, neighbours and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.functions.sequences import revcomp

CHUNK = 64
PART_ROWS, MOST_PARTS = 1 << 18, 4096


def assign_ids(mentions: DataFrame, start: int = 0) -> DataFrame:
    """``(name, node_id)`` from ``(name, place)``: dense ids by first appearance.

    Names are range-partitioned by place and numbered within each partition; the partitions' sizes, one row each, give
    the offsets, so no task holds all names. A null name has no id.
    """
    first = mentions.where("name is not null").groupBy("name").agg(F.min("place").alias("place"))
    parts = min(MOST_PARTS, first.count() // PART_ROWS + 1)
    bounds = sorted(set(first.approxQuantile("place", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    dealt = first.withColumn("part", F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<double>"), lambda b: b < F.col("place"))))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy("place", "name"))
    return dealt.withColumn("within", within).join(F.broadcast(before), "part").select("name", (F.col("before") + F.col("within") - 1 + start).alias("node_id"))


def orient_nodes(nodes: DataFrame) -> DataFrame:
    """Two rows for each node: id 2n forward, 2n + 1 with the reverse complement."""
    both = F.explode(F.array(F.struct((2 * F.col("node_id")).alias("onode_id"), F.lit(False).alias("is_rev"), F.upper("seq").alias("oseq")), F.struct((2 * F.col("node_id") + 1).alias("onode_id"), F.lit(True).alias("is_rev"), revcomp("seq").alias("oseq"))))
    return nodes.select("node_id", "name", both.alias("o")).select("o.onode_id", "node_id", "o.is_rev", "name", F.col("o.oseq").alias("seq"), F.length("o.oseq").alias("len"))


def orient_edges(edges: DataFrame) -> DataFrame:
    """Each edge and its mirror between oriented nodes, once; ends: True is the right end, read forward."""
    side = lambda c, end: 2 * F.col(c) + F.when(F.col(end), 0).otherwise(1)
    flip = lambda x: x.bitwiseXOR(F.lit(1))
    a, b = side("from_id", "from_end"), side("to_id", "to_end")
    pair = F.explode(F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(flip(b).alias("src"), flip(a).alias("dst"))))
    return edges.select(pair.alias("e"), "overlap").select("e.src", "e.dst", "overlap").dropDuplicates(["src", "dst", "overlap"])


def segments(onodes: DataFrame, oedges: DataFrame) -> DataFrame:
    """Pieces of oriented nodes between overlap ends: ``(onode_id, seg_off, seg_len, seq)``.

    An overlap cuts the entered node at its length, and, mirrored, the left node at the same distance from its end.
    """
    ends = onodes.select("onode_id", F.explode(F.array(F.lit(0), F.col("len"))).alias("cut"))
    entered = oedges.where("overlap > 0").select(F.col("dst").alias("onode_id"), F.col("overlap").alias("cut"))
    left = oedges.where("overlap > 0").select(F.col("src").alias("onode_id"), "overlap").join(onodes.select("onode_id", "len"), "onode_id").select("onode_id", (F.col("len") - F.col("overlap")).alias("cut"))
    cuts = ends.union(entered).union(left).distinct()
    spans = cuts.withColumn("next", F.lead("cut").over(W.partitionBy("onode_id").orderBy("cut"))).where("next is not null")
    return spans.join(onodes.select("onode_id", "seq"), "onode_id").select("onode_id", F.col("cut").alias("seg_off"), (F.col("next") - F.col("cut")).alias("seg_len"), F.expr("substring(seq, cut + 1, next - cut)").alias("seq"))


def chunks(segs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Pieces of at most ``size`` bases, cut again where plain ACGT(U) turns ambiguous or back.

    ``(onode_id, seg_off, chunk_off, chunk_len, seq, ambiguous)``; offsets count from the node's start.
    """
    parts = F.explode(F.sequence(F.lit(0), F.col("seg_len") - 1, F.lit(size)))
    cut = segs.where("seg_len > 0").withColumn("at", parts).withColumn("part", F.expr(f"substring(seq, at + 1, {size})"))
    plain = F.regexp_extract_all("part", F.lit("[ACGTU]+|[^ACGTU]+"), F.lit(0))
    runs = cut.select("onode_id", "seg_off", "at", F.posexplode(plain).alias("i", "run"))
    before = F.coalesce(F.sum(F.length("run")).over(W.partitionBy("onode_id", "seg_off", "at").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return runs.withColumn("before", before).select("onode_id", "seg_off", (F.col("seg_off") + F.col("at") + F.col("before")).cast("int").alias("chunk_off"), F.length("run").alias("chunk_len"), F.col("run").alias("seq"), F.rlike("run", F.lit("[^ACGTU]")).alias("ambiguous"))


def segment_edges(segs: DataFrame, oedges: DataFrame) -> DataFrame:
    """Edges between segments, named by (node, offset): from a node's last to where the overlap ends, and within nodes."""
    last = segs.groupBy("onode_id").agg(F.max("seg_off").alias("src_off")).withColumnRenamed("onode_id", "src")
    land = segs.select(F.col("onode_id").alias("dst"), F.col("seg_off").alias("overlap"))
    over = oedges.join(last, "src").join(land, ["dst", "overlap"]).select("src", "src_off", "dst", F.col("overlap").alias("dst_off"))
    order = W.partitionBy("onode_id").orderBy("seg_off")
    inner = segs.withColumn("next", F.lead("seg_off").over(order)).where("next is not null").select(F.col("onode_id").alias("src"), F.col("seg_off").alias("src_off"), F.col("onode_id").alias("dst"), F.col("next").alias("dst_off"))
    return over.union(inner).distinct()


def neighbors(edges: DataFrame) -> DataFrame:
    """``(node, out_degree, in_degree)`` of each node with an edge."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def locate(places: DataFrame, segs: DataFrame, bucket: int = CHUNK) -> DataFrame:
    """Adds ``seg_off`` of the segment that holds ``(onode_id, off)``: an equi-join on buckets of the offset."""
    spread = segs.select("onode_id", "seg_off", "seg_len", F.explode(F.expr(f"sequence(seg_off div {bucket}, (seg_off + seg_len - 1) div {bucket})")).alias("bucket"))
    return places.withColumn("bucket", F.expr(f"cast(off div {bucket} as bigint)")).join(spread.withColumn("bucket", F.col("bucket").cast("long")), ["onode_id", "bucket"]).where("off >= seg_off and off < seg_off + seg_len").drop("bucket", "seg_len")


def flipped(places: DataFrame, onodes: DataFrame) -> DataFrame:
    """``(onode_id, off)`` moved to the other strand."""
    return places.join(onodes.select("onode_id", "len"), "onode_id").withColumn("onode_id", F.col("onode_id").bitwiseXOR(F.lit(1))).withColumn("off", F.col("len") - F.col("off") - 1).drop("len")


def graph_size(nodes: DataFrame) -> DataFrame:
    """One row: bases, nodes, and whether all names are numbers."""
    return nodes.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bp"), F.count("*").alias("n_nodes"), F.coalesce(F.every(F.rlike("name", F.lit("^[1-9][0-9]*$"))), F.lit(True)).alias("all_numeric"))


def reassembled(parts: DataFrame) -> DataFrame:
    """A node's sequence from its chunks."""
    held = F.array_sort(F.collect_list(F.struct("chunk_off", "seq")))
    return parts.groupBy("onode_id").agg(F.array_join(F.transform(held, lambda x: x["seq"]), "").alias("seq"))


def spelled(steps: DataFrame, onodes: DataFrame, oedges: DataFrame) -> DataFrame:
    """``(path_id, seq, path_len)`` of walks ``(path_id, step, onode_id)``; each step skips its overlap with the last."""
    order = W.partitionBy("path_id").orderBy("step")
    least = oedges.groupBy("src", "dst").agg(F.min("overlap").alias("overlap"))
    walk = steps.withColumn("src", F.lag("onode_id").over(order)).join(onodes.select("onode_id", "seq"), "onode_id")
    walk = walk.join(least.withColumnRenamed("dst", "onode_id"), ["src", "onode_id"], "left").withColumn("part", F.expr("substring(seq, coalesce(overlap, 0) + 1)"))
    held = F.array_sort(F.collect_list(F.struct("step", "part")))
    return walk.groupBy("path_id").agg(F.array_join(F.transform(held, lambda x: x["part"]), "").alias("seq"), F.sum(F.length("part")).alias("path_len"))


def oriented(is_rev: Column, name: Column) -> Column:
    """A step of a path as text: > or < and the name."""
    return F.concat(F.when(is_rev, "<").otherwise(">"), name)
