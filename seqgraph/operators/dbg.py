"""K-mer spectrum and compacted de Bruijn graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.functions.sequences import revcomp
from seqgraph.operators.seeding import BLOCK, _blocks, acgt_runs


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """Column ``kmer`` of all k-mers without ambiguous bases."""
    blocks = _blocks(acgt_runs(reads.select("seq")), k, 0, k - 1)
    places = F.when(F.length("block") >= k, F.sequence(F.lit(1), F.length("block") - k + 1)).otherwise(F.array().cast("array<int>"))
    return blocks.withColumn("i", F.explode_outer(places)).where(f"i is not null and i <= {BLOCK}").select(F.expr(f"substring(block, i, {k})").alias("kmer"))


def spectrum(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """``(kmer, n)`` of canonical k-mers, the smaller of both strands, seen ``least`` times or more."""
    return kmers(reads, k).select(F.least("kmer", revcomp("kmer")).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def unitigs(solid: DataFrame, k: int, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node_id, name, seq)`` and edges of the compacted graph of canonical k-mers; edges overlap by k - 1.

    Both strands of each k-mer are linked where one is the only way on and the other the only way in. Paths are joined
    by pointer doubling: each k-mer's jump ahead doubles in a round, so rounds grow with the logarithm of a path. A
    unitig is told once, as the smaller of its strands; a circle once, from the smallest k-mer of both its strands on.
    """
    both = saved(solid.select("kmer").union(solid.select(revcomp("kmer"))).distinct(), "dbg")
    ends = both.select("kmer", F.expr(f"right(kmer, {k - 1})").alias("e"))
    begins = both.select(F.col("kmer").alias("next"), F.expr(f"left(kmer, {k - 1})").alias("e"))
    step = saved(ends.join(begins, "e").select("kmer", "next"), "dbg")
    out1 = step.groupBy("kmer").agg(F.count("*").alias("o")).where("o = 1").drop("o")
    in1 = step.groupBy("next").agg(F.count("*").alias("i")).where("i = 1").drop("i")
    simple = step.join(out1, "kmer", "left_semi").join(in1, "next", "left_semi").where(F.col("kmer") != F.col("next")).where(F.col("next") != revcomp("kmer")).select("kmer", "next")
    back = saved(simple.select(F.col("next").alias("kmer"), F.col("kmer").alias("prev")), "dbg")
    # (kmer, jump, dist, low): how far back the jump goes and the least k-mer on its way
    now = saved(both.join(back, "kmer", "left").select("kmer", F.coalesce("prev", "kmer").alias("jump"), F.when(F.col("prev").isNull(), 0).otherwise(1).alias("dist"), F.least("kmer", F.coalesce("prev", "kmer")).alias("low")), "dbg")
    mark = None
    for _ in range(max_rounds):
        ahead = now.select(F.col("kmer").alias("jump"), F.col("jump").alias("to"), F.col("dist").alias("more"), F.col("low").alias("low2"))
        nxt = saved(now.join(ahead, "jump").select("kmer", F.col("to").alias("jump"), (F.col("dist").cast("decimal(38,0)") + F.col("more")).cast("decimal(38,0)").alias("dist"), F.least("low", "low2").alias("low")), "dbg")
        open_ = nxt.join(back.select(F.col("kmer").alias("jump")), "jump", "left_semi")
        lows = open_.agg(F.count("*"), F.sum(F.xxhash64("low").cast("decimal(38,0)"))).first()
        done, mark, now = lows == mark, lows, nxt  # what stays open are circles, whose least k-mer is settled
        if lows[0] == 0 or done:
            break
    circle = now.join(back.select(F.col("kmer").alias("jump")), "jump", "left_semi").select("kmer", F.col("low").alias("head"))
    line = now.join(back.select(F.col("kmer").alias("jump")), "jump", "left_anti").select("kmer", F.col("jump").alias("head"), F.col("dist").cast("long").alias("dist"))
    if circle.head(1):
        # cut a circle before its least k-mer and measure again
        cut = back.join(circle.where("kmer = head").select("kmer"), "kmer", "left_anti").join(circle.select("kmer"), "kmer", "left_semi")
        ring = saved(circle.join(cut, "kmer", "left").select("kmer", "head", F.coalesce("prev", "kmer").alias("jump"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("dist")), "dbg")
        while ring.where("jump <> head").head(1):
            ahead = ring.select(F.col("kmer").alias("jump"), F.col("jump").alias("to"), F.col("dist").alias("more"))
            ring = saved(ring.join(ahead, "jump").select("kmer", "head", F.col("to").alias("jump"), (F.col("dist") + F.col("more")).alias("dist")), "dbg")
        # the other strand runs through the head's complement: of the two circles the one with the smaller head is told
        other = circle.where("kmer = head").select("head", revcomp("head").alias("kmer")).join(circle.select("kmer", F.col("head").alias("other")), "kmer")
        line = line.union(ring.join(other.where("head <= other").select("head"), "head", "left_semi").select("kmer", "head", "dist"))
    held = F.array_sort(F.collect_list(F.struct("dist", F.expr(f"substring(kmer, {k})").alias("c"))))
    tail = line.groupBy("head").agg(F.concat(F.expr(f"left(head, {k - 1})"), F.array_join(F.transform(held, lambda x: x["c"]), "")).alias("seq"))
    tail = saved(tail.select(F.least("seq", revcomp("seq")).alias("seq")).distinct(), "dbg")
    nodes = tail.select(F.xxhash64("seq").alias("node_id"), "seq").select("node_id", F.col("node_id").cast("string").alias("name"), "seq")
    sides = nodes.select("node_id", F.explode(F.array(F.struct(F.lit(True).alias("fwd"), F.col("seq").alias("s")), F.struct(F.lit(False).alias("fwd"), revcomp("seq").alias("s")))).alias("o")).select("node_id", "o.fwd", "o.s")
    left = sides.select(F.col("node_id").alias("from_id"), F.col("fwd").alias("from_end"), F.expr(f"right(s, {k - 1})").alias("e"))
    right = sides.select(F.col("node_id").alias("to_id"), F.col("fwd").alias("to_end"), F.expr(f"left(s, {k - 1})").alias("e"))
    edges = left.join(right, "e").select("from_id", "from_end", "to_id", "to_end", F.lit(k - 1).alias("overlap"))
    return nodes, edges
