"""Unbranched paths taken at once: list ranking by doubling, and graphs made smaller by it.

A path of a million nodes takes twenty rounds. `reduced` replaces each unbranched path by its first node and each node
with one edge in and one out by an edge, again and again, so that chains of bubbles shrink too; what was found on the small
graph is then carried back layer by layer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgraph.checkpoints import forget, saved


def list_ranks(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, end, n, d)`` of elements that lead to an end, and ``(node, low)`` of rings with their smallest element.

    ``links`` is ``(node, to, d)`` with one row an element, ``to`` null at ends; n counts the links and d sums theirs. Each
    round lets an element point to where the one it points to does, so it doubles the way.
    """
    start = links.select("node", F.coalesce("to", F.col("node")).alias("end"), F.col("to").isNotNull().cast("long").alias("n"), F.when(F.col("to").isNotNull(), F.col("d")).otherwise(0).alias("d"), F.col("node").alias("low"), F.col("to").isNull().alias("over"))
    now = saved(start, "ranks")
    most, open_ = now.count(), now.where("not over").count()
    rounds = max(1, most - 1).bit_length() + 1
    for _ in range(rounds):
        if not open_:
            break
        next_ = now.select(F.col("node").alias("end"), F.col("end").alias("to"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("low").alias("low2"), F.col("over").alias("over2"))
        step = now.where("not over").join(next_, "end").select("node", F.col("to").alias("end"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"), F.least("low", "low2").alias("low"), F.col("over2").alias("over"))
        last, now = now, saved(now.where("over").union(step), "ranks")
        forget(last)
        open_ = now.where("not over").count()
    return now.where("over").select("node", "end", "n", "d"), now.where("not over").select("node", "low")


@dataclass
class Layer:
    """One reduction: ``groups`` is ``(node, head, d)``, ``passed`` is ``(node, before, behind, d)`` over heads."""

    groups: DataFrame
    passed: DataFrame


def contracted(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, head, d)`` and the edges between heads ``(src, dst, d)``; a ring becomes its smallest node with an edge to itself.

    An edge belongs to a path where it is the only one out of its source and the only one into its end. d is the way
    from the head to a node; that of an edge between heads includes the way to the edge.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("outs"))
    into = edges.groupBy("dst").agg(F.count("*").alias("ins"))
    told = saved(edges.join(out, "src").join(into, "dst").withColumn("inner", F.expr("outs = 1 and ins = 1 and src <> dst")).select("src", "dst", "d", "inner"), "contract")
    links = nodes.join(told.where("inner").select(F.col("dst").alias("node"), F.col("src").alias("to"), "d"), "node", "left")
    ranks, rings = list_ranks(links)
    groups = saved(ranks.select("node", F.col("end").alias("head"), "d").union(rings.select("node", F.col("low").alias("head"), F.lit(0).cast("long"))), "groups")
    between = told.where("not inner").join(groups.select(F.col("node").alias("src"), "head", F.col("d").alias("way")), "src").select(F.col("head").alias("src"), "dst", (F.col("d") + F.col("way")).alias("d"))
    loops = rings.select(F.col("low").alias("src"), F.col("low").alias("dst")).distinct().withColumn("d", F.lit(1).cast("long"))
    return groups, between.union(loops)


def reduced(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, list[Layer]]:
    """The small graph ``(src, dst, d)``, its nodes and the layers that lead back; of edges side by side the longest d stays."""
    now, names, layers = saved(edges.select("src", "dst", "d"), "reduced"), nodes.select("node"), []
    count = now.count()
    while count:
        groups, between = contracted(now, names)
        between = saved(between.groupBy("src", "dst").agg(F.max("d").alias("d")), "reduced")
        one_in = between.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k"), F.min("src").alias("before"), F.min("d").alias("d")).where("k = 1 and before <> node").drop("k")
        one_out = between.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"), F.min("dst").alias("behind"), F.min("d").alias("e")).where("k = 1 and behind <> node").drop("k")
        # neighbours of such a node have several edges on its side, so none of them is passed in the same round
        passed = saved(one_in.join(one_out, "node"), "passed")
        gone = passed.select("node")
        rest = between.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "d")
        over = passed.select(F.col("before").alias("src"), F.col("behind").alias("dst"), (F.col("d") + F.col("e")).alias("d"))
        layers.append(Layer(groups, passed.select("node", "before", "behind", "d")))
        now = saved(rest.union(over).groupBy("src", "dst").agg(F.max("d").alias("d")), "reduced")
        names = groups.select(F.col("head").alias("node")).distinct().join(gone, "node", "left_anti")
        last, count = count, now.count()
        if count > 0.75 * last:
            break
    return now, names, layers
