"""Clusters of seed hits on chain diagonals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP = 100
SLICE = 64


def diagonals(seeds: DataFrame, chains: DataFrame) -> DataFrame:
    """Adds ``chain`` and ``diag`` from ``(onode_id, chain, chain_pos)``; hits outside all chains are dropped."""
    return seeds.join(chains.select("onode_id", "chain", "chain_pos"), "onode_id").withColumn("diag", F.col("chain_pos") + F.col("off") - F.col("read_pos")).drop("chain_pos")


def sessions(hits: DataFrame, gap: int = GAP) -> DataFrame:
    """Adds ``session``: a new one where the diagonal rises by more than ``gap`` within a read and chain."""
    order = W.partitionBy("read_id", "chain").orderBy("diag", "read_pos", "onode_id", "off")
    opens = F.when(F.col("diag") - F.lag("diag").over(order) > gap, 1).otherwise(0)
    return hits.withColumn("opens", opens).withColumn("session", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("opens")


def large_enough(hits: DataFrame, least: int) -> DataFrame:
    """Drops hits of sessions with fewer than ``least`` hits."""
    return hits.withColumn("size", F.count("*").over(W.partitionBy("read_id", "chain", "session"))).where(F.col("size") >= least).drop("size")


def goodness(hits: DataFrame) -> DataFrame:
    """``(read_id, chain, session, goodness)``: read bases that a session covers.

    Seeds end at ``read_pos`` and count from there back to where the furthest earlier seed ends, at most their length
    less one.
    """
    order = W.partitionBy("read_id", "chain", "session").orderBy("read_pos", "match_len")
    before = F.max("read_pos").over(order.rowsBetween(W.unboundedPreceding, -1))
    begin = F.col("read_pos") - F.col("match_len") + 1
    part = F.greatest(F.col("read_pos") - F.greatest(begin, F.coalesce(before, begin)), F.lit(0))
    return hits.withColumn("part", part).groupBy("read_id", "chain", "session").agg(F.sum("part").alias("goodness"), F.min("diag").alias("diag"), F.count("*").alias("n_hits"))


def slices(hits: DataFrame, located: str = "seg_off") -> DataFrame:
    """Distinct (64-base read slice, piece of node) of each session."""
    return hits.select("read_id", "chain", "session", (F.floor(F.col("read_pos") / SLICE) * SLICE).alias("slice"), "onode_id", located).distinct()


def ranked(clusters: DataFrame, most: int) -> DataFrame:
    """Adds ``rank`` by goodness and ``cluster``: the best ``most - 1`` stand alone, the rest are the last."""
    order = W.partitionBy("read_id").orderBy(F.desc("goodness"), "chain", "diag", "session")
    return clusters.withColumn("rank", F.row_number().over(order)).withColumn("cluster", F.least("rank", F.lit(most)))


def folded(clusters: DataFrame, most: int) -> DataFrame:
    """``(read_id, cluster, goodness, n_hits)`` after the fold; a folded cluster has goodness 0."""
    found = ranked(clusters, most)
    alone = F.count("*") == 1
    return found.groupBy("read_id", "cluster").agg(F.when(alone, F.max("goodness")).otherwise(0).alias("goodness"), F.sum("n_hits").alias("n_hits"))
