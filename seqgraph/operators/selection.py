"""Selection among the alignments of a read: ``(read_id, aln_id, read_start, read_end, edits, xscore[, path])``.

Pairs are formed within a read only, by an equi-join on the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.functions.sequences import e_value


def overlap(a: str, b: str) -> Column:
    return F.least(F.col(f"{a}.read_end"), F.col(f"{b}.read_end")) - F.greatest(F.col(f"{a}.read_start"), F.col(f"{b}.read_start"))


def incompatible(a: str, b: str, fraction: float) -> Column:
    """Whether two alignments overlap in more than a fraction of the shorter one."""
    length = lambda x: F.col(f"{x}.read_end") - F.col(f"{x}.read_start")
    return overlap(a, b) > fraction * F.least(length(a), length(b))


def incompatible_pairs(alns: DataFrame, fraction: float = 0.3) -> DataFrame:
    """``(read_id, aln_id, other_id, xscore, other_score)`` of ordered incompatible pairs."""
    one = alns.select("read_id", "aln_id", "read_start", "read_end", "xscore")
    return one.alias("a").join(one.alias("b"), (F.col("a.read_id") == F.col("b.read_id")) & (F.col("a.aln_id") != F.col("b.aln_id")) & incompatible("a", "b", fraction)).select("a.read_id", "a.aln_id", F.col("b.aln_id").alias("other_id"), "a.xscore", F.col("b.xscore").alias("other_score"))


def min_score(alns: DataFrame, least: float) -> DataFrame:
    return alns.where(F.col("xscore") >= least)


def max_e_value(alns: DataFrame, database: int, most: float, identity: float = 0.66) -> DataFrame:
    """Keeps alignments whose E-value, from ``len`` bases of read, is at most ``most``; a negative bound keeps all."""
    if most < 0:
        return alns
    return alns.where(e_value(F.lit(database).cast("double"), F.col("len").cast("double"), F.col("read_end") - F.col("read_start"), F.col("edits"), identity) <= most)


def multimap(alns: DataFrame, fraction: float = 0.9, overlap_fraction: float = 0.3) -> DataFrame:
    """Drops an alignment if an incompatible one scores so well that this is below a fraction of it."""
    one = alns.select("read_id", "aln_id", "read_start", "read_end", "xscore")
    return alns.alias("a").join(one.alias("b"), (F.col("a.read_id") == F.col("b.read_id")) & (F.col("a.aln_id") != F.col("b.aln_id")) & incompatible("a", "b", overlap_fraction) & (F.col("a.xscore") < F.col("b.xscore") * fraction), "left_anti")


def deduplicated(alns: DataFrame, *path: str) -> DataFrame:
    """Keeps the best of alignments with one read span and one ``path`` (node path and clips)."""
    order = W.partitionBy("read_id", "read_start", "read_end", *path).orderBy(F.desc("xscore"), "aln_id")
    return alns.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def mapping_quality(alns: DataFrame, overlap_fraction: float = 0.3) -> DataFrame:
    """Adds ``mapq`` from the scores of incompatible alignments: 0 to 60."""
    others = incompatible_pairs(alns, overlap_fraction).groupBy("read_id", "aln_id").agg(F.max(F.col("other_score") - F.col("xscore")).alias("lead"), F.sum(F.pow(F.lit(10.0), F.least(F.col("other_score") - F.col("xscore"), F.lit(1.0)))).alias("s"))
    raw = F.floor(10 * F.ln((1 + F.col("s")) / F.col("s")))
    mapq = F.when(F.col("s").isNull() | (F.col("s") <= 1e-6), 60).when((F.col("lead") >= 1) | (F.col("s") >= 10), 0).otherwise(F.least(raw, F.lit(60)))
    return alns.join(others, ["read_id", "aln_id"], "left").withColumn("mapq", mapq.cast("int")).drop("lead", "s")


def ranked(alns: DataFrame) -> DataFrame:
    """Adds ``rank`` within a read, best score first; ties by start, then id."""
    return alns.withColumn("rank", F.row_number().over(W.partitionBy("read_id").orderBy(F.desc("xscore"), "read_start", "aln_id")))


def select(alns: DataFrame, params, database: int | None = None) -> DataFrame:
    """Mapping qualities over all alignments, then E-value, score and multimap filters, then ranks."""
    found = mapping_quality(alns, params.incompatible_overlap)
    if database is not None:
        found = max_e_value(found, database, params.e_cutoff, params.identity)
    return ranked(multimap(min_score(found, params.min_score), params.multimap_fraction, params.incompatible_overlap))
