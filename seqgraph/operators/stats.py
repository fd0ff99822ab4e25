"""Run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgraph.operators.intervals import covered


def aligned_bases(alns: DataFrame) -> DataFrame:
    """``(read_id, aligned_bp)``: bases of a read under any of its alignments."""
    return covered(alns, "read_id", "read_start", "read_end", "aligned_bp")


def summary(reads: DataFrame, seeds: DataFrame, alns: DataFrame) -> DataFrame:
    """One row of totals over reads ``(read_id, len)``, seeds ``(read_id)`` and alignments.

    Each side is reduced to a row a read before the joins.
    """
    per_seed = seeds.groupBy("read_id").agg(F.count("*").alias("n_seeds"))
    whole = alns.join(reads.select("read_id", "len"), "read_id")
    full = F.when((F.col("read_start") == 0) & (F.col("read_end") == F.col("len")), 1).otherwise(0)
    span = F.col("read_end") - F.col("read_start")
    per_aln = whole.groupBy("read_id").agg(F.count("*").alias("n_alns"), F.sum(span).alias("bp_alns"), F.sum(full).alias("n_full"), F.sum(full * F.col("len")).alias("bp_full"))
    rows = reads.join(per_seed, "read_id", "left").join(per_aln, "read_id", "left").join(aligned_bases(alns), "read_id", "left").na.fill(0)
    some = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        F.count("*").alias("reads"), total("len").alias("bp_reads"), total("n_seeds").alias("seeds"), F.coalesce(some("n_seeds"), F.lit(0)).alias("reads_with_seed"),
        F.coalesce(some("n_alns"), F.lit(0)).alias("reads_with_alignment"), total("n_alns").alias("alignments"), total("bp_alns").alias("bp_alignments"), total("n_full").alias("end_to_end"), total("bp_full").alias("bp_end_to_end"), total("aligned_bp").alias("bp_reads_aligned"),
    )
