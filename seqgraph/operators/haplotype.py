"""Haplotype evidence in graphs of two copies, and what it forbids a read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.operators.intervals import merged

ALL = W.unboundedPreceding


def multiplicity(kmers: DataFrame) -> DataFrame:
    """``(kmer, times)``: occurrences, with 3 for 3 or more."""
    return kmers.groupBy("kmer").agg(F.least(F.count("*"), F.lit(3)).cast("int").alias("times"))


def locations(kmers: DataFrame, times: DataFrame) -> DataFrame:
    """``(kmer, onodes)`` of k-mers that occur at most twice, nodes in order."""
    return kmers.join(times.where("times <= 2"), "kmer").groupBy("kmer").agg(F.sort_array(F.collect_list("onode_id")).alias("onodes"))


def flanked(kmers: DataFrame) -> DataFrame:
    """``(onode_id, k1, k2, other, from_pos, to_pos)``: single k-mers between two k-mers that the same two nodes share.

    ``kmers`` is ``(onode_id, pos, kmer)``. A k-mer of three or more places, or one twice in a node, breaks a string; the
    k-mer that closes a string does not open the next.
    """
    times = multiplicity(kmers)
    twice = locations(kmers, times).where(F.size("onodes") == 2)
    told = kmers.join(times, "kmer").join(twice, "kmer", "left")
    other = F.when(F.element_at("onodes", 1) == F.col("onode_id"), F.element_at("onodes", 2)).otherwise(F.element_at("onodes", 1))
    told = told.withColumn("other", F.when(F.col("times") == 2, other))
    broken = (F.col("times") > 2) | (F.col("other") == F.col("onode_id"))
    told = told.withColumn("mark", F.when(broken, 2).when(F.col("times") == 2, 1).otherwise(0))
    order = W.partitionBy("onode_id").orderBy("pos")
    marks = told.withColumn("part", F.sum(F.when(F.col("mark") > 0, 1).otherwise(0)).over(order.rowsBetween(ALL, 0)))
    inside = marks.groupBy("onode_id", "part").agg(F.count(F.when(F.col("mark") == 0, 1)).alias("single"))
    flanks = marks.where("mark > 0").join(inside, ["onode_id", "part"])
    ahead = {c: F.lead(c).over(order) for c in ("mark", "kmer", "other", "pos")}
    pairs = flanks.select("onode_id", "part", "mark", "kmer", "other", "pos", "single", *(x.alias(f"next_{c}") for c, x in ahead.items()))
    pairs = pairs.withColumn("valid", F.coalesce((F.col("mark") == 1) & (F.col("next_mark") == 1) & (F.col("other") == F.col("next_other")) & (F.col("single") > 0), F.lit(False)))
    runs = pairs.withColumn("run", F.sum(F.when(F.col("valid"), 0).otherwise(1)).over(order.rowsBetween(ALL, 0))).where("valid")
    odd = runs.withColumn("n", F.row_number().over(W.partitionBy("onode_id", "run").orderBy("pos"))).where("n % 2 = 1")
    return odd.select("onode_id", F.col("kmer").alias("k1"), F.col("next_kmer").alias("k2"), "other", F.col("pos").alias("from_pos"), F.col("next_pos").alias("to_pos"))


def homologous(strings: DataFrame) -> DataFrame:
    """``(k1, k2, a, b)``: flank pairs that stand in exactly two strings, with their nodes."""
    return strings.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("onode_id").alias("a"), F.max("onode_id").alias("b")).where("n = 2").drop("n")


def informative(kmers: DataFrame, strings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(kmer, onode_id, pos)`` of the single k-mers inside homologous strings."""
    kept = strings.join(pairs.select("k1", "k2"), ["k1", "k2"], "left_semi").select(F.col("onode_id").alias("o"), "from_pos", "to_pos")
    # strings of one node do not overlap: each place has one string at most. They are joined by stretches of 64 bases
    kept = kept.withColumn("b", F.explode(F.sequence(F.floor(F.col("from_pos") / 64), F.floor(F.col("to_pos") / 64))))
    near = (F.col("onode_id") == F.col("o")) & (F.floor(F.col("pos") / 64) == F.col("b"))
    return kmers.join(kept, near & (F.col("pos") > F.col("from_pos")) & (F.col("pos") < F.col("to_pos"))).select("kmer", "onode_id", "pos").distinct()


def conflicts(pairs: DataFrame) -> DataFrame:
    """``(onode_id, other)`` in both directions."""
    one = pairs.where("a <> b")
    return one.select(F.col("a").alias("onode_id"), F.col("b").alias("other")).union(one.select("b", "a")).distinct()


def votes(read_kmers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(read_id, onode_id, diag)`` for each informative k-mer of a read."""
    return read_kmers.select("read_id", F.col("pos").alias("read_pos"), "kmer").join(evidence, "kmer").select("read_id", "onode_id", (F.col("read_pos") - F.col("pos")).cast("long").alias("diag"))


def vote_clusters(vote: DataFrame, reach: int = 100, least: int = 3) -> DataFrame:
    """``(read_id, onode_id, diag, n_votes)``: a cluster ends over ``reach`` from its first diagonal; its place is midway.

    Anchored at the first vote, so it is a fold over a read's sorted votes on one node.
    """
    held = F.sort_array(F.collect_list("diag"))
    none = F.array().cast("array<struct<first:bigint,last:bigint,n:int>>")

    def step(acc, d):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["first"].alias("first"), d.alias("last"), (last["n"] + 1).cast("int").alias("n"))
        fresh = F.array(F.struct(d.alias("first"), d.alias("last"), F.lit(1).alias("n")))
        return F.when((F.size(acc) == 0) | (d > last["first"] + reach), F.concat(acc, fresh)).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)))

    done = vote.groupBy("read_id", "onode_id").agg(held.alias("d")).select("read_id", "onode_id", F.explode(F.aggregate("d", none, step)).alias("c"))
    return done.where(F.col("c.n") >= least).select("read_id", "onode_id", F.floor((F.col("c.first") + F.col("c.last")) / 2).alias("diag"), F.col("c.n").alias("n_votes"))


def spans(clusters: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(read_id, onode_id, start, end)`` of the read that a node covers when laid along its cluster."""
    return clusters.join(lengths.select("onode_id", "len"), "onode_id").select("read_id", "onode_id", F.col("diag").alias("start"), (F.col("diag") + F.col("len")).alias("end"))


def forbidden(solid: DataFrame, conflict: DataFrame) -> DataFrame:
    """``(read_id, onode_id, start, end)``: spans of the rivals of solid nodes, unless they are solid there too."""
    rivals = solid.join(conflict, "onode_id").select("read_id", F.col("other").alias("onode_id"), "start", "end").distinct()
    own = solid.alias("s")
    both = (F.col("r.read_id") == F.col("s.read_id")) & (F.col("r.onode_id") == F.col("s.onode_id")) & (F.col("r.start") < F.col("s.end")) & (F.col("s.start") < F.col("r.end"))
    return rivals.alias("r").join(own, both, "left_anti")


def merged_spans(found: DataFrame) -> DataFrame:
    return merged(found, ["read_id", "onode_id"])


def over_all(*tables: DataFrame) -> DataFrame:
    """The union of one kind of evidence over several k."""
    return reduce(DataFrame.unionByName, tables).distinct()


def allowed_seeds(seeds: DataFrame, spans_: DataFrame, grid: int = 64) -> DataFrame:
    """Drops seeds inside a forbidden span of their node, rounded outward to the grid."""
    wide = spans_.select("read_id", "onode_id", F.greatest(F.floor(F.col("start") / grid) * grid, F.lit(0)).alias("lo"), (F.ceil(F.col("end") / grid) * grid).alias("hi"))
    inside = (F.col("s.read_id") == F.col("f.read_id")) & (F.col("s.onode_id") == F.col("f.onode_id")) & (F.col("s.read_pos") >= F.col("f.lo")) & (F.col("s.read_pos") < F.col("f.hi"))
    return seeds.alias("s").join(wide.alias("f"), inside, "left_anti")


def forbidden_slices(spans_: DataFrame, grid: int = 64) -> DataFrame:
    """``(read_id, onode_id, slice)``: whole read slices within a span, rounded inward."""
    inner = spans_.withColumn("lo", F.ceil(F.greatest(F.col("start"), F.lit(0)) / grid) * grid).withColumn("hi", F.floor(F.col("end") / grid) * grid).where("lo < hi")
    return inner.select("read_id", "onode_id", F.explode(F.sequence("lo", F.col("hi") - grid, F.lit(grid))).alias("slice")).distinct()
