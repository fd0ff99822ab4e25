"""The whole plan from reads and graph to selected alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.functions.sequences import hpc_collapse
from seqgraph.operators import clustering, correction, extension, graph, haplotype, seeding, selection, topology
from seqgraph.params import AlignParams
from seqgraph.sinks import writers
from seqgraph.sources import seeds as seeds_kept


def chain_table(onodes: DataFrame, oedges: DataFrame) -> DataFrame:
    """``(onode_id, chain, chain_pos)``; a graph without edges has a chain for each node."""
    own = onodes.select(F.col("onode_id").alias("src"), F.col("onode_id").alias("dst"))
    plain = oedges.select("src", "dst")
    chain = topology.chains(plain) if plain.head(1) else own.limit(0).toDF("node", "chain")
    chain = chain.union(own.select("src", "dst").join(chain.select(F.col("node").alias("src")), "src", "left_anti"))
    place = topology.chain_positions(plain, chain, onodes.select(F.col("onode_id").alias("node"), "len"))
    return place.select(F.col("node").alias("onode_id"), "chain", "chain_pos")


def seeds(reads: DataFrame, onodes: DataFrame, oedges: DataFrame, params: AlignParams, external: DataFrame | None = None) -> DataFrame:
    """``(read_id, onode_id, off, read_pos, match_len, goodness)`` with end places, by the chosen method.

    Minimizers that the node before holds too are looked up there only. Alignments of an earlier run are realigned by
    giving their places (`read_gaf_seeds`) as ``external`` seeds.
    """
    if params.seeding == "minimizer":
        index = seeding.skip_shared(seeding.kmer_index(onodes, params.k, params.w), oedges)
        return seeding.seed_hits(reads, onodes, params.k, params.w, params.density, params.ignore_frequent, index)
    if params.seeding in ("mem", "mum"):
        found = seeding.mems(reads, onodes, params.mxm_length)
        found = seeding.mums(found, reads) if params.seeding == "mum" else found
        if params.mxm_count > 0:
            found = seeding.longest(seeding.uniqueness(found, reads, params.unique_bonus) if params.unique_bonus != 1 else found, params.mxm_count, params.mxm_window)
    elif params.seeding == "file" and external is not None:
        found = seeding.external_seeds(reads, external).select("read_id", (2 * F.col("node_id") + F.when(F.col("is_rev"), 1).otherwise(0)).alias("onode_id"), "off", "read_pos", "match_len").where("match_len > 0")
    else:
        raise ValueError("seeds of this kind cannot be made")
    last = F.col("match_len") - 1
    return found.select("read_id", "onode_id", (F.col("off") + last).alias("off"), (F.col("read_pos") + last).alias("read_pos"), "match_len", F.col("match_len").alias("goodness"))


def anchors(hits: DataFrame, onodes: DataFrame, reads: DataFrame, params: AlignParams) -> DataFrame:
    """One anchor for each cluster of a read: of the longest hits one of the diagonal of a node that holds most of them,
    the best and most central one. So of two ways through a bubble the one with more hits has the anchor."""
    found = clustering.large_enough(clustering.sessions(hits), params.min_cluster_size)
    ranks = clustering.ranked(clustering.goodness(found), params.max_clusters).where("rank = cluster").select("read_id", "chain", "session", "cluster")
    keys = ["read_id", "chain", "session"]
    mid = F.abs(F.col("read_pos") - F.avg("read_pos").over(W.partitionBy(*keys)))
    held = F.count("*").over(W.partitionBy(*keys, "onode_id", F.col("off") - F.col("read_pos")))
    order = W.partitionBy(*keys).orderBy(F.desc("match_len"), F.desc("held"), F.desc("goodness"), "mid", "read_pos", "onode_id", "off")
    one = found.join(ranks, keys).withColumn("mid", mid).withColumn("held", held).withColumn("r", F.row_number().over(order)).where("r = 1")
    one = one.select(F.concat_ws(":", "read_id", "cluster").alias("aln_id"), "read_id", "cluster", "onode_id", (F.col("off") - F.col("match_len") + 1).alias("off"), (F.col("read_pos") - F.col("match_len") + 1).alias("read_pos"), "match_len")
    return one.join(onodes.select("onode_id", F.col("len").alias("onode_len")), "onode_id").join(reads.select("read_id", "seq"), "read_id")


def traced(anchor: DataFrame, onodes: DataFrame, oedges: DataFrame, params: AlignParams, closed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Alignments of both sides of each anchor, cleaned and clipped, one for each place of a read and the graph.

    Anchors with a ``cluster`` give up to ``max_traces`` ends a slice of a side, where those could be alignments as well.
    """
    several = "cluster" in anchor.columns
    ends, entries, queries = extension.explored(extension.anchor_starts(anchor), onodes, oedges, params, closed, params.multimap_fraction if several else 1.0)
    if several:
        side = lambda s, shift: anchor.select("aln_id", F.lit(s).alias("side"), "read_id", "cluster", shift.cast("long").alias("shift"), F.lit(s == extension.FORWARD).alias("ahead"))
        clusters = side(extension.FORWARD, F.col("read_pos") + F.col("match_len")).union(side(extension.BACKWARD, F.col("read_pos")))
        chosen = extension.end_points(saved(ends, "cells"), oedges, clusters, params.max_traces, params.multimap_fraction)
    else:
        chosen = extension.best_ends(ends)
    sides = saved(extension.traced_ends(saved(chosen, "ends"), entries, queries, onodes), "sides")
    sides, anchor = extension.variants(sides, anchor)
    found = saved(extension.cancelled(extension.merged(sides, anchor, onodes, params.identity), params.identity), "merged")
    if params.clip_ambiguous >= 0:
        sure = extension.ambiguous_end(found, params.clip_ambiguous).where("sure_steps > 0")
        found = saved(extension.trimmed(sure, onodes, oedges, params.identity, F.lit(0), F.col("sure_steps")).drop("sure_steps"), "merged")
    start = saved(extension.start_clip(found, params.identity), "clip")
    clipped = extension.trimmed(start.where("clip_steps > 0"), onodes, oedges, params.identity, F.col("clip_steps"), F.length("ops"))
    found = start.where("clip_steps = 0").unionByName(clipped).drop("clip_steps")
    found = saved(extension.distinct_starts(extension.normalised_ends(found, onodes, oedges)), "found")
    return selection.deduplicated(found, "path", "path_start", "path_end_off")


def align(reads: DataFrame, nodes: DataFrame, edges: DataFrame, params: AlignParams, external: DataFrame | None = None) -> DataFrame:
    """Selected alignments of ``(read_id, seq, len)`` to a graph, with all columns of a GAF line and rank and ops.

    Seedless alignments start near the read's first base, and with ``restart_stride`` again so many bases behind each
    alignment or failed try; they have no mapping quality, which stays 255.
    """
    params = params.checked()
    onodes, oedges = saved(graph.orient_nodes(nodes), "onodes"), saved(graph.orient_edges(edges), "oedges")
    reads = reads.select("read_id", F.upper("seq").alias("seq"))
    reads = reads.withColumn("seq", hpc_collapse("seq")) if params.hpc_reads else reads
    reads = saved(reads.withColumn("len", F.length("seq")).where(F.col("len") >= max(1, params.min_score)), "reads")
    if params.seeding == "seedless":
        found = free_alignments(reads, onodes, oedges, params)
        kept = selection.ranked(selection.min_score(found, params.min_score).withColumn("mapq", F.lit(255)))
        kept = kept.where(F.col("rank") <= params.max_traces)
    else:
        hits = saved(clustering.diagonals(seeds(reads, onodes, oedges, params, external), chain_table(onodes, oedges)), "hits")
        spans = saved(diploid_spans(reads, onodes, params), "spans") if params.diploid_k else None
        if spans is not None:
            hits = saved(haplotype.allowed_seeds(hits, spans), "hits")
        anchor = saved(anchors(hits, onodes, reads, params), "anchors")
        closed = None
        if spans is not None:
            side = lambda s, shift: anchor.select("aln_id", F.lit(s).alias("side"), "read_id", shift.cast("long").alias("shift"))
            closed = (saved(haplotype.forbidden_slices(spans), "slices"), side(extension.FORWARD, F.col("read_pos") + F.col("match_len")).union(side(extension.BACKWARD, F.col("read_pos"))))
        found = traced(anchor, onodes, oedges, params, closed)
        kept = selection.select(found.join(reads.select("read_id", "len"), "read_id"), params, nodes.agg(F.sum(F.length("seq"))).first()[0] or 0).drop("len")
    told = extension.described(kept, reads, onodes, oedges)
    return told.join(writers.cigar(extension.trace(kept), params.cigar_match_mismatch), "aln_id", "left")


def free_alignments(reads: DataFrame, onodes: DataFrame, oedges: DataFrame, params: AlignParams) -> DataFrame:
    """Alignments from near the first base of each read and, round by round, from the restart points of what they leave.

    What lies before a point that was tried counts as covered, so each round moves on by a stride at least.
    """
    found = traced(saved(extension.free_anchors(reads, onodes), "anchors"), onodes, oedges, params)
    spans = found.select("read_id", "read_start", "read_end").toDF("read_id", "start", "end").union(reads.selectExpr("read_id", "0l", "0l"))
    while params.restart_stride > 0:
        points = saved(extension.restarts(reads, spans, params.restart_stride), "points")
        if not points.head(1):
            break
        anchor = saved(extension.free_anchors(reads, onodes, points=points.select("read_id", "point")), "anchors")
        more = traced(anchor, onodes, oedges, params)
        found = found.unionByName(more)
        tried = points.select("read_id", "start", F.col("point").cast("long").alias("end"))
        spans = saved(spans.union(tried).union(more.select("read_id", "read_start", "read_end")), "spans")
    return found


def evidence(onodes: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Informative k-mers and conflicts of nodes for one k."""
    node = seeding.syncmers(onodes, "onode_id", k)
    strings = saved(haplotype.flanked(node), "strings")
    pairs = saved(haplotype.homologous(strings), "pairs")
    return haplotype.informative(node, strings, pairs), haplotype.conflicts(pairs)


def kept_evidence(onodes: DataFrame, params: AlignParams) -> list[tuple[int, DataFrame, DataFrame]]:
    """The evidence of each ``diploid_k``; with ``diploid_cache``, what that folder holds of this graph is not made again."""
    if not params.diploid_cache:
        return [(k, *evidence(onodes, k)) for k in params.diploid_k]
    out, mark = [], seeds_kept.fingerprint(onodes)
    for k in params.diploid_k:
        found = seeds_kept.read_evidence(onodes.sparkSession, params.diploid_cache, k, mark)
        if found is None:
            seeds_kept.write_evidence(*evidence(onodes, k), params.diploid_cache, k, mark)
            found = seeds_kept.read_evidence(onodes.sparkSession, params.diploid_cache, k, mark)
        out.append((k, *found))
    return out


def diploid_spans(reads: DataFrame, onodes: DataFrame, params: AlignParams) -> DataFrame:
    """Spans that haplotype evidence over all ``diploid_k`` forbids."""
    parts = []
    for k, informative, conflicts in kept_evidence(onodes, params):
        clusters = haplotype.vote_clusters(haplotype.votes(seeding.syncmers(reads, "read_id", k), informative))
        parts.append(haplotype.forbidden(haplotype.spans(clusters, onodes), conflicts))
    return haplotype.merged_spans(haplotype.over_all(*parts))


def gaf(alns: DataFrame, cigar: bool = True) -> DataFrame:
    return writers.gaf_lines(alns.withColumn("path", F.col("path_text")), cigar)


def corrected_reads(reads: DataFrame, alns: DataFrame) -> DataFrame:
    return correction.patched(reads, extension.corrected(alns))
