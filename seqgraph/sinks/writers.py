"""Text and JSON forms of results, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gaf_lines(alns: DataFrame, cigar: bool = True) -> DataFrame:
    """Column ``value`` of 12 GAF columns and tags; AS is left out where the score is -1.

    Alignments need read_id, read_len, read_start, read_end, path, path_len, path_start, path_end, matches, block_len,
    mapq, edits, xscore and, for the cg tag, cigar. Numbers in tags have six significant digits.
    """
    share = F.col("matches") / F.col("block_len")
    short = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), "\\.$", "")
    digits = lambda c: F.when(F.abs(c) < 0.1, F.regexp_replace(F.format_string("%.7f", c), "\\.?0+$", "")).otherwise(short(c))
    tags = [F.format_string("NM:i:%d", F.col("edits").cast("int")), F.when(F.col("xscore") != -1, F.concat(F.lit("AS:f:"), short(F.col("xscore")))), F.concat(F.lit("dv:f:"), digits(1 - share)), F.concat(F.lit("id:f:"), digits(share))]
    tags += [F.concat(F.lit("cg:Z:"), "cigar")] if cigar else []
    columns = ["read_id", "read_len", "read_start", "read_end", F.lit("+"), "path", "path_len", "path_start", "path_end", "matches", "block_len", "mapq"]
    return alns.select(F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns), *tags).alias("value"))


def cigar(trace: DataFrame, split_matches: bool = True) -> DataFrame:
    """``(aln_id, cigar)`` from steps ``(aln_id, step, op)`` of =, X, I, D; without ``split_matches`` = and X are M."""
    op = F.col("op") if split_matches else F.when(F.col("op").isin("=", "X"), "M").otherwise(F.col("op"))
    order = W.partitionBy("aln_id").orderBy("step")
    runs = trace.withColumn("op", op).withColumn("opens", F.when(F.col("op") == F.lag("op").over(order), 0).otherwise(1)).withColumn("run", F.sum("opens").over(order))
    runs = runs.groupBy("aln_id", "run").agg(F.count("*").alias("n"), F.first("op").alias("op"))
    return runs.groupBy("aln_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "n", "op"))), lambda x: F.concat(x["n"].cast("string"), x["op"])), "").alias("cigar"))


def path_text(steps: DataFrame) -> DataFrame:
    """``(aln_id, path)`` such as >a<b from ``(aln_id, step, name, is_rev)``."""
    part = F.concat(F.when(F.col("is_rev"), "<").otherwise(">"), "name")
    held = F.array_sort(F.collect_list(F.struct("step", part.alias("part"))))
    return steps.groupBy("aln_id").agg(F.array_join(F.transform(held, lambda x: x["part"]), "").alias("path"))


def json_rows(alns: DataFrame, mappings: DataFrame, onodes: DataFrame) -> DataFrame:
    """Nested alignments in snake case from alignments and ``(aln_id, rank, onode_id, offset, edits)``; ranks from 1."""
    named = restored(mappings, onodes)
    position = F.struct(F.col("out_id").alias("node_id"), "offset", F.col("is_rev").alias("is_reverse"), "name")
    held = F.array_sort(F.collect_list(F.struct("rank", position.alias("position"), F.col("edits").alias("edit"))))
    paths = named.groupBy("aln_id").agg(F.transform(held, lambda m: F.struct(m["position"].alias("position"), m["edit"].alias("edit"), m["rank"].alias("rank"))).alias("mapping"))
    return alns.join(paths, "aln_id").select(F.col("read_id").alias("name"), "sequence", F.col("xscore").alias("score"), F.col("mapq").alias("mapping_quality"), F.col("read_start").alias("query_position"), (F.col("matches") / F.col("block_len")).alias("identity"), F.struct("mapping").alias("path"))


def restored(rows: DataFrame, onodes: DataFrame) -> DataFrame:
    """Adds ``name``, ``is_rev`` and ``out_id``: the number that the name is, or else the node's id."""
    number = F.when(F.rlike("name", F.lit("^[1-9][0-9]*$")), F.col("name").cast("long"))
    return rows.join(onodes.select("onode_id", "node_id", "name", "is_rev"), "onode_id").withColumn("out_id", F.coalesce(number, F.col("node_id"))).drop("node_id")


def fasta_lines(reads: DataFrame, name: str = "read_id", seq: str = "corrected") -> DataFrame:
    return reads.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))


def write_lines(lines: DataFrame, path: str, compressed: bool = False) -> None:
    lines.write.mode("overwrite").option("compression", "gzip" if compressed else "none").text(path)


def write_json(rows: DataFrame, path: str, compressed: bool = False) -> None:
    rows.write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def renumbered_gfa(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GFA lines with the nodes' ids, from 1, as names, and the ``(node, name)`` table; ids are those of first mention."""
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    one = lambda c: (F.col(c) + 1).cast("string")
    s = nodes.select(F.concat_ws("\t", F.lit("S"), one("node_id"), "seq").alias("value"))
    links = edges.select(F.concat_ws("\t", F.lit("L"), one("from_id"), sign("from_end"), one("to_id"), sign("to_end"), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    return s.union(links), nodes.select((F.col("node_id") + 1).alias("node"), "name")
