"""Seeding: k-mers, minimizers, syncmers, the index, lookups, budgets and exact matches.

K-mers and minimizers are computed within a row, over stretches or blocks of a sequence that overlap by one window, so they
need no shuffle; the first exchange is that of the lookup join, by k-mer. For syncmers and spectra a run is cut in chunks in
one pass and these in blocks, so the cost of a long sequence grows with its length.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqgraph.checkpoints import saved
from seqgraph.functions.sequences import unsigned_order
from seqgraph.operators import words

BLOCK = 256
CHUNK = 1 << 13
ALL = W.unboundedPreceding


def acgt_runs(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds ``run_off`` and ``run`` for each maximal run of ACGT; sequences without one give no row."""
    rest = [c for c in seqs.columns if c != seq]
    return seqs.select(*rest, F.col(seq).alias("seq")).mapInArrow(words.runs, _with(seqs.select(*rest), run_off="int", run="string"))


def _with(seqs: DataFrame, **columns: str) -> T.StructType:
    """The schema of these rows without their sequence, and of columns beside it."""
    rest = [T.StructField(f.name, f.dataType) for f in seqs.schema if f.name != "seq"]
    return T.StructType([*rest, *T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))])


def _chunks(runs: DataFrame, least: int, left: int, right: int) -> DataFrame:
    """``c_at``, ``own`` and ``text`` of each chunk of a run: its place, its bases, and these with margins."""
    rest = [c for c in runs.columns if c != "run"]
    parts = runs.where(F.length("run") >= least).select(*rest, F.regexp_extract_all("run", F.lit(f".{{1,{CHUNK}}}"), F.lit(0)).alias("parts"))
    side = lambda i: F.coalesce(F.get("parts", i), F.lit(""))
    whole = F.transform("parts", lambda x, i: F.struct((i * CHUNK).alias("c_at"), x.alias("own"), F.concat(F.right(side(i - 1), F.lit(left)) if left else F.lit(""), x, F.left(side(i + 1), F.lit(right)) if right else F.lit("")).alias("text")))
    return parts.select(*rest, F.explode_outer(whole).alias("c")).where("c is not null").select(*rest, "c.*")


def _blocks(runs: DataFrame, least: int, left: int, right: int) -> DataFrame:
    """Adds ``at`` (place of the block's first own base in the run), ``from_`` and ``block``, which has margins; margins are
    shorter than a chunk."""
    rest = [c for c in runs.columns if c != "run"]
    chunk = _chunks(runs, least, left, right)
    from_ = lambda a: F.greatest(F.col("c_at") + a - left, F.lit(0))
    margin = F.least(F.lit(left), F.col("c_at"))
    one = lambda a: F.struct((F.col("c_at") + a).alias("at"), from_(a).alias("from_"), F.substring("text", (from_(a) - F.col("c_at") + margin + 1).cast("int"), (F.col("c_at") + a - from_(a) + BLOCK + right).cast("int")).alias("block"))
    cut = F.transform(F.sequence(F.lit(0), F.length("own") - 1, F.lit(BLOCK)), one)
    return chunk.select(*rest, F.explode_outer(cut).alias("b")).where("b is not null").select(*rest, "b.*")


def spread(seqs: DataFrame, key: str) -> DataFrame:
    """Deals rows by key where a scan of few row groups would leave most cores idle; large scans stay as they are."""
    if seqs.isStreaming or seqs.rdd.getNumPartitions() >= seqs.sparkSession.sparkContext.defaultParallelism:
        return seqs
    return seqs.repartition(seqs.sparkSession.sparkContext.defaultParallelism, key)


def _codes(k: int) -> Column:
    """Codes of all k-mers of ``block``."""
    places = F.when(F.length("block") >= k, F.sequence(F.lit(1), F.length("block") - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.translate(F.substring("block", i, F.lit(k)), "ACGT", "0123"), 4, 10).cast("long"))


def _hashed(codes: Column) -> Column:
    """`mix_hash` of each code, in unsigned order; a lambda for each step, so no step is computed twice."""
    from seqgraph.functions.sequences import wrap_add

    xor = lambda n: lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, n))
    add = lambda n: lambda x: wrap_add(x, F.shiftleft(x, n))
    twice = lambda n, m: lambda a: F.transform(F.transform(a, lambda x: F.struct(x.alias("x"), wrap_add(x, F.shiftleft(x, n)).alias("y"))), lambda p: wrap_add(p["y"], F.shiftleft(p["x"], m)))
    # fixed values: the shifts of this hash
    h = F.transform(codes, lambda x: wrap_add(F.bitwise_not(x), F.shiftleft(x, 21)))
    h = twice(3, 8)(F.transform(h, xor(24)))
    h = twice(2, 4)(F.transform(h, xor(14)))
    return F.transform(F.transform(F.transform(h, xor(28)), add(31)), unsigned_order)


def minimizers(seqs: DataFrame, key: str, k: int, w: int) -> DataFrame:
    """``(key, pos, kmer)``: each k-mer with the least hash of some full window of w bases; ties are all kept.

    ``pos`` is the end index of the k-mer in the sequence. Runs of ACGT shorter than w give none.
    """
    rows = spread(seqs.select(key, "seq"), key)
    return rows.mapInArrow(partial(words.minimizers, k=k, w=w), _with(rows, pos="long", kmer="long"))


def read_kmers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """``(read_id, pos, kmer)``: all k-mers, of equal neighbours only each (w - k + 1)-th; ``pos`` is the end index.

    Equal neighbours exist only within runs of one base, whose length before the place gives the count.
    """
    rows = spread(reads.select("read_id", "seq"), "read_id")
    return rows.mapInArrow(partial(words.kmers, k=k, every=w - k + 1), _with(rows, pos="long", kmer="long"))


def syncmers(seqs: DataFrame, key: str, k: int, s: int = 5) -> DataFrame:
    """``(key, pos, kmer)``: k-mers whose leftmost least s-mer is their first or last; ``pos`` is the start index."""
    blocks = _blocks(acgt_runs(seqs.select(key, "seq")), k, 0, k - 1).where(F.length("block") >= k).withColumn("h", _hashed(_codes(s)))
    window = lambda i: F.slice("h", i + 1, k - s + 1)
    chosen = F.filter(F.sequence(F.lit(0), F.size("h") - (k - s + 1)), lambda i: F.array_position(window(i), F.array_min(window(i))).isin(1, k - s + 1))
    out = blocks.withColumn("i", F.explode_outer(chosen)).where(f"i is not null and i < {BLOCK}")
    return out.select(key, (F.col("run_off") + F.col("at") + F.col("i")).cast("long").alias("pos"), F.expr(f"substring(block, i + 1, {k})").alias("kmer"))


def kmer_index(onodes: DataFrame, k: int, w: int) -> DataFrame:
    """``(kmer, onode_id, off)`` of the minimizers of both orientations."""
    return minimizers(onodes, "onode_id", k, w).select("kmer", "onode_id", F.col("pos").alias("off"))


def skip_shared(index: DataFrame, oedges: DataFrame) -> DataFrame:
    """Drops places that lie within the longest overlap into their node: the node before holds them too."""
    covered = oedges.groupBy(F.col("dst").alias("onode_id")).agg(F.max("overlap").alias("covered"))
    return index.join(covered, "onode_id", "left").where("covered is null or off >= covered").drop("covered")


def frequency_cutoff(index: DataFrame, ignore: float) -> DataFrame:
    """One row ``(cutoff)``: the count at place floor(n (1 - ignore)) of the sorted counts of the n k-mers.

    From a histogram of counts, which has few rows. An empty index, or a place past the end, gives a null: no cutoff.
    """
    counts = index.groupBy("kmer").agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("upto", F.sum("n").over(W.orderBy("c").rowsBetween(ALL, 0))).withColumn("total", F.sum("n").over(W.partitionBy()))
    return ranked.where(F.col("upto") > F.floor(F.col("total") * F.lit(1 - ignore))).agg(F.min("c").alias("cutoff"))


def without_frequent(index: DataFrame, ignore: float) -> DataFrame:
    """Adds ``freq``, the number of places of a k-mer, and drops k-mers over the cutoff."""
    counts = index.groupBy("kmer").agg(F.count("*").alias("freq"))
    (cutoff,) = frequency_cutoff(index, ignore).first()
    kept = counts if cutoff is None else counts.where(F.col("freq") <= cutoff)
    return index.join(kept, "kmer")


def lookup(kmers: DataFrame, index: DataFrame) -> DataFrame:
    """Places in the graph of each read k-mer."""
    return kmers.join(index, "kmer")


def within_budget(reads: DataFrame, kmers: DataFrame, index: DataFrame, density: float) -> DataFrame:
    """Read k-mers with ``freq``, rarest first with ties, while the hits of rarer ones stay under floor(len * density).

    A negative density keeps all.
    """
    freq = index.groupBy("kmer").agg(F.count("*").alias("freq"))
    known = kmers.join(freq, "kmer")
    if density < 0:
        return known
    rarer = F.sum("freq").over(W.partitionBy("read_id").orderBy("freq").rangeBetween(ALL, -1))
    limits = reads.select("read_id", F.floor(F.length("seq") * F.lit(density)).alias("budget"))
    return known.withColumn("rarer", F.coalesce(rarer, F.lit(0))).join(limits, "read_id").where("rarer < budget").drop("rarer", "budget")


def seed_hits(reads: DataFrame, onodes: DataFrame, k: int, w: int, density: float, ignore: float, index: DataFrame | None = None) -> DataFrame:
    """``(read_id, onode_id, off, read_pos, match_len, goodness)`` of minimizer seeding; places are end indices."""
    index = kmer_index(onodes, k, w) if index is None else index
    index = without_frequent(index, ignore)
    chosen = within_budget(reads, read_kmers(reads, k, w), index.drop("freq"), density)
    hits = chosen.join(index.drop("freq"), "kmer")
    top = F.max("freq").over(W.partitionBy("read_id"))
    return hits.withColumn("goodness", top - F.col("freq")).select("read_id", "onode_id", "off", F.col("pos").alias("read_pos"), F.lit(k).alias("match_len"), "goodness")


def usable(index: DataFrame) -> bool:
    return bool(index.head(1))


def mems(reads: DataFrame, onodes: DataFrame, least: int) -> DataFrame:
    """``(read_id, onode_id, read_pos, off, match_len)``: exact matches of ``least`` bases or more that extend no further.

    Start indices. A match begins where l-mers are equal and the bases before them are not (or there is none), and ends
    likewise; both are equi-joins on the l-mer and that base, whose rows are the matches' own ends, however often an l-mer
    is repeated. On one diagonal the n-th begin goes with the n-th end. Before the joins a filter of fixed size drops
    l-mers of reads that the graph does not hold.
    """
    read, node = spread(reads.select("read_id", "seq"), "read_id"), onodes.select("onode_id", "seq")
    held = node.mapInArrow(partial(words.slots, k=least), "word long, bits long").groupBy("word").agg(F.bit_or("bits")).collect()
    cut = partial(words.filtered, k=least, bits=words.filter_of([tuple(r) for r in held]))
    lmers = {"p": "int", "lmer": "string", "before": "string", "behind": "string"}
    near = saved(read.mapInArrow(cut, _with(read, **lmers)), "lmers").withColumnRenamed("p", "read_pos")
    nodes = saved(node.mapInArrow(cut, _with(node, **lmers)), "lmers").withColumnRenamed("p", "off")

    def ends(side: str) -> DataFrame:
        others = F.filter(F.array(*map(F.lit, ("A", "C", "G", "T", ""))), lambda x: (x != F.col(side)) | (x == ""))
        read = near.select("read_id", "read_pos", "lmer", F.col(side).alias("base"))
        node = nodes.select("onode_id", "off", "lmer", F.explode(others).alias("base"))
        met = read.join(node, ["lmer", "base"]).select("read_id", "onode_id", "read_pos", "off", (F.col("read_pos") - F.col("off")).alias("diag"))
        return met.withColumn("nth", F.row_number().over(W.partitionBy("read_id", "onode_id", "diag").orderBy("off")))

    begun = ends("before")
    over = ends("behind").select("read_id", "onode_id", "diag", "nth", F.col("off").alias("last"))
    return begun.join(over, ["read_id", "onode_id", "diag", "nth"]).select("read_id", "onode_id", "read_pos", "off", (F.col("last") - F.col("off") + least).cast("long").alias("match_len"))


def with_text(matches: DataFrame, reads: DataFrame) -> DataFrame:
    return matches.join(reads.select("read_id", "seq"), "read_id").withColumn("text", F.expr("substring(seq, read_pos + 1, int(match_len))")).drop("seq")


def mums(matches: DataFrame, reads: DataFrame) -> DataFrame:
    """Maximal matches whose text occurs once among the matches of the read and once in the graph's."""
    told = with_text(matches, reads)
    in_read = F.count("*").over(W.partitionBy("read_id", "text"))
    in_graph = told.select("onode_id", "off", "text").distinct().groupBy("text").agg(F.count("*").alias("places"))
    return told.withColumn("in_read", in_read).join(in_graph, "text").where("in_read = 1 and places = 1").drop("in_read", "places", "text")


def uniqueness(matches: DataFrame, reads: DataFrame, bonus: float) -> DataFrame:
    """Adds ``weight``: ``bonus`` for a match whose text has one place in the graph, 1 for others."""
    told = with_text(matches, reads)
    places = told.select("onode_id", "off", "text").distinct().groupBy("text").agg(F.count("*").alias("places"))
    return told.join(places, "text").withColumn("weight", F.when(F.col("places") == 1, F.lit(float(bonus))).otherwise(F.lit(1.0))).drop("places", "text")


def longest(matches: DataFrame, count: int, window: int = 0) -> DataFrame:
    """The ``count`` longest matches of each read, or of each ``window`` bases of it; ties by place.

    A column ``weight`` multiplies the lengths that are compared.
    """
    keys = ["read_id", *([F.floor(F.col("read_pos") / window)] if window else [])]
    size = F.col("match_len") * F.col("weight") if "weight" in matches.columns else F.col("match_len")
    order = W.partitionBy(*keys).orderBy(size.desc(), "read_pos", "onode_id", "off")
    return matches.withColumn("r", F.row_number().over(order)).where(F.col("r") <= count).drop("r")


def flip_match(matches: DataFrame, onodes: DataFrame) -> DataFrame:
    """A match's start on the node's other strand."""
    return matches.join(onodes.select("onode_id", "len"), "onode_id").withColumn("onode_id", F.col("onode_id").bitwiseXOR(F.lit(1))).withColumn("off", F.col("len") - F.col("off") - F.col("match_len")).drop("len")


def external_seeds(reads: DataFrame, seeds: DataFrame) -> DataFrame:
    """Given seeds of known reads."""
    return seeds.join(reads.select("read_id"), "read_id", "left_semi")
