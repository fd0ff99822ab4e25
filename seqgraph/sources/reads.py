"""Read scans: FASTA, FASTQ and SAM text as ``(read_id, seq, qual, len)``, chosen by a file's suffix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.functions.sequences import trim_name


def _reads(rows: DataFrame, keep_tags: bool) -> DataFrame:
    name = F.col("name") if keep_tags else trim_name("name")
    return rows.select(name.alias("read_id"), "seq", "qual", F.length("seq").alias("len"))


def read_fasta(spark: SparkSession, *paths: str, keep_tags: bool = False) -> DataFrame:
    """Records begin with > and may take several lines; carriage returns and blanks at line ends are cut off."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(list(paths)), keep_tags)


def fasta_records(parts: DataFrame, keep_tags: bool = False) -> DataFrame:
    """Reads from the column ``value``, FASTA cut at each > that begins a line."""
    rows = parts.where("trim(value) <> ''")
    body = F.regexp_replace("value", r"^>", "")
    return _reads(rows.select(F.rtrim(F.regexp_extract(body, r"^([^\r\n]*)", 1)).alias("name"), F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"[ \t\r]*(\n|$)", "").alias("seq"), F.lit(None).cast("string").alias("qual")), keep_tags)


def numbered(lines: DataFrame) -> DataFrame:
    """Adds ``n``, the line's number in its file from 1, to ``(file, block, place)``: within each block of the file, and
    then the lines of the blocks before, so a large file is many tasks."""
    own = lines.withColumn("k", F.row_number().over(W.partitionBy("file", "block").orderBy("place")))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("size"))
    before = F.sum("size").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return own.join(sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("size"), ["file", "block"]).withColumn("n", F.col("before") + F.col("k")).drop("before", "k")


def file_lines(text: DataFrame) -> DataFrame:
    """``(line, file, block)`` of lines scanned from files, in their order there."""
    return text.select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_fastq(spark: SparkSession, *paths: str, keep_tags: bool = False) -> DataFrame:
    """Records of four lines. Lines are numbered within each file; what stands before the first @ is skipped."""
    return fastq_of_lines(file_lines(spark.read.text(list(paths))), keep_tags)


def fastq_of_lines(lines: DataFrame, keep_tags: bool = False) -> DataFrame:
    """Reads of FASTQ files from their lines, of one scan or one micro-batch, as `file_lines` gives them."""
    rows = numbered(lines.withColumn("place", F.monotonically_increasing_id()))
    skip = rows.where(F.startswith("line", F.lit("@"))).groupBy("file").agg(F.min("n").alias("skip"))
    rows = rows.join(skip, "file").where("n >= skip")
    rows = rows.withColumn("i", (F.col("n") - F.col("skip")) % 4).groupBy("file", F.floor((F.col("n") - F.col("skip")) / 4).alias("record")).agg(*(F.max(F.when(F.col("i") == k, F.col("line"))).alias(c) for k, c in ((0, "head"), (1, "seq"), (3, "qual"))))
    return _reads(rows.where("head like '@%' and seq is not null").select(F.expr("substring(head, 2)").alias("name"), "seq", "qual"), keep_tags)


def fastq_records(files: DataFrame, keep_tags: bool = False) -> DataFrame:
    """Reads from the column ``value``, a whole FASTQ file each: for streams of records, where lines cannot be numbered."""
    lines = files.select(F.split(F.regexp_replace("value", "[ \t\r]*(\n|$)", "$1"), "\n").alias("l"))
    lines = lines.withColumn("skip", F.array_position(F.transform("l", lambda x: F.startswith(x, F.lit("@"))), True)).where("skip > 0")
    count = F.expr("int((size(l) - skip + 1) div 4)")
    row = lambda i: F.struct(*(F.get("l", (F.col("skip") - 1 + 4 * i + k).cast("int")).alias(c) for c, k in (("head", 0), ("seq", 1), ("qual", 3))))
    rows = lines.withColumn("n", count).where("n > 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), row)).alias("r")).select("r.*")
    return _reads(rows.where("head like '@%'").select(F.expr("substring(head, 2)").alias("name"), "seq", "qual"), keep_tags)


def read_sam(spark: SparkSession, *paths: str, keep_tags: bool = False) -> DataFrame:
    """Primary, non-supplementary lines."""
    rows = spark.read.text(list(paths)).where("value not like '@%' and value <> ''").select(F.split("value", "\t").alias("v"))
    return _reads(rows.where("cast(v[1] as int) & 2304 = 0").selectExpr("v[0] as name", "v[9] as seq", "nullif(v[10], '*') as qual"), keep_tags)


SUFFIXES = {read_fasta: (".fa", ".fasta", ".fna"), read_fastq: (".fq", ".fastq"), read_sam: (".sam",)}


def read_reads(spark: SparkSession, *paths: str, keep_tags: bool = False) -> DataFrame:
    """Reads of all files, each by its suffix (case and .gz aside)."""
    found = []
    for reader, suffixes in SUFFIXES.items():
        own = [p for p in paths if p.lower().removesuffix(".gz").endswith(suffixes)]
        if own:
            found.append(reader(spark, *own, keep_tags=keep_tags))
    known = sum((s for s in SUFFIXES.values()), ())
    if wrong := [p for p in paths if not p.lower().removesuffix(".gz").endswith(known)]:
        raise ValueError(f"unknown kind of read file: {', '.join(wrong)}")
    return reduce(DataFrame.unionByName, found)
