"""Streams of reads: intake with a cap, seeding against a fixed index, running totals, and an append sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqgraph.sources import reads

READS = "read_id long, seq string, len int"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 200, schema: str = READS) -> DataFrame:
    """Parquet files of reads as they arrive, so many for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_text_stream(spark: SparkSession, path: str, files_per_trigger: int = 200, keep_tags: bool = False) -> DataFrame:
    """FASTA or FASTQ files (by the suffix in ``path``, a glob) as they arrive, so many for each micro-batch, as
    ``(read_id, seq, qual, len)``. A FASTQ file is one row at first, so files should be of a size that fits in a task;
    `fastq_by_batch` takes files of any size."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if path.lower().removesuffix(".gz").endswith(reads.SUFFIXES[reads.read_fasta]):
        return reads.fasta_records(stream.option("lineSep", "\n>").text(path), keep_tags)
    if path.lower().removesuffix(".gz").endswith(reads.SUFFIXES[reads.read_fastq]):
        return reads.fastq_records(stream.text(path, wholetext=True), keep_tags)
    raise ValueError(f"unknown kind of read file: {path}")


def _started(writer, available: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available else writer).start()


def seeded(stream: DataFrame, seed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Applies ``seed`` (a batch plan against a fixed index) to each micro-batch; a repeated batch replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        seed(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _started(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available)


def totals(stream: DataFrame) -> DataFrame:
    """Running reads and bases."""
    return stream.agg(F.count("*").alias("reads"), F.coalesce(F.sum("len"), F.lit(0)).alias("bp"))


def kept_totals(stream: DataFrame, name: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """The totals as a table in memory, complete after each micro-batch."""
    return _started(totals(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint), available)


def appended(stream: DataFrame, out: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Appends alignments as Parquet, each exactly once."""
    return _started(stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint), available)


def by_batch(stream: DataFrame, out: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Writes each micro-batch in a folder of its number; a batch that is played again replaces its own and nothing else."""
    return seeded(stream, lambda batch: batch, out, checkpoint, available)


def fastq_by_batch(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_trigger: int = 200, keep_tags: bool = False, available: bool = True) -> StreamingQuery:
    """FASTQ files as they arrive, written like `by_batch`: lines are numbered within a micro-batch, so a file is many tasks.
    A record that its file cuts off is left out."""
    lines = reads.file_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))
    return seeded(lines, lambda batch: reads.fastq_of_lines(batch, keep_tags).where("qual is not null"), out, checkpoint, available)
