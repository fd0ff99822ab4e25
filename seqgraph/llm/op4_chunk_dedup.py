"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts a text's UTF-8 bytes where four of its bits are 0, at least ``LEAST``
and at most ``MOST`` bytes apart. Cuts depend on content alone, so a passage gets the same chunks wherever it stands and
an insertion moves only the chunks around it. Chunks are compared by a 128-bit digest.

A first pass counts the digests' first halves, pre-aggregated for each task; those that occur twice set a bit in a map
of fixed size. A second pass emits only the marked chunks, which are counted exactly by both halves: a full map filters
less but changes nothing. Neighbouring repeated chunks make a stretch; those of ``least_bytes`` or more are told.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.llm.common import U, _power, bit_map, blocks, marked, mix, table

LEAST, MOST = 16, 128
GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
MASK = np.uint32(0xF000)  # bits 12 to 15 depend on the last 13 to 16 bytes
_KEYS = tuple(np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1) for s in (11, 12))
_BASES = tuple((U(r), U(pow(r, -1, 2**64))) for r in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5))


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last 16 bytes at each byte: the sum of GEAR[b] << age, built by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    out, last = [], 0
    for c in [*(np.flatnonzero(gear(data)[15:] & MASK == 0) + 16).tolist(), n]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or c == n > last:
            out.append(c)
            last = c
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for key, (up, down) in zip(_KEYS, _BASES, strict=True):
        sums = np.empty(len(data) + 1, U)
        sums[0] = 0
        np.cumsum(key[data] * _power(up, f"up{up}", len(data)), out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * _power(down, f"down{up}", len(data) + 1)[starts] + (ends - starts).astype(U)).astype(np.int64))
    return out[0], out[1]


def chunks(texts: pa.Array):
    """(rows, starts in the row, ends, both digests) of each block of texts."""
    for i, j, data, at in blocks(texts):
        found = [cuts(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        count = np.array([len(f) for f in found])
        rows = np.repeat(np.arange(i, j), count)
        base = np.repeat(at[:-1], count)
        ends = np.concatenate([np.zeros(0, np.int64), *(np.array(f, np.int64) for f in found)])
        starts = np.concatenate([np.zeros(0, np.int64), *(np.array([0, *f[:-1]], np.int64) for f in found if f)])
        yield rows, starts, ends, *digests(data, base + starts, base + ends)


def _halves(batches):
    for batch in batches:
        for *_, one, _ in chunks(batch.column("text")):
            h, c = np.unique(one, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])


def _repeated(batches, bits):
    for batch in batches:
        for rows, starts, ends, one, two in chunks(batch.column("text")):
            k = np.flatnonzero(marked(bits.value, one))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows[k])), *(pa.array(x[k]) for x in (starts, ends, one, two))], ["doc_id", "start", "stop", "h", "h2"])


def repeated_runs(docs: DataFrame, least_bytes: int = 100, map_log2: int = 26, within: bool = False) -> DataFrame:
    """``(doc_id, start, stop, first_doc_id, n_chunks)``: runs of bytes of a text that other documents hold too.

    ``start`` and ``stop`` are byte places in the UTF-8 text; ``first_doc_id`` is the smallest id that holds the run's
    first chunk. Null and empty texts have no chunk, rows of a null id are ignored, rows of one id are one document.
    With ``within``, what is repeated only within one document is told too, a stretch is broken into runs where its
    chunks' first holder changes, and ``again`` tells whether the run's chunks occurred before, in a smaller id or
    further ahead. Other columns are ignored; no rows give no runs.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = docs.select("text").mapInArrow(_halves, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    bits = sc.broadcast(bit_map(twice, "h", map_log2))
    rows = saved(docs.mapInArrow(partial(_repeated, bits=bits), "doc_id long, start long, stop long, h long, h2 long"), "op4-chunks")
    # written, so that the join below has an exchange on both sides and a very common chunk can be split
    place = F.struct("doc_id", "start")
    shared = rows.groupBy("h", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = saved(shared.where("first < last" if within else "first.doc_id < last.doc_id").select("h", "h2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")), "op4-shared")
    again = F.col("first_doc_id") < F.col("doc_id")
    again = again | (F.col("first_start") < F.col("start")) if within else again
    there = rows.join(shared, ["h", "h2"]).select("doc_id", "start", "stop", "first_doc_id", again.alias("again")).distinct()
    order = W.partitionBy("doc_id").orderBy("start", "stop")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True))
    other = (F.lag("first_doc_id").over(order) != F.col("first_doc_id")) | (F.lag("again").over(order) != F.col("again"))
    there = there.withColumn("apart", apart.cast("int")).withColumn("opens", (apart | other if within else apart).cast("int"))
    there = there.withColumn("stretch", F.sum("apart").over(order)).withColumn("run", F.sum("opens").over(order))
    runs = there.groupBy("doc_id", "stretch", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("first_doc_id", "start").alias("first_doc_id"), F.min_by("again", "start").alias("again"), F.count("*").alias("n_chunks"))
    whole = W.partitionBy("doc_id", "stretch")
    runs = runs.withColumn("bytes", F.max("stop").over(whole) - F.min("start").over(whole)).where(F.col("bytes") >= least_bytes)
    return runs.select("doc_id", "start", "stop", "first_doc_id", "n_chunks", *["again"] * within)


def _cut(batches):
    for batch in batches:
        texts, runs = batch.column("text").to_pylist(), batch.column("repeats").to_pylist()
        for i, r in enumerate(runs):
            if r and texts[i] is not None:
                raw, at, out = texts[i].encode(), 0, []
                for start, stop in sorted((x["start"], x["stop"]) for x in r):
                    out.append(raw[at:start])
                    at = stop
                texts[i] = b"".join([*out, raw[at:]]).decode("utf-8", "ignore")
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, "text", pa.array(texts, batch.schema.field("text").type)).drop_columns(["repeats"])


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """Removes each repeated chunk of the told runs but for its first occurrence, by id and place; other columns stay.

    A chunk in a stretch of repeats shorter than ``least_bytes`` stays where it is.
    """
    runs = repeated_runs(docs, **how, within=True).where("again").groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("repeats"))
    return docs.join(runs, "doc_id", "left").select(*docs.columns, "repeats").mapInArrow(_cut, docs.schema)


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"), within=True).drop("again")


QUERIES = {"op4_chunk_dedup": op4_chunk_dedup}
SQL: dict = {}
