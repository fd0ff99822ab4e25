"""Importance resampling of documents towards a target's distribution of hashed n-grams.

Each Arrow task takes its texts in blocks of about a MB. The distinct words of a block, each with a delimiter on both
sides, are the patterns of an Aho-Corasick automaton; their payloads are the CRC-32 of the word, that of the word behind
a space, and the length of the latter. One scan of the block emits the payloads in order of the text. The CRC of a run of
words follows from its neighbours' payloads alone: the run's own one is carried over the next word's bytes (a linear map
over GF(2), as tables for powers of two) and joined to it, so no n-gram is ever spelled.

The features' buckets are written once and serve both counting and scoring. Counts come from one array a task; the gains
are one number a bucket, so what is broadcast does not grow with the data. Ranks follow from a histogram of the integer
scores (their range is that of a logarithm: some ten thousand values at any size) and a window within each score, over
rows of the drawn scores only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.llm.common import blocks, table

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10000, 2, 7, 20, 25
BLOCK = 1 << 20
_POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
_WORD = [48 <= c < 58 or 97 <= c < 123 or c >= 128 for c in range(256)]
_CLEAN = bytes(c if _WORD[c] else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_ZEROS: list[np.ndarray] = []


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0, crc & 255] ^ tables[1, (crc >> 8) & 255] ^ tables[2, (crc >> 16) & 255] ^ tables[3, crc >> 24]


def zeros(power: int) -> np.ndarray:
    """Tables, one for each byte of a CRC, of the map that follows from 2**power zero bytes."""
    while len(_ZEROS) <= power:
        crc = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
        if _ZEROS:
            _ZEROS.append(_apply(_ZEROS[-1], _apply(_ZEROS[-1], crc)))
        else:
            for _ in range(8):
                crc = (crc >> 1) ^ np.where(crc & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
            _ZEROS.append(crc)
    return _ZEROS[power]


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings together, from that of each and the length of the right one."""
    out = left.copy()
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        on = np.flatnonzero(length & (1 << k))
        out[on] = _apply(zeros(k), out[on])
    return out ^ right


def automaton(words: list[bytes]) -> tuple[ahocorasick.Automaton, np.ndarray, np.ndarray, np.ndarray]:
    """The automaton of the words between spaces, and the payloads by its values."""
    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        found.add_word(f" {w.decode('latin-1')} ", i)
    found.make_automaton()
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    behind = np.array([zlib.crc32(w, zlib.crc32(b" ")) for w in words], np.uint32)
    return found, own, behind, np.array([len(w) + 1 for w in words], np.int64)


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of all runs of 1 to ``longest`` words) of each text; a null one has none."""
    for i, j, data, at in blocks(texts, BLOCK):
        n = j - i
        raw, ends = data.tobytes(), at.tolist()
        text = b" ".join([b"", *(raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)), b""]).translate(_CLEAN)
        words = sorted(set(text.split()))
        if not words:
            yield from ((0, np.zeros(0, np.uint32)) for _ in range(n))
            continue
        found, own, behind, length = automaton(words)
        hits = np.fromiter(chain.from_iterable(found.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
        # text k begins at at[k] + k + 1, and a match ends at the delimiter behind its word
        first = np.searchsorted(hits[:, 0], at + np.arange(n + 1) + 1)
        value = hits[:, 1]
        row = np.repeat(np.arange(n), np.diff(first))
        crc = own[value]
        parts, rows = [crc % np.uint32(buckets)], [row]
        for k in range(1, longest):
            inside = row[k:] == row[: len(row) - k]
            crc = composed(crc[: max(0, len(row) - k)], behind[value[k:]], length[value[k:]])
            parts.append((crc % np.uint32(buckets))[inside])
            rows.append(row[k:][inside])
        order = np.argsort(np.concatenate(rows), kind="stable")
        every = np.concatenate(parts)[order]
        cut = np.searchsorted(np.concatenate(rows)[order], np.arange(n + 1))
        for k in range(n):
            yield int(first[k + 1] - first[k]), every[cut[k] : cut[k + 1]]


def _scan(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = list(features(b.column("text"), buckets, longest))
        words = pa.array([f[0] for f in found], pa.int64())
        n = pa.array([len(f[1]) for f in found], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), words, n, pa.array([f[1].astype("<u4").tobytes() for f in found], pa.large_binary()).cast(pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])


def scanned(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, n_words, n_features, buckets)``, a row a document; the buckets are 32-bit numbers in one binary."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, buckets=buckets, longest=longest), f"doc_id {kind}, n_words long, n_features long, buckets binary")


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for b in batches:
        for x in b.column(0):
            total += np.bincount(np.frombuffer(x.as_py(), "<u4"), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "c"])


def counts(scans: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all rows: a number a bucket reaches the driver."""
    out = np.zeros(buckets, np.int64)
    for r in scans.select("buckets").mapInArrow(partial(_count, buckets=buckets), "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[r.bucket] = r.c
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to that in the source, both smoothed by one."""
    n, S, T = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + n) / ((s + 1.0) * (T + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column("n_features").to_numpy(zero_copy_only=False)
        total = np.array([int(gain[np.frombuffer(x.as_py(), "<u4")].sum()) for x in b.column("buckets")], np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(total // np.maximum(n, 1), pa.int64())], ["doc_id", "n_words", "n_features", "weight"])


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate from a digest of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of docs; rank 1 is the first one drawn, null is undrawn.

    ``percent`` in a hundred of the documents of ``least_words`` words are drawn, the share rounded down. A null text has
    no words: weight 0, not drawn. A row of a null id has a null score and is neither drawn nor counted among those to draw
    from, though its text is counted as source. Rows of one id have one noise and are ranked by their weights; equal rows
    take ranks side by side. An empty target leaves the gains of an empty count; empty docs give no row.
    """
    spark = docs.sparkSession
    scans = saved(scanned(docs, buckets, longest), "op11-scans")
    gain = gains(counts(scans, buckets), counts(scanned(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest), buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = scans.mapInArrow(partial(_weigh, gain=gain), f"doc_id {kind}, n_words long, n_features long, weight long")
    rows = saved(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "op11-scores")
    fit = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    bars = rows.where(fit).groupBy("score").agg(F.count("*").alias("c")).toPandas().sort_values("score", ascending=False)
    upto = bars["c"].cumsum()
    draws = percent * int(bars["c"].sum()) // 100
    top = pd.DataFrame({"score": bars["score"], "base": upto - bars["c"]})[upto - bars["c"] < draws].astype("int64")
    out = ("doc_id", "n_features", "weight", "score")
    bases = F.broadcast(spark.createDataFrame(top, "score long, base long")) if len(top) else spark.range(0).selectExpr("id AS score", "id AS base")
    cut = int(top["score"].min()) if len(top) else None
    high = F.coalesce(fit & (F.col("score") >= cut), F.lit(False)) if cut is not None else F.lit(False)
    same = rows.where(high).groupBy(*out).agg(F.count("*").alias("c")).join(bases, "score")
    before = F.sum("c").over(W.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(W.unboundedPreceding, -1))
    ranked = same.withColumn("from", F.col("base") + F.coalesce(before, F.lit(0)) + 1).select(*out, F.explode(F.sequence("from", F.col("from") + F.col("c") - 1)).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return ranked.union(rows.where(~high).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_resample": op11_resample}
SQL: dict = {}
