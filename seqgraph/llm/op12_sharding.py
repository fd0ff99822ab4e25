"""Shards of near-equal bytes by sampled splitters: size-weighted samples, quantile boundaries, ranges, finer ranges.

A row's key is (hash of its text, id, row number), so equal texts lie side by side. A sample of keys, each row drawn in
proportion to its bytes, gives the boundaries of ``fine`` ranges a shard; they fall between texts. The ranges are then
counted exactly. A range of more than twice its share of bytes (or four times that of rows) is sampled by itself and
divided: first between texts, and within one text's copies by id and row number, so that a group of copies of any size
ends in bounded ranges. A range of one row cannot be divided; such rows over the share are dealt first, the largest to
the emptiest shard, and runs of the other ranges in order of their keys then fill all shards to one level.

Only samples (about ``per_range`` a range) and one count a range reach the driver: numbers that follow from the
parameters, not from the rows. Rows are read once for their text and then as a narrow table of keys and sizes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqgraph.checkpoints import saved
from seqgraph.llm.common import table

SHARDS, FINE, PER_RANGE, OVERHEAD = 24, 128, 8, 8
KEY = ("k1", "k2", "k3")
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def keyed(docs: DataFrame, *kept: Column) -> DataFrame:
    """``kept``, ``size`` and the three numbers of the key, written once so that row numbers stay. Ids that are no integers are hashed."""
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    second = F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id")
    size = text_bytes(F.col("text")) + OVERHEAD
    return saved(docs.select(*kept, size.alias("size"), F.xxhash64("text").alias("k1"), F.coalesce(second, F.lit(_LEAST)).alias("k2"), F.monotonically_increasing_id().alias("k3")), "op12-keys")


def ordered(keys: np.ndarray) -> np.ndarray:
    """Keys (n x 3) as strings of 24 bytes whose order is that of the keys."""
    flipped = keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(flipped.astype(">u8")).view("S24").reshape(-1)


def in_range(splitters: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(splitters, ordered(keys), "right")


def _ranges(frames: Iterator[pd.DataFrame], splitters: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows and bytes of each range within a task."""
    rows, size = np.zeros(len(splitters) + 1, np.int64), np.zeros(len(splitters) + 1, np.int64)
    for f in frames:
        r = in_range(splitters, f[list(KEY)].to_numpy(np.int64))
        rows += np.bincount(r, minlength=len(rows))
        np.add.at(size, r, f["size"].to_numpy(np.int64))
    at = np.flatnonzero(rows)
    yield pd.DataFrame({"r": at, "n": rows[at], "size": size[at]})


def _draw(frames: Iterator[pd.DataFrame], splitters: np.ndarray, wanted: np.ndarray, by_size: float, by_row: float, seed: int) -> Iterator[pd.DataFrame]:
    """Rows of the wanted ranges, each drawn ``size * by_size + by_row`` times on average; the fraction by a hash of the key."""
    for f in frames:
        r = in_range(splitters, f[list(KEY)].to_numpy(np.int64))
        u = pd.util.hash_pandas_object(f[list(KEY)] ^ seed, index=False).to_numpy(np.uint64) / 2.0**64
        times = np.floor(f["size"].to_numpy(float) * by_size + by_row + u).astype(np.int64)
        on = wanted[r] & (times > 0)
        yield f.loc[on, list(KEY)].assign(r=r[on], times=times[on])


def drawn(rows: DataFrame, splitters: np.ndarray, wanted: np.ndarray, by_size: float, by_row: float, seed: int) -> pd.DataFrame:
    f = partial(_draw, splitters=splitters, wanted=wanted, by_size=by_size, by_row=by_row, seed=seed)
    found = rows.select(*KEY, "size").mapInPandas(f, "k1 long, k2 long, k3 long, r long, times long").toPandas()
    return found.assign(key=ordered(found[list(KEY)].to_numpy(np.int64)).astype(object)).sort_values("key", kind="stable")


def quantiles(sample: pd.DataFrame, parts: int) -> np.ndarray:
    """The distinct keys (n x 3) at which the sample's weight passes 1/parts, 2/parts, ..."""
    upto = sample["times"].to_numpy().cumsum()
    at = np.unique(np.searchsorted(upto, np.arange(1, parts) * upto[-1] / parts, "right"))
    return sample[list(KEY)].to_numpy(np.int64)[at[at < len(sample)]]


def around(key: list[int], of_text: bool) -> list[list[int]]:
    """The first key of a text, or of a row, and the first one behind it."""
    k1, k2, k3 = key
    if of_text:
        return [[k1, _LEAST, _LEAST], *([[k1 + 1, _LEAST, _LEAST]] if k1 < _MOST else [])]
    return [[k1, k2, k3], [k1, k2, k3 + 1]]


def splitters_of(rows: DataFrame, n: int, total: int, ranges: int, per_range: int = PER_RANGE) -> tuple[np.ndarray, pd.DataFrame]:
    """Boundaries such that no range that can be divided is overfull, and the rows and bytes of each range."""
    step, row_step = total / ranges, n / ranges
    first = drawn(rows, np.zeros(0, "S24"), np.ones(1, bool), per_range / step, 0.0, 1)
    found = {tuple(around(k, True)[0]) for k in quantiles(first, ranges).tolist()} if len(first) else set()
    for seed in range(2, 200):
        keys = np.array(sorted(found), np.int64).reshape(-1, 3)
        splitters = ordered(keys)
        counts = rows.select(*KEY, "size").mapInPandas(partial(_ranges, splitters=splitters), "r long, n long, size long").groupBy("r").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).toPandas()
        counts = counts.set_index("r").reindex(range(len(splitters) + 1), fill_value=0).astype("int64")
        over = ((counts["size"] > 2 * step) | (counts["n"] > 4 * row_step)) & (counts["n"] > 1)
        if not over.any():
            return splitters, counts
        sample = drawn(rows, splitters, over.to_numpy(), per_range / step, per_range / row_step, seed)
        for r, own in sample.groupby("r"):
            low = keys[r - 1].tolist() if r else None
            high = keys[r].tolist() if r < len(keys) else [_MOST + 1, _LEAST, _LEAST]
            one_text = r > 0 and low[0] == high[0] - (high[1:] == [_LEAST, _LEAST])
            parts = max(2, int(np.ceil(max(counts["size"][r] / step, counts["n"][r] / row_step))))
            for k in quantiles(own, parts).tolist():
                found.update(map(tuple, around(k, not one_text)))
    raise RuntimeError("ranges stay overfull")


def dealt(counts: pd.DataFrame, shards: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each range, and the number of its first row there."""
    size, rows = counts["size"].to_numpy(), counts["n"].to_numpy()
    alone = np.flatnonzero((rows == 1) & (size > share))
    shard = np.zeros(len(size), np.int64)
    loads = [(0, s) for s in range(shards)]
    for r in alone[np.argsort(-size[alone], kind="stable")].tolist():
        load, s = heapq.heappop(loads)
        shard[r] = s
        heapq.heappush(loads, (load + int(size[r]), s))
    load = np.zeros(shards, np.int64)
    for x, s in loads:
        load[s] = x
    rest = np.ones(len(size), bool)
    rest[alone] = False
    left, low = size[rest].sum(), np.sort(load)
    # the level to which the rest fills the emptier shards
    levels = (left + np.cumsum(low)) / np.arange(1, shards + 1)
    level = levels[np.flatnonzero(np.append(low[1:], np.inf) >= levels)[0]]
    bounds = np.cumsum(np.maximum(0.0, level - load))
    middle = np.cumsum(size[rest]) - size[rest] / 2
    shard[rest] = np.minimum(np.searchsorted(bounds, middle, "right"), shards - 1)
    order = np.argsort(shard, kind="stable")
    before = np.cumsum(rows[order]) - rows[order]
    edge = np.searchsorted(shard[order], np.arange(shards))
    base = np.zeros(len(size), np.int64)
    base[order] = before - np.append(before, 0)[np.minimum(edge, len(before) - 1)][shard[order]]
    return shard, base


def _placed(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, shard: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        r = in_range(splitters, np.stack([b.column(c).to_numpy() for c in KEY], 1))
        more = [pa.array(r, pa.int64()), pa.array(shard[r], pa.int32()), pa.array(base[r], pa.int64())]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "r", "shard", "base"])


def assigned(rows: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """The columns that ``keyed`` kept, ``size``, ``shard`` and ``slot``; slots are gapless from 0 in each shard.

    A shard's bytes are the mean's, give or take one range, unless single rows are larger than that. Equal texts share a
    shard unless a boundary had to go through them. Empty rows give none.
    """
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.drop("k1", "k2", "k3").select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    splitters, counts = splitters_of(rows, n, total, shards * fine)
    shard, base = dealt(counts, shards, total / (shards * fine))
    schema = T.StructType([*rows.schema, *T._parse_datatype_string("r long, shard int, base long")])
    placed = rows.mapInArrow(partial(_placed, splitters=splitters, shard=shard.astype(np.int32), base=base), schema)
    at = F.row_number().over(W.partitionBy("r").orderBy(*KEY)) - 1
    return placed.withColumn("slot", F.col("base") + at).drop("k1", "k2", "k3", "r", "base")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, a row a document, by the law of near-equal bytes.

    A null text has no bytes and the digest of an empty one. Null ids come first within a text; repeated rows have slots
    of their own.
    """
    rows = keyed(docs, F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return assigned(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the whole rows of docs as Parquet, a folder ``shard=<n>`` each, with columns ``row`` and ``slot``."""
    assigned(keyed(docs, F.struct(*docs.columns).alias("row")), shards).select("row", "slot", "shard").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


QUERIES = {"op12_sharding": op12_sharding}
SQL: dict = {}
