"""Ranked lexical search of many items at once, with the terms that items share summed once a document.

Items are taken in blocks of at most ``block_terms`` pairs of item and term. A block's items, as lists of terms ordered by
how many items hold them and by which, are mined for shared sets: neighbours that two items or more have in common become
one node, round after round, until no such pair is left. The nodes form a DAG whose leaves are terms; each is the sum of
two others, and an item is the sum of the few nodes that its list has come to.

One Arrow pass over the texts keeps, for each document, its length and its counts of the block's terms. Document
frequencies are one array a task. A second pass over that narrow table holds partial scores as an array of (node,
document) for a few documents at a time, level by level, and from them the items' sums; a task sends on no more than its
best ``k`` documents of an item. The block's DAG is what is broadcast: its size follows from ``block_terms`` (or one
item, where that alone is larger).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.llm.common import blocks, table, word_hashes

TOP, PERCENT = 10, 90
BLOCK_TERMS = 1 << 16
CELLS = 1 << 22  # numbers in an array of partial scores
_LOWER_A = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CLEAN = np.array([c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256)], np.uint8)


class Shared:
    """The DAG of a block: node ``terms + j`` is the sum of nodes ``pairs[j]``; item i is the sum of ``operands[at[i]:at[i+1]]``."""

    def __init__(self, lists: list[list[int]], terms: int):
        self.terms = terms
        own: dict[int, list[int]] = {}
        for i, x in enumerate(lists):
            for t in x:
                own.setdefault(t, []).append(i)
        # terms of the same items lie side by side, those of many items first
        order = {t: k for k, t in enumerate(sorted(own, key=lambda t: (-len(own[t]), own[t], t)))}
        place = [0.0] * terms
        for t, k in order.items():
            place[t] = k
        lists = [sorted(x, key=order.__getitem__) for x in lists]
        self.pairs: list[tuple[int, int]] = []
        while True:
            count = Counter(p for x in lists for p in zip(x[:-1], x[1:], strict=True))
            best = {p: c for p, c in count.items() if c > 1}
            if not best:
                break
            node: dict[tuple[int, int], int] = {}
            for i, x in enumerate(lists):
                # of two overlapping pairs the one that more items share goes first
                taken, merged = set(), {}
                for j in sorted((j for j in range(len(x) - 1) if (x[j], x[j + 1]) in best), key=lambda j: (-best[x[j], x[j + 1]], x[j], j)):  # noqa: B023
                    if j not in taken and j + 1 not in taken:
                        taken |= {j, j + 1}
                        p = (x[j], x[j + 1])
                        if p not in node:
                            node[p] = terms + len(self.pairs)
                            self.pairs.append(p)
                            place.append(place[p[0]])
                        merged[j] = node[p]
                lists[i] = [merged.get(j, x[j]) for j in range(len(x)) if j in merged or j not in taken]
                lists[i].sort(key=lambda t: (place[t], t))
        self.operands = np.array([t for x in lists for t in x], np.int64)
        self.at = np.cumsum([0, *map(len, lists)])
        level = [0] * terms
        for a, b in self.pairs:
            level.append(1 + max(level[a], level[b]))
        level = np.array(level[terms:], np.int64)
        pairs = np.array(self.pairs, np.int64).reshape(-1, 2)
        self.levels = [(terms + np.flatnonzero(level == k), pairs[level == k]) for k in range(1, int(level.max(initial=0)) + 1)]
        self.nodes = terms + len(self.pairs)

    def sums(self, leaves: np.ndarray) -> np.ndarray:
        """Items' sums (items x documents) from the terms' partial scores (terms x documents)."""
        partial_sums = np.empty((self.nodes, leaves.shape[1]), np.int64)
        partial_sums[: self.terms] = leaves
        for nodes, pairs in self.levels:
            partial_sums[nodes] = partial_sums[pairs[:, 0]] + partial_sums[pairs[:, 1]]
        out = np.zeros((len(self.at) - 1, leaves.shape[1]), np.int64)
        some = np.flatnonzero(np.diff(self.at))
        if len(some):
            out[some] = np.add.reduceat(partial_sums[self.operands], self.at[some], axis=0)
        return out


def hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit hashes of the terms of each block of texts, and for each text the index of its first one."""
    for _, _, data, at in blocks(texts):
        yield word_hashes(_CLEAN[data], at, lower=False)


def _counts(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, terms, times = [], [], []
        for words, first in hashed(b.column("text")):
            at = np.searchsorted(vocabulary, words)
            known = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == words) if len(vocabulary) else np.zeros(0, np.int64)
            row = np.searchsorted(first, known, "right") - 1
            pair, c = np.unique(row * max(1, len(vocabulary)) + at[known], return_counts=True)
            cut = np.searchsorted(pair, np.arange(len(first)) * max(1, len(vocabulary)))
            t, c = (pair % max(1, len(vocabulary))).astype("<i4"), c.astype("<i8")
            n += np.diff(first).tolist()
            terms += [t[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            times += [c[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "n", "terms", "times"])


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, np.int64)
    for b in batches:
        for x in b.column(0):
            df[np.frombuffer(x.as_py(), "<i4")] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "df"])


def _best(batches: Iterator[pa.RecordBatch], shared: Shared, weights: np.ndarray, N: int, L: int, k: int, percent: int) -> Iterator[pd.DataFrame]:
    """The best documents of each item within a task."""
    items = len(shared.at) - 1
    best = [pd.DataFrame({"item": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
    bar = np.ones(items, np.int64)
    width = max(1, CELLS // max(1, shared.nodes + len(shared.operands)))
    held = 0
    for b in batches:
        ids, n = b.column("doc_id"), b.column("n").to_numpy()
        m = 100 - percent + percent * n * N // max(1, L)
        terms, times = b.column("terms").to_pylist(), b.column("times").to_pylist()
        for i in range(0, len(n), width):
            j = min(len(n), i + width)
            size = [len(x) // 4 for x in terms[i:j]]
            t, c = np.frombuffer(b"".join(terms[i:j]), "<i4"), np.frombuffer(b"".join(times[i:j]), "<i8")
            doc = np.repeat(np.arange(j - i), size)
            leaves = np.zeros((shared.terms, j - i), np.int64)
            leaves[t, doc] = weights[t] * (1000000000 * c // (1000 * c + 8 * m[i:j][doc]))
            scores = shared.sums(leaves)
            item, at = np.nonzero(scores >= bar[:, None])
            if len(item):
                best.append(pd.DataFrame({"item": item, "doc_id": ids.take(pa.array(at + i)).to_numpy(zero_copy_only=False), "score": scores[item, at]}))
                held += len(item)
            if held > 64 * k * max(items, 64):
                best = [trimmed(best, k, bar)]
                held = len(best[0])
    out = trimmed(best, k, bar)
    yield out


def trimmed(parts: list[pd.DataFrame], k: int, bar: np.ndarray) -> pd.DataFrame:
    """The ``k`` best of each item; ``bar`` becomes the least score that can still be among them."""
    every = pd.concat(parts).sort_values(["item", "score", "doc_id"], ascending=[True, False, True], kind="stable")
    rank = every.groupby("item").cumcount()
    last = every[rank == k - 1]
    bar[last["item"].to_numpy()] = last["score"].to_numpy()
    return every[rank < k]


def _as_batches(batches: Iterator[pa.RecordBatch], kind: pa.DataType, **more) -> Iterator[pa.RecordBatch]:
    for f in _best(batches, **more):
        yield pa.RecordBatch.from_arrays([pa.array(f["item"], pa.int64()), pa.array(f["doc_id"], kind), pa.array(f["score"], pa.int64())], ["item", "doc_id", "score"])


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [np.unique(words[x:y]).view(np.int64).tolist() for words, first in hashed(b.column("text")) for x, y in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "terms"])


def item_blocks(items: DataFrame, block_terms: int) -> Iterator[tuple[list, list[list[int]]]]:
    """(ids, lists of hashes) of runs of items of at most ``block_terms`` terms together, read one after the other."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = items.where("item_id is not null").select("item_id", "text").mapInArrow(_hash_lists, f"item_id {kind}, terms array<long>")
    whole = found.select("item_id", F.explode_outer("terms").alias("t")).groupBy("item_id").agg(F.array_sort(F.collect_set("t")).alias("terms"))
    ids, lists, size = [], [], 0
    for r in saved(whole, "op13-items").orderBy("item_id").toLocalIterator():
        if ids and size + len(r.terms) > block_terms:
            yield ids, lists
            ids, lists, size = [], [], 0
        ids.append(r.item_id)
        lists.append(r.terms)
        size += len(r.terms)
    if ids:
        yield ids, lists


def search(docs: DataFrame, items: DataFrame, k: int = TOP, percent: int = PERCENT, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of highest score above 0 of each item, equal scores by id.

    Each row of docs is a document: rows of one id are ranked side by side, and rows of a null id count in the statistics
    but are not ranked. Rows of one item id are one item with the terms of them all; rows of a null one are ignored. Null
    texts have no terms. Terms are told apart by 64-bit hashes. Empty tables give no row.
    """
    spark = docs.sparkSession
    found = []
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    for ids, lists in item_blocks(items, block_terms):
        vocabulary = np.unique(np.array([t for x in lists for t in x], np.int64).view(np.uint64))
        shared = Shared([np.searchsorted(vocabulary, np.array(x, np.int64).view(np.uint64)).tolist() for x in lists], len(vocabulary))
        counts = saved(docs.select("doc_id", "text").mapInArrow(partial(_counts, vocabulary=vocabulary), f"doc_id {kinds[0]}, n long, terms binary, times binary").where("n > 0"), "op13-counts")
        N, L = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in counts.select("terms").mapInArrow(partial(_frequencies, size=len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weights = np.array([math.floor(1000 * math.log((2.0 * N + 2) / (2.0 * x + 1))) for x in df.tolist()], np.int64)
        sent = spark.sparkContext.broadcast((shared, weights))
        kind = pa.string() if kinds[0] == "string" else pa.int64()
        own = counts.where("doc_id is not null").mapInArrow(_sender(sent, kind, N=N, L=L, k=k, percent=percent), f"item long, doc_id {'string' if kinds[0] == 'string' else 'long'}, score long")
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kinds[1]}"))  # a block's items
        found.append(own.join(names, "item").drop("item"))
    if not found:
        return spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    every = reduce(DataFrame.union, found)
    # tasks send on k rows an item each: first among one of 64 parts of the ids, then among the parts' best
    by = (F.col("score").desc(), F.col("doc_id"))
    few = every.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*by))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*by))).where(F.col("rank") <= k).select("item_id", "rank", F.col("doc_id").cast(kinds[0]).alias("doc_id"), "score")


def _sender(sent, kind: pa.DataType, **more):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, weights = sent.value
        return _as_batches(batches, kind, shared=shared, weights=weights, **more)

    return run


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}
SQL = {
    "op13_lexical_search": rf"""
WITH found AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LOWER_A}', '{_LOWER_A.lower()}'), '{TERM}') AS terms FROM documents),
 docs AS (SELECT no, doc_id, len(terms) AS n, terms FROM found WHERE len(terms) > 0),
 sums AS (SELECT count(*) AS N_docs, coalesce(sum(n), 0)::bigint AS L FROM docs),
 tfs AS (SELECT no, doc_id, n, term, count(*) AS tf FROM (SELECT no, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
 weights AS (SELECT term, floor(1000 * ln((2 * any_value(N_docs) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM tfs, sums GROUP BY term),
 items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_LOWER_A}', '{_LOWER_A.lower()}'), '{TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
 scores AS (SELECT item_id, no, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * N_docs) // L))))::bigint AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term), sums WHERE doc_id IS NOT NULL GROUP BY item_id, no, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""",
}
