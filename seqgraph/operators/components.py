"""Connected components of an undirected edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every node of the task's edges with the smallest node it reaches there."""
    edges = np.concatenate([np.zeros((0, 2), np.int64), *(f[["u", "v"]].to_numpy(np.int64) for f in frames)])
    names, ends = np.unique(edges, return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    top = np.arange(len(names))
    while len(u):
        a, b = top[u], top[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]
    yield pd.DataFrame({"u": names, "v": names[top]}, dtype="int64")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, local_edges: int = 1 << 19) -> DataFrame:
    """Returns ``(node, component)``, a row a node: the smallest node id that each node of ``edges`` reaches.

    A table that counts at most ``local_edges`` distinct edges is one bounded task. A larger one alternates large-star
    and small-star rounds, which take a number of rounds in the logarithm of the component size; each is an aggregate
    and a join on the node id, so no component is gathered in one task, and rounds end early once the table has shrunk
    to the bound. Self-loops keep isolated nodes; rows with a null end are ignored; an empty table gives no rows.
    """
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    now = saved(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    seen = None
    for _ in range(max_rounds):
        if now.count() <= local_edges:
            now = now.coalesce(1).mapInPandas(_forest, "u long, v long")
            break
        now = now.where("u <> v")
        # large star: neighbours above a node are hung on the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and itself, are hung on the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if mark == seen and mark[0] == mark[2]:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
