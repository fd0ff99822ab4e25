"""Intervals of integers within a key: union length and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def covered(spans: DataFrame, key: str, start: str, end: str, name: str = "covered") -> DataFrame:
    """``(key, name)``: the length of the union of ``[start, end)``."""
    before = F.max(end).over(W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    part = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))), F.lit(0))
    return spans.withColumn("part", part).groupBy(key).agg(F.sum("part").alias(name))


def merged(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Disjoint spans; those that overlap or touch become one."""
    order = W.partitionBy(*keys).orderBy(start, end)
    opens = F.when(F.col(start) <= F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1)
    runs = spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("run")
