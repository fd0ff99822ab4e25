"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is set only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_in = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Removes what `saved` wrote for these tables; nothing may read them any more."""
    for df in tables:
        if df is not None and hasattr(df, "_saved_in"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_in)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
