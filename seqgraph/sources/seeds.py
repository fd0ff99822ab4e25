"""External seeds from JSON or GAF alignments, and indexes and haplotype evidence kept between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.functions.sequences import trim_name

ALIGNMENT = "name string, query_position int, path struct<mapping:array<struct<position:struct<node_id:bigint,offset:bigint,is_reverse:boolean,name:string>,edit:array<struct<from_length:int,to_length:int,sequence:string>>,rank:bigint>>>"


def read_seeds_json(spark: SparkSession, path: str) -> DataFrame:
    """``(read_id, node_id, off, read_pos, match_len, is_rev)`` from each alignment's first mapping; start indices."""
    first = F.col("path.mapping")[0]
    rows = spark.read.schema(ALIGNMENT).json(path).where(F.size("path.mapping") > 0)
    return rows.select(trim_name("name").alias("read_id"), first["position"]["node_id"].alias("node_id"), F.coalesce(first["position"]["offset"], F.lit(0)).cast("long").alias("off"), F.coalesce("query_position", F.lit(0)).cast("long").alias("read_pos"), F.coalesce(first["edit"][0]["from_length"], F.lit(0)).alias("match_len"), F.coalesce(first["position"]["is_reverse"], F.lit(False)).alias("is_rev"))


def read_gaf_seeds(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """The same from GAF lines: the first step of the path, the path's start and the read's interval."""
    rows = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("v"))
    step = rows.selectExpr("v[0] as read_id", "cast(v[2] as bigint) as read_pos", "cast(v[3] as bigint) - cast(v[2] as bigint) as match_len", "cast(v[7] as bigint) as off", "regexp_extract(v[5], '^([<>])([^<>]+)', 1) = '<' as is_rev", "regexp_extract(v[5], '^([<>])([^<>]+)', 2) as name")
    return step.join(nodes.select("name", "node_id"), "name").select(trim_name("read_id").alias("read_id"), "node_id", "off", "read_pos", F.col("match_len").cast("int").alias("match_len"), "is_rev")


def write_index(index: DataFrame, path: str, k: int, w: int) -> None:
    """Keeps an index under its parameters."""
    index.withColumn("k", F.lit(k)).withColumn("w", F.lit(w)).write.partitionBy("k", "w").mode("append").parquet(path)


def read_index(spark: SparkSession, path: str, k: int, w: int) -> DataFrame:
    """The kept index of these parameters; ValueError if there is none."""
    found = spark.read.parquet(path).where(f"k = {int(k)} and w = {int(w)}")
    if not found.head(1):
        raise ValueError(f"no index of k = {k} and w = {w} in {path}")
    return found.drop("k", "w")


def fingerprint(onodes: DataFrame) -> str:
    """What evidence was taken from: the number of nodes and a digest of their ids and bases in any order."""
    n, mark = onodes.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("onode_id", "seq")), F.lit(0))).first()
    return f"{n}-{mark}"


def write_evidence(informative: DataFrame, conflicts: DataFrame, path: str, k: int, mark: str) -> None:
    """Keeps the evidence of one k in folders of its own, and last of all the line that says what it was taken from."""
    informative.write.mode("overwrite").parquet(f"{path}/informative/k={k}")
    conflicts.write.mode("overwrite").parquet(f"{path}/conflicts/k={k}")
    informative.sparkSession.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/k={k}")


def read_evidence(spark: SparkSession, path: str, k: int, mark: str) -> tuple[DataFrame, DataFrame] | None:
    """The kept evidence of this k, None if there is none; ValueError if it was taken from another graph."""
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/k={k}/_SUCCESS")
    if not manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        return None
    (found,) = spark.read.parquet(f"{path}/manifest/k={k}").first()
    if found != mark:
        raise ValueError(f"the evidence of k = {k} in {path} was taken from another graph")
    return tuple(spark.read.parquet(f"{path}/{name}/k={k}") for name in ("informative", "conflicts"))
