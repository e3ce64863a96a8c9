"""Tables that cut lineage, and joins that one hot key doesn't slow down."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be broadcast as hot: each has over 1/HOT of the rows, so there are fewer than HOT.
HOT = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Without either, local sessions get a temporary folder; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="noticeweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/noticeweave/{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written to the application's folder and read again. The tables stay until clear(): results are lazy and read them."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Deletes the application's tables once its results are written; those of other applications stay. True if there were some."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: list[Column]) -> DataFrame:
    """left inner join right on keys, where right (a stashed table) has a row for each key.

    weight is right's column of how many rows of left have the key, total their sum. Keys with over 1/HOT of
    the rows are fewer than HOT: they are broadcast, and their rows are dealt by spread instead of by key.
    """
    more = [c for c in right.columns if c not in keys and c != weight]
    packed = right.select(*keys, weight, F.struct(*more).alias("__nw_found"))
    hot = packed.where(F.col(weight) * HOT > total).drop(weight).withColumnRenamed("__nw_found", "__nw_hot")
    cold = packed.where(F.col(weight) * HOT <= total).drop(weight)
    marked = left.join(F.broadcast(hot), keys, "left")
    is_hot = F.col("__nw_hot").isNotNull()
    dealt = [F.when(is_hot, F.xxhash64(*spread)).otherwise(F.xxhash64(*keys)).alias("__nw_deal")]
    marked = marked.select("*", *dealt, (~is_hot).alias("__nw_cold"))
    cold = cold.select(F.xxhash64(*keys).alias("__nw_deal"), F.lit(True).alias("__nw_cold"), *(F.col(k).alias(f"__nw_{k}") for k in keys), "__nw_found")
    joined = marked.join(cold.hint("merge"), ["__nw_deal", "__nw_cold"], "left").where(
        is_hot | F.col("__nw_found").isNotNull() & _same(keys)
    )
    return joined.select(*left.columns, F.coalesce("__nw_hot", "__nw_found").alias("__nw_got")).select(*left.columns, "__nw_got.*")


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__nw_{k}"))
    return same
