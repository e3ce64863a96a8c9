"""Tables that are written once and read by many operators of a query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The application's folder in the one that all executors share (spark.checkpoint.dir, or the context's); only local sessions may do without."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="noticeweave-"))
        shared = context.getCheckpointDir()
    return f"{shared.rstrip('/')}/noticeweave-tables/{context.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table: what is costly to make (parsed pages) is made once, and readers get the columns that they need."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Deletes the application's tables, once results that read them are written. True if there were some."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
