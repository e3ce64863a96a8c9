"""Tables from and to files: versions with a pointer, portable exports, and checks of imports."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def publish(df: DataFrame, path: str, version: int) -> None:
    """Writes a version, then points to it. Readers never see half a version."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    df.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/_current")


def current(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.schema("version int").json(f"{path}/_current").first().version
    return spark.read.parquet(f"{path}/version={version}")


def export_json(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("compression", "gzip").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an export; what doesn't parse is kept in _bad."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def faults(rows: DataFrame, key: str, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """fault and n: repeated or missing keys, and references (column to table and key) that lead nowhere."""
    found = rows.groupBy(key).count().where("count > 1").agg(F.lit("repeated key").alias("fault"), F.count(F.lit(1)).alias("n"))
    found = found.unionByName(rows.where(F.col(key).isNull()).agg(F.lit("no key").alias("fault"), F.count(F.lit(1)).alias("n")))
    for column, (table, other) in references.items():
        lost = rows.where(F.col(column).isNotNull()).join(table.select(F.col(other).alias(column)), column, "left_anti")
        found = found.unionByName(lost.agg(F.lit(f"{column} leads nowhere").alias("fault"), F.count(F.lit(1)).alias("n")))
    return found


def read_evidence(spark: SparkSession, path: str, sites: list[str] | None = None) -> DataFrame:
    """Evidence by site: a folder for each site_key, of which only the wanted ones are listed and read."""
    rows = spark.read.parquet(path)
    return rows if sites is None else rows.where(F.col("site_key").isin(*sites))


def write_evidence(rows: DataFrame, path: str) -> None:
    rows.repartition("site_key").write.mode("overwrite").partitionBy("site_key").parquet(path)


def _unzip(data: bytes | None) -> str | None:
    try:
        return None if data is None else gzip.decompress(bytes(data)).decode("utf-8", "replace")
    except (OSError, EOFError, zlib.error):
        return None


@F.pandas_udf(T.StringType())
def _unzipped(values: pd.Series) -> pd.Series:
    return values.map(_unzip)


def unzipped(packed: Column) -> Column:
    """Texts from gzip bytes, in Arrow batches; null for null and for what is no gzip."""
    return _unzipped(packed)


@F.pandas_udf(T.BinaryType())
def _zipped(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8"), mtime=0))


def zipped(text: Column) -> Column:
    """Gzip bytes of texts, equal for equal texts."""
    return _zipped(text)


def snapshot_bodies(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """wanted (site_key, url, hash) with the body of that very content, or null. Bodies are read for wanted ones only."""
    keys = ["site_key", "url", "hash"]
    return wanted.join(snapshots.select(*keys, "payload"), keys, "left").withColumn("body", unzipped(F.col("payload"))).drop("payload")


def unpacked_report(catalog: DataFrame, payload: str, schema: str) -> DataFrame:
    """The rows of a published catalog's gzip JSON."""
    return catalog.withColumn("report", F.from_json(unzipped(F.col(payload)), schema)).select(*(c for c in catalog.columns if c != payload), "report.*")


def tolerant_union(tables: list[DataFrame], columns: dict[str, str]) -> DataFrame:
    """Rows of tables of several ages, with columns (name to type): missing ones are null, unknown ones are left out."""
    shaped = [t.select(*(F.col(c).try_cast(k).alias(c) if c in t.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items())) for t in tables]
    out = shaped[0]
    for t in shaped[1:]:
        out = out.unionByName(t)
    return out


def valid_import(rows: DataFrame, key: str, most: int, types: dict[str, str]) -> DataFrame:
    """fault and n of an import's rows: values that don't fit their type, and more than most rows."""
    parts = [rows.agg(F.lit("too many rows").alias("fault"), F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("n"))]
    parts += [rows.agg(F.lit(f"{c} is no {k}").alias("fault"), F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull()).alias("n")) for c, k in types.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def profiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rules as rows, from lines of JSON; nth is their order within a file."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 and whole (a PDF from its head to its end mark) of attachments. Empty files have no row."""
    files = spark.read.format("binaryFile").load(path)
    head, tail = F.substring("content", 1, 5), F.substring("content", F.greatest(F.lit(1), F.length("content") - 1023), 1024)
    whole = (head == F.encode(F.lit("%PDF-"), "UTF-8")) & F.contains(F.decode(tail, "ISO-8859-1"), F.lit("%%EOF"))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"), whole.alias("whole"))
