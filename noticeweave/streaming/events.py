"""Streams of notices and events: merges in micro-batches, counters that start anew, and windows of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merge_stream(stream: DataFrame, path: str, keys: list[str], at: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Keeps at path the newest row of each key; late rows are taken, nothing is deleted.

    Keys fall into buckets. A batch reads and writes the buckets that it touches only, in a folder of its version; a manifest of the version names
    each bucket's newest folder. A batch that runs again writes the same version again, so a restart changes nothing. merged() reads the table.
    """
    from noticeweave.operators.merge import newest_wins

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = {r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()}  # as many as buckets
        known = _manifest(spark, path, number - 1) if number > 0 else {}
        fresh = batch.select(*batch.columns)
        if old := [f"{path}/version={known[b]}/bucket={b}" for b in sorted(touched & known.keys())]:
            fresh = fresh.unionByName(spark.read.schema(batch.schema).parquet(*old))
        kept = newest_wins(fresh, keys, at).select(*batch.columns, bucket.alias("bucket"))
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        places = sorted((known | dict.fromkeys(touched, number)).items())
        spark.createDataFrame(places, _PLACES).coalesce(1).write.mode("overwrite").json(f"{path}/_manifest/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_PLACES = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    return {r.bucket: r.version for r in spark.read.schema(_PLACES).json(f"{path}/_manifest/{number}").collect()}


def merged(spark: SparkSession, path: str, schema: T.StructType, number: int) -> DataFrame:
    """The table of merge_stream after a batch."""
    places = _manifest(spark, path, number)
    folders = [f"{path}/version={v}/bucket={b}" for b, v in sorted(places.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


_SEEN = T.StructType([T.StructField("key", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("allowed", T.BooleanType())])
_STATE = T.StructType([T.StructField("began", T.DoubleType()), T.StructField("n", T.LongType())])


def count_in_window(times: list[float], began: float | None, n: int, most: int, seconds: float) -> tuple[list[bool], float | None, int]:
    """Whether each hit is allowed. A window begins with the first hit after the last one ended."""
    allowed = []
    for t in times:
        if began is None or t - began >= seconds:
            began, n = t, 0
        n += 1
        allowed.append(n <= most)
    return allowed, began, n


def limit_stream(stream: DataFrame, key: str, at: str, most: int, seconds: int) -> DataFrame:
    """key, at, allowed for each event, counted by key in windows that begin with a hit."""

    def step(k: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        began, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("at")
        allowed, began, n = count_in_window([t.timestamp() for t in rows["at"]], began, n, most, seconds)
        state.update((began, n))
        yield pd.DataFrame({"key": rows["key"], "at": rows["at"], "allowed": allowed})

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, _SEEN, _STATE, "append", GroupStateTimeout.NoTimeout)


def event_windows(stream: DataFrame, at: str, kind: str, length: str, late: str) -> DataFrame:
    """Counts by window of event time and kind; an extension, with a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), kind).agg(F.count(F.lit(1)).alias("n"))


_CURSOR = T.StructType([T.StructField("source", T.LongType()), T.StructField("pages", T.LongType()), T.StructField("known", T.LongType()), T.StructField("streak", T.LongType()), T.StructField("stopped", T.BooleanType())])


def advance(pages: int, known: int, streak: int, stopped: bool, items: list[bool], most: int) -> tuple[int, int, int, bool]:
    """A source's cursor after a page with items (whether each was known before): stops after most known ones in a row."""
    if stopped:
        return pages, known, streak, stopped
    for old in items:
        known += old
        streak = streak + 1 if old else 0
        if streak >= most:
            return pages + 1, known, streak, True
    return pages + 1, known, streak, False


def cursor_stream(stream: DataFrame, most: int = 3) -> DataFrame:
    """source, pages, known, streak, stopped after each batch, from rows of source, page, nth, known; the state goes on after a restart."""

    def step(k: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, 0, False)
        rows = pd.concat(list(batches)).sort_values(["page", "nth"])
        for _, items in rows.groupby("page", sort=True):
            now = advance(*now, [bool(x) for x in items["known"]], most)
        state.update(now)
        yield pd.DataFrame([(k[0], *now)], columns=_CURSOR.fieldNames())

    held = T.StructType(_CURSOR.fields[1:])
    rows = stream.select(F.col("source").cast("long").alias("source"), "page", "nth", "known")
    return rows.groupBy("source").applyInPandasWithState(step, _CURSOR, held, "update", GroupStateTimeout.NoTimeout)
