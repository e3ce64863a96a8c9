"""Retention, runs, revisions and samples: computations along an order within a key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from noticeweave.operators.graphs import _kept


def evictions(cache: DataFrame, keys: list[str], order: list[str], size: str, limit: int, cutoff: dt.datetime, at: str) -> DataFrame:
    """Entries to evict, least recently used first: too old, or in excess of the limit while what came before is gone.

    The bytes that remain before an entry are the total less those before it, so one prefix sum does it.
    """
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum(size).over(whole) - F.coalesce(F.sum(size).over(earlier), F.lit(0))
    return cache.withColumn("left", left).where((F.col(at) < F.lit(cutoff)) | (F.col("left") > limit) & F.lit(limit > 0)).drop("left")


def rotated(events: DataFrame, key: str, order: str, keep: int, at: str, cutoff: dt.datetime) -> DataFrame:
    """Events that leave the hot store: not among a key's newest, or old."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return events.withColumn("place", place).where((F.col("place") > keep) | (F.col(at) < F.lit(cutoff))).drop("place")


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of equal values: key, value, first, last, length."""
    along = W.partitionBy(key).orderBy(order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(along)) | F.lag(order).over(along).isNull()
    marked = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(along))
    return marked.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("run")


def until_streak(rows: DataFrame, key: str, order: str, flag: Column, streak: int) -> DataFrame:
    """Rows up to and with the one that completes a streak of flagged rows."""
    along = W.partitionBy(key).orderBy(order)
    resets = rows.withColumn("flag", flag.cast("int")).withColumn("reset", F.sum(1 - F.col("flag")).over(along))
    inside = W.partitionBy(key, "reset").orderBy(order)
    counted = resets.withColumn("streak", F.sum("flag").over(inside))
    done = F.coalesce(F.sum(F.when(F.col("streak") >= streak, 1)).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("done", done).where("done = 0").drop("flag", "reset", "streak", "done")


def revisions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("revision", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def day_label(at: str, as_of: dt.datetime) -> Column:
    days = F.date_diff(F.lit(as_of.date()), F.to_date(at))
    return F.when(F.col(at).isNull(), "unknown").when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.date_format(at, "yyyy-MM-dd"))


def spread_sample(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first three, the middle, and the last but one and last of each key."""
    along = W.partitionBy(key)
    place = F.row_number().over(along.orderBy(*order)) - 1
    marked = rows.withColumns({"place": place, "n": F.count(F.lit(1)).over(along)})
    n, p = F.col("n"), F.col("place")
    return marked.where(p.isin(0, 1, 2) | (p == F.floor(n / 2)) | (p == n - 2) | (p == n - 1)).drop("n")


def levels(days: DataFrame, value: str) -> DataFrame:
    """0 to 4 by quarters of the greatest value."""
    most = days.agg(F.max(value).alias("most"))
    return days.join(F.broadcast(most)).withColumn("level", F.when(F.col("most") > 0, F.ceil(F.col(value) * 4 / F.col("most"))).otherwise(0).cast("long")).drop("most")


def prefix_sums(rows: DataFrame, order: list[Column], size: str) -> DataFrame:
    """rows with before (the sum of size over all rows that come earlier) and total, over the whole table.

    Rows are dealt by range; sums within a partition and over earlier partitions (a row for each) add up, so that no task has all rows.
    Ranges are drawn from a sample, so the dealt rows are kept: drawn twice they might differ.
    """
    dealt = _kept(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part").agg(F.sum(size).alias("__sum"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"), F.sum("__sum").over(W.partitionBy()).alias("total"))
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return dealt.join(F.broadcast(bases), "__part").withColumn("before", F.col("__base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("__part", "__base")


def evictions_of_all(cache: DataFrame, order: list[Column], size: str, limit: int, stale: Column) -> DataFrame:
    """Entries of one cache to evict, least recently used first: stale ones, and those for which more than limit bytes are left. 0: no limit."""
    summed = prefix_sums(cache, order, size)
    return summed.where(stale | (F.col("total") - F.col("before") > limit) & F.lit(limit > 0)).drop("before", "total")


def trimmed(cache: DataFrame, order: list[Column], size: str, limit: int, stale: Column) -> DataFrame:
    """Snapshots to delete: stale ones, and, if all are over limit, the oldest until three quarters of it are left."""
    summed = prefix_sums(cache, order, size)
    return summed.where(stale | (F.col("total") > limit) & (4 * (F.col("total") - F.col("before")) > 3 * limit)).drop("before", "total")


def newest_versions(rows: DataFrame, key: str, order: list[Column], keep: int = 2, grace: Column | None = None) -> DataFrame:
    """Generations to delete: not among a key's newest, and not in their time of grace."""
    old = F.row_number().over(W.partitionBy(key).orderBy(*order)) > keep
    return rows.withColumn("__old", old).where(F.col("__old") & ~F.coalesce(F.lit(False) if grace is None else grace, F.lit(False))).drop("__old")


def trend(days: DataFrame, last: dt.date, n: int) -> DataFrame:
    """The last n days with level: 0 to 4 by quarters of their greatest value."""
    return levels(days.where(F.col("day") > F.date_sub(F.lit(last), n)), "tokens")


def two_old_pages(pages: DataFrame, key: str, order: str, old: Column) -> DataFrame:
    """Pages up to and with the second of two in a row on which all is old."""
    return until_streak(pages, key, order, old, 2)


def pruned(evidence: DataFrame, order: list[Column], size: str, limit: int, stale: Column, active: Column) -> DataFrame:
    """Evidence files to delete, oldest first: stale ones and those for which what may go is still over limit; active ones are never touched."""
    return evictions_of_all(evidence.where(~active), order, size, limit, stale)


def limited(hits: DataFrame, key: str, at: str, most: int, seconds: float) -> DataFrame:
    """hits with allowed: at most so many in a window that begins with the first hit after the last one ended.

    Keys are dealt and sorted; a task goes through its rows with the state of one key in hand, so that no key is held as a whole.
    """
    from noticeweave.streaming.events import count_in_window

    schema = T.StructType([*hits.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, began, n = None, None, 0
        for batch in batches:
            allowed: list[bool] = []
            for k, rows in batch.groupby(key, sort=False, dropna=False):
                if now is None or not (k == now[0] or k != k and now[0] != now[0]):  # nulls are one key
                    now, began, n = (k,), None, 0
                got, began, n = count_in_window([t.timestamp() for t in rows[at]], began, n, most, seconds)
                allowed += got
            yield batch.assign(allowed=allowed)

    return hits.repartition(key).sortWithinPartitions(key, at).mapInPandas(run, schema)


def retained(rows: DataFrame, root: str, key: str, order: list[str], size: str, keep: int, budget: int) -> DataFrame:
    """rows with kept: of each key's keep newest versions those that fit, newest first, into what is left of the root's bytes; one that doesn't fit is passed over.

    order: columns, greatest first. The fold goes over rows sorted by root with one number in hand.
    """
    nth = F.row_number().over(W.partitionBy(root, key).orderBy(*(F.desc(c) for c in order)))
    ranked = rows.withColumn("__nth", nth)
    schema = T.StructType([*ranked.schema.fields, T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left = None, budget
        for batch in batches:
            kept = []
            for r, n, s in zip(batch[root], batch["__nth"], batch[size], strict=True):
                if now is None or r != now[0]:
                    now, left = (r,), budget
                fits = n <= keep and s <= left
                left -= s if fits else 0
                kept.append(fits)
            yield batch.assign(kept=kept)

    return ranked.repartition(root).sortWithinPartitions(root, *(F.desc(c) for c in order)).mapInPandas(run, schema).drop("__nth")
