"""Elements in elements, by events in document order.

An element opens at its node and closes after its last descendant, so elements nest like brackets. Whatever lies in what is told by running values over these
events, page by page: the farthest end of those that are open, the number of open ones, sums up to an event. An element's nearest open one is
the latest of its level to have opened. Pages are sorted, never joined with themselves: n elements take n log n steps, and rows are only
made where an operator returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_OPEN, _ITEM, _CLOSE = 0, 1, 2


def covered(key: str, flag: Column, *, own: bool = False) -> Column:
    """Whether an element lies in one that flag holds for (own: or is one). A window: the farthest end of those that opened before."""
    before = W.partitionBy(key).orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow if own else -1)
    return F.coalesce(F.max(F.when(flag, F.col("last"))).over(before) >= F.col("node"), F.lit(False))


def sums_inside(rows: DataFrame, key: str, **values: Column) -> DataFrame:
    """rows with sums of values over what is in each element, without the element's own."""
    names = list(values)
    told = rows.select(key, "node", "last", *(F.coalesce(v, F.lit(0)).cast("long").alias(f"__{n}") for n, v in values.items()))
    ends = F.array(F.struct(F.col("node").alias("at"), F.lit(_OPEN).alias("kind"), *(f"__{n}" for n in names)), F.struct(F.col("last").alias("at"), F.lit(_CLOSE).alias("kind"), *(F.lit(0).cast("long").alias(f"__{n}") for n in names)))
    events = told.select(key, "node", F.explode(ends).alias("e")).select(key, "node", "e.*")
    up_to = W.partitionBy(key).orderBy("at", "kind", "node")
    summed = events.select(key, "node", "kind", *(F.sum(f"__{n}").over(up_to).alias(n) for n in names))
    per = summed.groupBy(key, "node").agg(*((F.max(F.when(F.col("kind") == _CLOSE, F.col(n))) - F.max(F.when(F.col("kind") == _OPEN, F.col(n)))).alias(n) for n in names))
    return rows.join(per, [key, "node"])


def _levels(owners: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Openings of owners and items (key, at, kind, node) with level: how many owners are open there, the opening one included."""
    o = owners.select(key, F.explode(F.array(F.struct(F.col("node").alias("at"), F.lit(_OPEN).alias("kind"), F.lit(1).alias("by")), F.struct(F.col("last").alias("at"), F.lit(_CLOSE).alias("kind"), F.lit(-1).alias("by")))).alias("e"), "node").select(key, "e.*", "node")
    i = items.select(key, F.col("node").alias("at"), F.lit(_ITEM).alias("kind"), F.lit(0).alias("by"), "node")
    running = W.partitionBy(key).orderBy("at", "kind", F.desc("node"))
    return o.unionByName(i).withColumn("level", F.sum("by").over(running)).where(F.col("kind") != _CLOSE)


def enclosing(owners: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """key, node, owner: each item with every owner that it is in or that it is. Both: key, node (different ones of a page), and last of owners."""
    levels = _levels(owners, items, key)
    each = levels.select(key, "at", "kind", "node", F.explode(F.when(F.col("kind") == _OPEN, F.array("level")).otherwise(F.when(F.col("level") > 0, F.sequence(F.lit(1).cast("long"), "level")))).alias("level"))
    return _latest(each, key).where(F.col("kind") == _ITEM).select(key, "node", "owner")


def _latest(levels: DataFrame, key: str) -> DataFrame:
    """levels with owner: the latest to have opened at a row's level."""
    before = W.partitionBy(key, "level").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return levels.withColumn("owner", F.last(F.when(F.col("kind") == _OPEN, F.col("node")), ignorenulls=True).over(before))


def nearest(owners: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """key, node, owner, level of items: the innermost owner that an item is in or is, and how many there are; null and 0 outside of all."""
    found = _latest(_levels(owners, items, key), key).where(F.col("kind") == _ITEM)
    return found.select(key, "node", F.when(F.col("level") > 0, F.col("owner")).alias("owner"), "level")


def first_inside(owners: DataFrame, items: DataFrame, key: str, value: Column) -> DataFrame:
    """key, node (the owner's) and found: value of the first item that an owner holds or is; owners without one are left out."""
    o = owners.select(key, "node", "last", F.lit(_OPEN).alias("kind"), F.lit(None).alias("v"))
    i = items.select(key, "node", F.lit(None).cast("int").alias("last"), F.lit(_ITEM).alias("kind"), F.struct(F.col("node").alias("n"), value.alias("v")).alias("v"))
    kind = i.schema["v"].dataType
    after = W.partitionBy(key).orderBy(F.desc("node"), F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = o.withColumn("v", F.col("v").cast(kind)).unionByName(i).withColumn("next", F.last("v", ignorenulls=True).over(after))
    return both.where((F.col("kind") == _OPEN) & (F.col("next.n") <= F.col("last"))).select(key, "node", F.col("next.v").alias("found"))


def innermost(rows: DataFrame, key: str) -> DataFrame:
    """Those of rows that hold none of rows."""
    after = F.lead("node").over(W.partitionBy(key).orderBy("node"))
    return rows.withColumn("__next", after).where(F.col("__next").isNull() | (F.col("__next") > F.col("last"))).drop("__next")
