"""Sharding: contiguous shards of near equal bytes, from global prefix sums.

Rows without their texts are dealt by ranges of the order and sorted. Each partition's total of bytes and rows is one row; sums over
earlier partitions plus the sum inside a partition give every row's place in the whole. The whole is cut at equal targets:
a document belongs to the shard in which its middle lies, so a shard's size is off its target by less than a document at each end.
Positions inside a shard are places less the place of its first row. Texts are read for their size and hash only; write_shards
moves each text once, to the shard that the first rows of shards name.

The order is that of ids, then of hashes of all columns, so shards are ranges of ids. Equal texts are near each other only if their ids are:
groups of copies are not kept together (one of them may be larger than a shard).

Results for odd rows: a null text has no bytes and the CRC-32 of nothing, 0; a null id comes first. Rows with one id are ordered by hashes of
all columns; rows that are equal in all columns can't be told apart and any of them may take any of their places. A document larger
than a shard's target leaves neighbouring shards without rows. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeweave.llm.stash import stash

SHARDS, OVERHEAD, FILE_BYTES = 24, 8, 256 << 20
_ID, _TIE = "__nw_id", "__nw_tie"


def _keys(docs: DataFrame, id_col: str) -> list[Column]:
    return [F.col(f"`{id_col}`").alias(_ID), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias(_TIE)]


def _size(text_col: str, overhead: int) -> Column:
    return F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long") + overhead


def placed(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """rows with before (the sum of size over earlier rows), place (their number) and total, over the whole table in this order."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__nw_part", F.spark_partition_id())
    dealt = stash(dealt, "shard-ranges")  # ranges are drawn from a sample: drawn twice they might differ
    sums = dealt.groupBy("__nw_part").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = W.orderBy("__nw_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    bases = sums.select(
        "__nw_part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("__nw_bytes"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("__nw_rows"),
        F.sum("bytes").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("__nw_part").orderBy(*order)
    return dealt.join(F.broadcast(bases), "__nw_part").select(
        *rows.columns,
        (F.col("__nw_bytes") + F.coalesce(F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"),
        (F.col("__nw_rows") + F.row_number().over(inside) - 1).alias("place"),
        "total",
    )


def assign_shards(docs: DataFrame, *, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, size (UTF-8 bytes and overhead), text_crc32, shard (from 0), slot (place in the shard, from 0)."""
    crc = F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    slim = stash(docs.select(*_keys(docs, id_col), _size(text_col, overhead).alias("size"), crc.alias("text_crc32")), "shard-sizes")
    # The middle of the document, in shards: exact in decimals, whatever the total is.
    middle = F.expr(f"cast(((2 * before + size) * cast({int(shards)} as decimal(9, 0))) div (2 * total) as int)")
    cut = stash(placed(slim, [_ID, _TIE], "size").withColumn("shard", middle), "shard-places")
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))
    rows = cut.join(F.broadcast(first), "shard")  # as many rows as there are shards
    return rows.select(F.col(_ID).alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def first_rows(docs: DataFrame, *, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """(shard, id, hash of all columns) of the first row of each shard that has one, in order."""
    slim = stash(docs.select(*_keys(docs, id_col), _size(text_col, overhead).alias("size")), "shard-sizes")
    middle = F.expr(f"cast(((2 * before + size) * cast({int(shards)} as decimal(9, 0))) div (2 * total) as int)")
    cut = placed(slim, [_ID, _TIE], "size").withColumn("shard", middle)
    first = cut.groupBy("shard").agg(F.min(F.struct("place", _ID, _TIE)).alias("first")).select("shard", "first.*").collect()
    return sorted((r["shard"], r[_ID], r[_TIE]) for r in first) if first else []


def write_shards(
    docs: DataFrame,
    path: str,
    *,
    shards: int = SHARDS,
    overhead: int = OVERHEAD,
    file_bytes: int = FILE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes docs as Parquet below path, a folder shard=K for each shard that has rows, with files of about file_bytes of text.

    Texts are shuffled once. Rows that are equal in all columns stay in one shard.
    """
    cuts = first_rows(docs, shards=shards, overhead=overhead, id_col=id_col, text_col=text_col)
    ident, tie = _keys(docs, id_col)
    if not cuts:
        docs.withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(path)
        return
    kind = docs.schema[id_col].dataType
    here = F.struct(ident, tie)
    starts = F.array(*(F.struct(F.lit(i).cast(kind).alias(_ID), F.lit(t).cast("long").alias(_TIE)) for _, i, t in cuts))
    numbers = F.array(*(F.lit(s) for s, _, _ in cuts))
    shard = F.element_at(numbers, F.greatest(F.size(F.filter(starts, lambda c: c <= here)), F.lit(1)))
    total = docs.agg(F.sum(_size(text_col, overhead))).first()[0]
    files = max(1, -(-total // (shards * file_bytes)))
    marked = docs.withColumn("shard", shard)
    marked.repartition(shards * files, "shard", F.pmod(tie, F.lit(files))).write.partitionBy("shard").parquet(path)
