"""Next states of tables: upserts, merges of duplicates and journals, as pure functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current and those rows of incoming whose keys it lacks."""
    return current.unionByName(incoming.join(current.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def merge_appearances(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The first and last times seen of both tables, by notice and department."""
    both = current.unionByName(incoming)
    return both.groupBy("notice_id", "department_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merge_duplicates(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """One row for each key: the greatest id, the earliest created, the newest title, any flag, and how many there were."""
    return rows.groupBy(*keys).agg(
        F.max(ident).alias(ident), F.min("created_at").alias("created_at"), F.max_by("title", F.struct("created_at", ident)).alias("title"),
        F.bool_or("starred").alias("starred"), F.count(F.lit(1)).alias("copies"),
    )


def alias_map(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """From each merged id to the one that stays."""
    last = rows.groupBy(*keys).agg(F.max(ident).alias("kept"))
    return rows.join(last, keys).where(F.col(ident) != F.col("kept")).select(F.col(ident), "kept")


def changed(current: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """key and changed for rows in both: a missing digest proves nothing."""
    new = incoming.select(key, F.col(digest).alias("new"))
    return current.join(new, key).select(key, F.coalesce(F.col(digest) != F.col("new"), F.lit(False)).alias("changed"))


def enqueue(pages: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The least priority (and its kind) and depth of each page."""
    both = pages.unionByName(found)
    return both.groupBy(key).agg(F.min_by("kind", F.struct("priority", "kind")).alias("kind"), F.min("priority").alias("priority"), F.min("depth").alias("depth"))


def replace_parents(edges: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """edges with all of a parent's rows replaced where fresh has the parent."""
    return edges.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def mark_read(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """The reads to append: pairs that aren't there yet."""
    return pairs.join(reads.select("user_id", "notice_id"), ["user_id", "notice_id"], "left_anti")


def toggle_star(states: DataFrame, at: str) -> DataFrame:
    """Starring takes a notice out of the trash; unstarring puts it there."""
    return states.withColumns({"trashed_at": F.when(F.col("starred"), F.col(at)).otherwise(F.lit(None).cast("timestamp")), "starred": ~F.col("starred")})


def newest_wins(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(at, *(c for c in others if c != at))).alias("r")).select(*keys, "r.*")


def new_owner(members: DataFrame, deleted: DataFrame) -> DataFrame:
    """For notices of deleted departments the least department that remains, if any."""
    gone = members.join(deleted.select("department_id"), "department_id", "left_semi").select("notice_id").distinct()
    rest = members.join(deleted.select("department_id"), "department_id", "left_anti").groupBy("notice_id").agg(F.min("department_id").alias("department_id"))
    return gone.join(rest, "notice_id", "left")


def without_dangling(edges: DataFrame, pages: DataFrame, parent: str, key: str) -> DataFrame:
    return edges.join(pages.select(F.col(key).alias(parent)), parent, "left_semi")


def journal(changes: DataFrame, key: str, start: int = 0) -> DataFrame:
    """Changes with revisions that go on from start, by key and order of the change."""
    return changes.withColumn("revision", F.row_number().over(W.partitionBy(key).orderBy("id", "change")) + start)


def since(log: DataFrame, key: str, revision: int) -> DataFrame:
    """key, n and complete: whether the changes after a revision have no gap (else start anew)."""
    later = log.where(F.col("revision") > revision)
    return later.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.max("revision") - revision == F.count(F.lit(1))).alias("complete"))


def _signed(edges: DataFrame, parent: str, name: str) -> DataFrame:
    """parent and a signature of its different rows, whatever their order."""
    row = F.substring(F.md5(F.to_json(F.struct(*sorted(edges.columns)))), 1, 12)
    each = edges.distinct().withColumn("__h", F.conv(row, 16, 10).cast("decimal(20,0)"))
    return each.groupBy(parent).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum("__h")).alias(name))


def archived(edges: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """The rows that a snapshot replaces and that go to the history: those of parents in fresh whose rows aren't the same as before."""
    both = _signed(edges, parent, "old").join(_signed(fresh, parent, "new"), parent).where("old <> new")
    return edges.join(both.select(parent), parent, "left_semi")


def preview(rows: DataFrame, ident: str, at: str) -> DataFrame:
    """n and token of what a deletion would take: the token changes if a row comes, goes or gets another date. No order is needed."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(ident).cast("string"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"))), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(row), F.lit(0)).cast("string")).alias("token"))


def deleted(table: DataFrame, scope: DataFrame, ident: str, at: str, token: str) -> DataFrame:
    """table without scope, if scope still has the token of its preview; else as it is."""
    same = preview(scope, ident, at).select(F.col("token") == token).scalar()
    return table.join(scope.where(same).select(ident), ident, "left_anti")
