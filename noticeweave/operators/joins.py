"""Joins that enrich notices, resolve owners and compare states of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def sources_of(members: DataFrame, departments: DataFrame, schools: DataFrame) -> DataFrame:
    """notice_id, department_id, department, school_id, school of enabled schools. The dimensions are small sides that the planner measures."""
    d = departments.select(F.col("id").alias("department_id"), "school_id", F.col("name").alias("department"))
    s = schools.where("enabled").select(F.col("id").alias("school_id"), F.col("name").alias("school"))
    return members.join(d, "department_id").join(s, "school_id").select("notice_id", "department_id", "department", "school_id", "school")


def publication_links(members: DataFrame, departments: DataFrame, schools: DataFrame, appearances: DataFrame) -> DataFrame:
    """sources_of with where and when the notice was seen; never observed: the department's list and no times."""
    lists = departments.select(F.col("id").alias("department_id"), "list_url")
    return (
        sources_of(members, departments, schools)
        .join(lists, "department_id")
        .join(appearances, ["notice_id", "department_id"], "left")
        .select("notice_id", "department_id", "department", "school", "list_url", "first_seen", "last_seen", F.col("first_seen").isNotNull().alias("observed"))
    )


def with_school_name(logs: DataFrame, schools: DataFrame) -> DataFrame:
    """logs with the school's name, or a label for a deleted one."""
    names = schools.select(F.col("id").alias("school_id"), F.col("name").alias("known"))
    return logs.join(names, "school_id", "left").withColumn("school", F.coalesce("known", F.concat(F.lit("deleted school #"), F.col("school_id").cast("string")))).drop("known")


def latest_valid(notices: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """For each notice the newest of its snapshots whose keys still are the notice's."""
    same = snapshots.join(notices.select("notice_id", *keys), ["notice_id", *keys], "left_semi")
    newest = W.partitionBy("notice_id").orderBy(F.desc("revision"))
    return same.withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place")


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and change (added, removed, changed) between two states of a table."""
    columns = sorted(set(before.columns) - {key})
    b = before.select(key, F.struct(*columns).alias("b"), F.lit(True).alias("in_b"))
    a = after.select(key, F.struct(*columns).alias("a"), F.lit(True).alias("in_a"))
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def graded_match(expected: DataFrame, observed: DataFrame, name: str, levels: list[str]) -> DataFrame:
    """For each expected row how far an observed one of its name agrees: missing, name, then each level in turn."""
    o = observed.select(name, *(F.col(c).alias(f"o_{c}") for c in levels))
    agreed, grade = F.col("seen"), F.when(F.col("seen"), 1).otherwise(0)
    for i, c in enumerate(levels):
        agreed = agreed & F.col(c).eqNullSafe(F.col(f"o_{c}"))
        grade = F.when(agreed, i + 2).otherwise(grade)
    labels = F.array(*map(F.lit, ["missing", "name", *levels]))
    scored = expected.join(o.withColumn("seen", F.lit(True)), name, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return scored.withColumn("grade", grade).groupBy(*expected.columns).agg(F.max("grade").alias("grade")).withColumn("status", F.element_at(labels, F.col("grade") + 1)).drop("grade")


def similar_lists(samples: DataFrame, list_col: str, item_col: str, least: int = 2) -> DataFrame:
    """Pairs of lists with at least so many items in common, and how many."""
    s = samples.select(list_col, item_col).distinct()
    a, b = s.withColumnRenamed(list_col, "a"), s.withColumnRenamed(list_col, "b")
    return a.join(b, item_col).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= least)


def alias_edges(pages: DataFrame, url: str, final: str) -> DataFrame:
    """Redirects as edges in both directions."""
    moved = pages.where(F.col(url) != F.col(final)).select(F.col(url).alias("a"), F.col(final).alias("b"))
    return moved.union(moved.select("b", "a")).distinct()


def fresh_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """edges (parent, content_hash) whose parent page is fetched and still has the content they were found in."""
    now = pages.where("state = 'fetched'").select(F.col("url").alias("parent"), F.col("hash").alias("content_hash"))
    return edges.join(now, ["parent", "content_hash"], "left_semi")


def same_pages(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """a, b: addresses of one page, by a key that is equal for them; both have url."""
    a, b = left.select(F.col("url").alias("a"), "url"), right.select(F.col("url").alias("b"), "url")
    return a.select("a", key.alias("k")).join(b.select("b", key.alias("k")), "k").select("a", "b")


def by_identity(rows: DataFrame, known: DataFrame, key: str, alias: str) -> DataFrame:
    """rows with id and how of the known row: by key, or else by an alias that only one has; several are a conflict. Both have key and alias."""
    by_key = known.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("k_id"), F.count(F.lit(1)).alias("k_n"))
    by_alias = known.where(F.col(alias).isNotNull()).groupBy(alias).agg(F.min("id").alias("a_id"), F.count(F.lit(1)).alias("a_n"))
    joined = rows.join(by_key, key, "left").join(by_alias, alias, "left")
    how = F.when(F.col("k_n") == 1, "key").when(F.col("k_n") > 1, "conflict").when(F.col("a_n") == 1, "alias").when(F.col("a_n") > 1, "conflict").otherwise("new")
    return joined.withColumn("how", how).withColumn("id", F.when(F.col("how") == "key", F.col("k_id")).when(F.col("how") == "alias", F.col("a_id"))).drop("k_id", "k_n", "a_id", "a_n")


def witnessed(evidence: DataFrame, material: DataFrame, key: str) -> DataFrame:
    """key, valid, gaps: a relation holds if each of its pieces of evidence (url, locator, hash) still is in the material; what isn't is a gap."""
    there = material.select("url", "locator", "hash", F.lit(True).alias("there")).distinct()
    joined = evidence.join(there, ["url", "locator", "hash"], "left")
    return joined.groupBy(key).agg(F.bool_and(F.col("there").isNotNull()).alias("valid"), F.count_if(F.col("there").isNull()).alias("gaps"))


def acceptance(scope: DataFrame, schools: DataFrame, key: str) -> DataFrame:
    """key, state and school of a frozen scope: not_registered, identity_conflict, or ready or pending by the school's own flag."""
    found = schools.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("school_id"), F.bool_and("ready").alias("ready"))
    state = F.when(F.col("n").isNull(), "not_registered").when(F.col("n") > 1, "identity_conflict").when(F.col("ready"), "ready").otherwise("pending")
    return scope.join(found, key, "left").select(key, state.alias("state"), F.when(F.col("n") == 1, F.col("school_id")).alias("school_id"))


def mobile_rows(notices: DataFrame, sources: DataFrame, *, unread: bool = False, starred: bool = False, since: str | None = None, query: str = "") -> DataFrame:
    """notices with their source's name; dates are texts and '' is unknown. Filters add up."""
    from noticeweave.operators.scope import has_terms

    rows = notices.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    rows = rows.where(~F.col("is_read")) if unread else rows
    rows = rows.where("is_starred") if starred else rows
    rows = rows.where((F.col("day") != "") & (F.col("day") >= since)) if since else rows
    return rows.where(has_terms(query, ["title", "source"])) if query else rows


def same_lists(samples: DataFrame, lists: DataFrame, least: int = 2) -> DataFrame:
    """list and group of lists that are the same: equal names and titles, and least items in common with the group's first list, whatever the scheme.

    Lists only meet the first one of their name and title, so that no pairs are made. samples: list, url; lists: list, name, title.
    """
    first = lists.groupBy("name", "title").agg(F.min("list").alias("group"))
    placed = lists.join(first, ["name", "title"]).select("list", "group")
    items = samples.select("list", F.regexp_replace("url", "^https?:", "").alias("item")).distinct()
    theirs = items.withColumnRenamed("list", "group")
    shared = items.join(placed, "list").join(theirs, ["group", "item"]).groupBy("list", "group").agg(F.count(F.lit(1)).alias("common"))
    return shared.where(F.col("common") >= least).select("list", "group")


def monitored(edges: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, url and how many edges or nodes of each page still belong to its content. Bodies aren't read."""
    now = pages.select("url", "hash")
    kept = edges.select(F.lit("edge").alias("kind"), F.col("parent").alias("url"), "hash").unionByName(nodes.select(F.lit("node").alias("kind"), F.col("reference").alias("url"), "hash"))
    return kept.join(now, ["url", "hash"], "left_semi").groupBy("kind", "url").agg(F.count(F.lit(1)).alias("n"))


def looked_up(wanted: DataFrame, pages: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of wanted keys, with found; the planner broadcasts whichever side is small."""
    return wanted.select(key).distinct().join(pages.select(key, *columns, F.lit(True).alias("found")), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
