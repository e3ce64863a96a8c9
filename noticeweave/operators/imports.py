"""Imports that add what is missing: identities by several keys in turn, current values kept, missing ones restored, conflicts left to a person.

A notice is the one with its address, or, without an address, the one with its school, department, title and time, or, without a time either, with its content. Rows of one
identity are put together by aggregation in their order (current ones first), so that any number of copies meet in partial sums and not in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeweave.functions.scalars import history_digest
from noticeweave.operators.graphs import _kept
from noticeweave.operators.hierarchy import connected


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def identity() -> Column:
    """The key of a notice (school, department, title, url, published_at, created_at, hash, body_text, body_html): one text that is equal for rows that are one notice."""
    stamp = F.coalesce("published_at", "created_at").cast("string")
    content = F.when(~_blank("hash"), F.col("hash")).otherwise(history_digest(F.col("title"), F.coalesce("body_text", F.lit("")), F.coalesce("body_html", F.lit(""))))
    by_address = F.to_json(F.struct(F.lit("address").alias("by"), "school", "url"))
    by_history = F.to_json(F.struct(F.lit("history").alias("by"), "school", "department", "title", F.coalesce(stamp, F.lit("")).alias("stamp"), F.when(stamp.isNull(), content).alias("content")))
    return F.when(~_blank("url"), by_address).otherwise(by_history)


def _first(column: str, there: Column) -> Column:
    """The value of the first row, in order, for which there holds."""
    return F.min_by(F.when(there, F.col(column)), F.when(there, F.col("__order")))


def merged_notices(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The notices after an import: kept (the current id, or that of the first incoming row of a new one), added, copies (incoming rows), restored (its body came from the import), and the values.

    Both tables: id, school, department, title, url (canonical), published_at, created_at, summary, body_text, body_html, hash. Values of the current row stay; summaries, days of publication and
    bodies that it lacks are the first that incoming rows have, a body as a whole. Current rows that share an identity stay separate, and the least id takes what is imported.
    """
    names = ["school", "department", "title", "url", "published_at", "created_at", "summary", "body_text", "body_html", "hash"]
    now = current.withColumn("__key", identity())
    least = now.groupBy("__key").agg(F.min("id").alias("id"))
    others = now.join(least, ["__key", "id"], "left_anti")
    rows = now.join(least, ["__key", "id"], "left_semi").select("__key", "id", F.lit(True).alias("__current"), *names).unionByName(incoming.withColumn("__key", identity()).select("__key", "id", F.lit(False).alias("__current"), *names))
    rows = rows.withColumns({"__order": F.struct((~F.col("__current")).alias("late"), "id"), "__body": ~_blank("body_text") | ~_blank("body_html")})
    first = F.min_by(F.struct("id", "__current", *(F.col(c).alias(f"f_{c}") for c in ("school", "department", "title", "url", "created_at", "hash")), F.col("__body").alias("f_body")), F.col("__order"))
    merged = rows.groupBy("__key").agg(
        first.alias("f"), F.count_if(~F.col("__current")).alias("copies"), F.bool_or("__body").alias("any_body"), _first("summary", ~_blank("summary")).alias("summary"),
        _first("published_at", F.col("published_at").isNotNull()).alias("published_at"), _first("body_text", F.col("__body")).alias("body_text"), _first("body_html", F.col("__body")).alias("body_html"),
    )
    had = F.col("f.__current") & F.col("f.f_body")
    made = merged.select(
        F.col("f.id").alias("kept"), (~F.col("f.__current")).alias("added"), "copies", (F.col("any_body") & ~had & (F.col("copies") > 0)).alias("restored"), F.col("f.f_school").alias("school"), F.col("f.f_department").alias("department"),
        F.col("f.f_title").alias("title"), F.col("f.f_url").alias("url"), "published_at", F.col("f.f_created_at").alias("created_at"), "summary", "body_text", "body_html",
    )
    alone = others.select(F.col("id").alias("kept"), F.lit(False).alias("added"), F.lit(0).cast("long").alias("copies"), F.lit(False).alias("restored"), *(c for c in names if c != "hash"))
    return made.unionByName(alone)


def import_map(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """id of each incoming row and kept, the notice that it became, with added."""
    now = current.withColumn("__key", identity()).groupBy("__key").agg(F.min("id").alias("now"))
    keyed = incoming.withColumn("__key", identity()).select("id", "__key")
    new = keyed.groupBy("__key").agg(F.min("id").alias("new"))
    return keyed.join(new, "__key").join(now, "__key", "left").select("id", F.coalesce("now", "new").alias("kept"), F.col("now").isNull().alias("added"))


def retitled(current: DataFrame, listed: DataFrame) -> DataFrame:
    """id and title of notices whose title a list corrects: seen at their own department under a title that is told to be a variant of the one they have. listed: school, url, department, nth, title, variants."""
    seen = listed.select("school", "url", "department", "nth", F.col("title").alias("new"), "variants")
    found = current.where(~_blank("url")).select("id", "school", "url", "department", "title").join(seen, ["school", "url", "department"])
    return found.where(F.array_contains("variants", F.col("title")) & (F.col("new") != F.col("title"))).groupBy("id").agg(F.min_by("new", "nth").alias("title"))


def school_identities(incoming: DataFrame, names: DataFrame) -> DataFrame:
    """name, school and state of incoming schools by all names that known ones have: known, new, or conflict where names hang together with several schools, which a person has to settle.

    names: school, name (of its record, its registration and aliases; normalised). Names and schools are nodes, and what hangs together is one component.
    """
    edges = names.select(F.concat(F.lit("n:"), "name").alias("a"), F.concat(F.lit("s:"), F.col("school").cast("string")).alias("b"))
    groups = _kept(connected(edges))
    schools = names.select("school").distinct().join(groups.select(F.col("node"), "component"), F.concat(F.lit("s:"), F.col("school").cast("string")) == F.col("node"))
    owned = schools.groupBy("component").agg(F.min("school").alias("school"), F.count(F.lit(1)).alias("n"))
    told = incoming.select("name").distinct().join(groups.select(F.expr("substring(node, 3)").alias("name"), "component", "node").where("node like 'n:%'").drop("node"), "name", "left").join(owned, "component", "left")
    return told.select("name", F.when(F.col("n") == 1, F.col("school")).alias("school"), F.when(F.col("n").isNull(), "new").when(F.col("n") == 1, "known").otherwise("conflict").alias("state"))
