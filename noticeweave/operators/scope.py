"""Which notices a reader sees: memberships, scopes and predicates, all as semi- and anti-joins."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from itertools import count
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from noticeweave.tables import written

#: Terms and characters of a query that count.
MOST_TERMS, MOST_CHARS = 10, 200
WEEK_DAYS, TRASH_DAYS = 7, 30


def memberships(notices: DataFrame, appearances: DataFrame) -> DataFrame:
    """notice_id, department_id: the original department and all observed ones, once each."""
    original = notices.where("department_id is not null").select(F.col("id").alias("notice_id"), "department_id")
    return original.union(appearances.select("notice_id", "department_id")).distinct()


def allowed_departments(departments: DataFrame, schools: DataFrame, *, include_disabled: bool = False) -> DataFrame:
    active = schools if include_disabled else schools.where("enabled")
    return departments.join(active.select(F.col("id").alias("school_id")), "school_id", "left_semi")


def group_is(group: str, default: str = "default") -> Column:
    """The group's name without outer blanks; none is the default."""
    return F.coalesce(F.nullif(F.trim("group_name"), F.lit("")), F.lit(default)) == group


def in_departments(notices: DataFrame, members: DataFrame, departments: DataFrame) -> DataFrame:
    """Notices that are in any of the departments."""
    inside = members.join(departments.select(F.col("id").alias("department_id")), "department_id", "left_semi")
    return notices.join(inside.select(F.col("notice_id").alias("id")), "id", "left_semi")


def readers(subscriptions: DataFrame) -> DataFrame:
    """user_id and school_ids, all that a reader is subscribed to, in order: readers with the same ones have the same scope, which is made once for them."""
    return subscriptions.where("school_id is not null").groupBy("user_id").agg(F.array_sort(F.collect_set("school_id")).alias("school_ids"))


def school_notices(members: DataFrame, departments: DataFrame) -> DataFrame:
    """notice_id, school_id of all notices that departments have."""
    owned = departments.select(F.col("id").alias("department_id"), "school_id")
    return members.join(owned, "department_id").select("notice_id", "school_id").distinct()


def shared_scopes(readers: DataFrame, held: DataFrame) -> DataFrame:
    """school_ids, notice_id: what readers of each set of schools see, of held (notice_id, school_id)."""
    sets = readers.select("school_ids").distinct().select("school_ids", F.explode("school_ids").alias("school_id"))
    return sets.join(held, "school_id").select("school_ids", "notice_id").distinct()


def subscribed_pairs(members: DataFrame, departments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """user_id, notice_id for all that readers subscribed to; subscriptions of no school give nothing."""
    each = readers(subscriptions)
    return each.join(shared_scopes(each, school_notices(members, departments)), "school_ids").select("user_id", "notice_id")


def scope_sizes(members: DataFrame, departments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """user_id and n, how many notices a reader is subscribed to, one at least: counted by sets of schools, without pairs."""
    each = readers(subscriptions)
    sizes = shared_scopes(each, school_notices(members, departments)).groupBy("school_ids").agg(F.count(F.lit(1)).alias("n"))
    return each.join(sizes, "school_ids").select("user_id", "n")


def in_scope(given: DataFrame, members: DataFrame, departments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The different rows of given (user_id, notice_id and others) that readers are subscribed to: given rows are looked up, no others are made. Nulls are equal here."""
    mine = subscriptions.where("school_id is not null").select(F.col("user_id").alias("__user"), F.col("school_id").alias("__school")).distinct()
    held = school_notices(members, departments).select(F.col("notice_id").alias("__notice"), "school_id")
    rows = given.distinct().join(mine, F.col("user_id").eqNullSafe(F.col("__user")))
    return rows.join(held, F.col("notice_id").eqNullSafe(F.col("__notice")) & (F.col("__school") == F.col("school_id")), "left_semi").select(*given.columns).distinct()


def known(pairs: DataFrame) -> DataFrame:
    """user_id, notice_id of pairs without nulls, which equal nothing."""
    return pairs.select("user_id", "notice_id").where("user_id is not null and notice_id is not null")


def first_unread(
    found: DataFrame, members: DataFrame, departments: DataFrame, subscriptions: DataFrame, reads: DataFrame, order: list[Column], size: int
) -> DataFrame:
    """user_id, columns of found (notice_id and others) and place: each reader's first size unread ones in order.

    Notices are ranked once for each set of schools. A reader's first ones are among as many as size and what was read together, and are found by their ranks.
    """
    each = readers(subscriptions)
    seen = known(reads).distinct()
    most = size + (seen.join(found.select("notice_id"), "notice_id").groupBy("user_id").count().agg(F.max("count")).first()[0] or 0)
    rows = shared_scopes(each, school_notices(members, departments)).join(found.withColumnRenamed("notice_id", "__notice"), F.col("notice_id").eqNullSafe(F.col("__notice"))).drop("__notice")
    ranked = written(rows.withColumn("__rank", F.row_number().over(W.partitionBy("school_ids").orderBy(*order))).where(F.col("__rank") <= most))
    gone = each.join(seen, "user_id").join(ranked.select("school_ids", "notice_id", "__rank"), ["school_ids", "notice_id"]).groupBy("user_id").agg(F.collect_list("__rank").alias("gone"))
    gone = each.join(gone, "user_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    first = F.slice(F.array_except(F.sequence(F.lit(1), size + F.size("gone")), "gone"), 1, size)
    places = gone.select("user_id", "school_ids", F.posexplode(first).alias("place", "__rank"))
    return places.join(ranked, ["school_ids", "__rank"]).select("user_id", *found.columns, (F.col("place") + 1).alias("place"))


def unread(pairs: DataFrame, reads: DataFrame) -> DataFrame:
    return pairs.join(reads.select("user_id", "notice_id"), ["user_id", "notice_id"], "left_anti")


def read(pairs: DataFrame, reads: DataFrame) -> DataFrame:
    return pairs.join(reads.select("user_id", "notice_id"), ["user_id", "notice_id"], "left_semi")


def effective_time() -> Column:
    return F.coalesce("published_at", "created_at")


def in_last_week(as_of: dt.datetime) -> Column:
    return effective_time() >= F.lit(as_of - dt.timedelta(days=WEEK_DAYS))


def in_month(year: int, month: int | None = None) -> Column:
    """As a range, so that files and row groups outside are skipped."""
    start = dt.datetime(year, month or 1, 1)
    end = dt.datetime(year + (month in (None, 12)), 1 if month in (None, 12) else month + 1, 1)
    return (effective_time() >= F.lit(start)) & (effective_time() < F.lit(end))


def terms(query: str) -> list[str]:
    return query[:MOST_CHARS].split()[:MOST_TERMS]


def has_terms(query: str, columns: list[str]) -> Column:
    """Every term in any column, whatever its case; signs are literal."""
    each = [reduce(or_, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t.lower())) for c in columns)) for t in terms(query)]
    return reduce(and_, each, F.lit(True))


def like_terms(query: str, columns: list[str]) -> Column:
    """Like has_terms, but % and _ are wildcards."""
    each = [reduce(or_, (F.coalesce(F.col(c), F.lit("")).ilike(f"%{t}%") for c in columns)) for t in query.split()]
    return reduce(and_, each, F.lit(True))


def pinned(states: DataFrame, as_of: dt.datetime) -> DataFrame:
    """notice_id of what anyone starred, or put into the trash not long ago."""
    fresh = F.col("trashed_at") >= F.lit(as_of - dt.timedelta(days=TRASH_DAYS))
    return states.where(F.col("starred") | fresh).select("notice_id").distinct()


def trash(states: DataFrame, as_of: dt.datetime) -> DataFrame:
    fresh = F.col("trashed_at") >= F.lit(as_of - dt.timedelta(days=TRASH_DAYS))
    return states.where(~F.col("starred") & fresh).select("user_id", "notice_id").distinct()


def readable(pairs: DataFrame, states: DataFrame, as_of: dt.datetime) -> DataFrame:
    """user_id, notice_id in scope, starred or in the trash."""
    starred = states.where("starred").select("user_id", "notice_id")
    return pairs.union(starred).union(trash(states, as_of)).distinct()


def cleanup_scope(notices: DataFrame, before: dt.datetime, most_id: int, kept: DataFrame) -> DataFrame:
    """Dated notices before a day, up to an id, that nobody pinned."""
    old = notices.where((F.col("id") <= most_id) & (F.col("published_at") < F.lit(before)))
    return old.join(kept.select(F.col("notice_id").alias("id")), "id", "left_anti")


def inbox(
    notices: DataFrame, members: DataFrame, departments: DataFrame, subscriptions: DataFrame, reads: DataFrame, *, only_unread: bool = True, query: str = ""
) -> DataFrame:
    """user_id and the columns of notices: what each reader has in the inbox."""
    pairs = subscribed_pairs(members, departments, subscriptions)
    pairs = unread(pairs, reads) if only_unread else pairs
    found = notices.where(has_terms(query, ["title"])) if query else notices
    return pairs.join(found.withColumnRenamed("id", "notice_id"), "notice_id")


def excerpt(column: str, chars: int = 150) -> Column:
    return F.substring(column, 1, chars)


def expanded_subscriptions(subscriptions: DataFrame, departments: DataFrame, directory: DataFrame) -> DataFrame:
    """user_id, department_id of each subscription (user_id, school_id, department_ids): null is all of the school, an empty list nothing, and
    others are with all that the directory (parent, child) has below them.
    """
    from noticeweave.operators.graphs import descendants

    owned = departments.select(F.col("id").alias("department_id"), "school_id")
    # equal subscriptions are expanded once, and what they give is told apart before there are rows of readers
    held = subscriptions.groupBy("user_id").agg(F.array_sort(F.collect_set(F.struct("school_id", "department_ids"))).alias("wanted"))
    each = held.select("wanted").distinct().select("wanted", F.explode("wanted").alias("w")).select("wanted", "w.*")
    whole = each.where("department_ids is null").join(owned, "school_id").select("wanted", "department_id")
    chosen = each.select("wanted", "school_id", F.explode("department_ids").alias("department_id"))
    # closures are of departments, not of readers: each is expanded once
    starts = chosen.select("department_id").distinct().join(directory.select(F.col("parent").alias("department_id")), "department_id", "left_semi")
    below = reachable_pairs(directory, starts.select(F.col("department_id").alias("node"))).join(owned.withColumnRenamed("department_id", "node"), "node")
    more = chosen.join(below.withColumnRenamed("root", "department_id"), ["department_id", "school_id"]).select("wanted", F.col("node").alias("department_id"))
    named = chosen.join(owned, ["department_id", "school_id"], "left_semi").select("wanted", "department_id")
    found = whole.unionByName(named).unionByName(more).distinct()
    return held.join(found, "wanted").select("user_id", "department_id")


def reachable_pairs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node: all nodes below each root, by joins that end at a fixpoint.

    Rounds are tables: plans of checkpointed ones keep estimates and constraints of all rounds before, which fill the driver. Nothing is broadcast, since all may grow.
    """
    below = written(edges.select(F.col("parent").alias("node"), "child").distinct()).hint("merge")
    pairs = written(roots.select(F.col("node").alias("root"), "node").distinct())
    seen = None
    for turn in count(1):
        step = pairs.join(below, "node").select("root", F.col("child").alias("node")).where("root <> node").distinct()
        pairs = written(step if seen is None else step.join(seen.hint("merge"), ["root", "node"], "left_anti"))
        if pairs.isEmpty():
            return pairs if seen is None else seen
        seen = pairs if seen is None else seen.unionByName(pairs)
        if turn % 16 == 0:  # a union of many tables makes long plans
            seen = written(seen)


def normalised(args: dict[str, str]) -> dict[str, str]:
    """Arguments of an inbox with defaults: mailbox inbox, saved or trash; period week, all or archive (the inbox: week, others: all)."""
    args = dict(args)
    view = args.pop("view", "inbox")
    if view == "archived" or (view == "focus" and args.get("mailbox") == "archived"):
        args.pop("mailbox", None)
        args.setdefault("period", "all")
        view = "inbox" if view == "archived" else view
    mailbox = args.get("mailbox", "inbox") if view == "focus" else view
    args["mailbox"] = mailbox if mailbox in ("inbox", "saved", "trash") else "inbox"
    period = args.get("period", "week" if args["mailbox"] == "inbox" else "all")
    args["period"] = period if period in ("week", "all", "archive") else "week"
    return args


def in_period(args: dict[str, str], as_of: dt.datetime) -> Column:
    year, month = (int(args[k]) if args.get(k, "").isdigit() else 0 for k in ("year", "month"))
    if args["period"] == "week" or (args["period"] == "archive" and not year):
        return in_last_week(as_of)
    if args["period"] == "archive":
        return in_month(year, month if 1 <= month <= 12 else None)
    return F.lit(True)


def filtered_inbox(
    args: dict[str, str], as_of: dt.datetime, notices: DataFrame, members: DataFrame, departments: DataFrame, schools: DataFrame, subscriptions: DataFrame, states: DataFrame,
    reads: DataFrame, *, chosen: list[int] | None = None, text_columns: tuple[str, ...] = ("title",),
) -> DataFrame:
    """user_id and the columns of notices that readers see with args (mailbox, school, group, period, year, month, q, read) and chosen departments.

    Saved and trashed notices stay visible without a subscription and in disabled schools. Notices are chosen before there are rows of readers, and read ones are looked up.
    """
    args = normalised(args)
    saved = args["mailbox"] != "inbox"
    place = allowed_departments(departments, schools, include_disabled=saved)
    narrowed = args.get("school") or args.get("group") or chosen is not None
    if args.get("school"):
        place = place.where(F.col("school_id") == int(args["school"]))
    if args.get("group"):
        place = place.where(group_is(args["group"]))
    if chosen is not None:
        place = place.where(F.col("id").isin(*chosen)) if chosen else place.where(F.lit(False))
    found = notices.where(in_period(args, as_of))
    if args.get("q", "").strip():
        found = found.where(has_terms(args["q"].strip(), list(text_columns)))
    if narrowed or not saved:
        found = in_departments(found, members, place)
    if args["mailbox"] == "saved":
        mine = states.where("starred").select("user_id", "notice_id").distinct()
    elif args["mailbox"] == "trash":
        mine = trash(states, as_of)
    else:
        active, these = allowed_departments(departments, schools), found.select(F.col("id").alias("notice_id"))
        if args.get("read") == "read":
            mine = in_scope(known(reads).join(these, "notice_id", "left_semi"), members, active, subscriptions)
        else:
            mine = subscribed_pairs(members.join(these, "notice_id", "left_semi"), active, subscriptions)
    rows = mine.join(found.withColumnRenamed("id", "notice_id"), "notice_id")
    if args.get("read") in ("read", "unread"):
        rows = rows.join(reads.select("user_id", "notice_id"), ["user_id", "notice_id"], "left_semi" if args["read"] == "read" else "left_anti")
    return rows


def title_has(query: str, column: str = "title") -> Column:
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(query.strip().lower()))


def in_directory(schools: DataFrame, query: str = "", province: int | None = None) -> DataFrame:
    """Schools whose name without signs, or address, has the query, in a province."""
    from noticeweave.functions.scalars import bare

    rows = schools if province is None else schools.where(F.col("province") == province)
    q = query.strip().lower()
    return rows.where(F.contains(F.lower(bare(F.col("name"))), F.lower(bare(F.lit(q)))) | F.contains(F.lower("url"), F.lit(q))) if q else rows


def channels_with(channels: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Channels that have all terms in their breadcrumb or address, compatible forms (full width, ligatures) and case aside."""
    import unicodedata

    wanted = unicodedata.normalize("NFKC", query).casefold().split()
    hay = folded(F.concat_ws(" ", *columns))
    return channels.where(reduce(and_, (F.contains(hay, F.lit(t)) for t in wanted), F.lit(True)))


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC").str.casefold()


def folded(text: Column) -> Column:
    """NFKC and case folding, in Arrow batches."""
    return _fold(text)


def active_sources(departments: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Departments whose newest lifecycle event isn't one of retirement. lifecycle: department_id, at, state."""
    last = lifecycle.groupBy("department_id").agg(F.max_by("state", "at").alias("state")).where("state in ('retired', 'merged')")
    return departments.join(last.select(F.col("department_id").alias("id")), "id", "left_anti")


def active_schools(schools: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Enabled schools with a subscriber."""
    return schools.where("enabled").join(subscriptions.select(F.col("school_id").alias("id")), "id", "left_semi")


def collected_sources(departments: DataFrame, directory: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Departments to collect from: they have a list's address, aren't units or groups, aren't parents in the directory, and are wanted (department_id)."""
    rows = departments.where((F.coalesce("list_url", F.lit("")) != "") & ~F.col("kind").isin("unit", "group"))
    rows = rows.join(directory.select(F.col("parent").alias("id")), "id", "left_anti")
    return rows if wanted is None else rows.join(wanted.select(F.col("department_id").alias("id")), "id", "left_semi")


def graph_scope(pages: DataFrame, school_host: str) -> DataFrame:
    """pages (url, host, kind, state) with omitted: '' for those that a graph shows, else why not."""
    local = (F.col("host") == school_host) | F.endswith("host", F.lit("." + school_host))
    reason = F.when(~local, "outside").when(F.col("state") == "failed", "unread").when(F.col("kind").isin("article", "document"), "content").otherwise("")
    return pages.withColumn("omitted", reason)
