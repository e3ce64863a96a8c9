"""Queries of the inbox: scopes, joins, sets and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.operators import joins, ranking, scope
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query

AS_OF = dt.datetime(1998, 8, 2)
_MEMBERS = ", members as (select id notice_id, department_id from notices where department_id is not null union select notice_id, department_id from appearances)"
_PAIRS = _MEMBERS + """, pairs as (
  select distinct s.user_id, m.notice_id from members m join departments d on d.id = m.department_id
  join schools c on c.id = d.school_id and c.enabled join subscriptions s on s.school_id = d.school_id)"""


def _members(d: Domain) -> DataFrame:
    return scope.memberships(d.notices, d.appearances)


def _open(d: Domain) -> DataFrame:
    return scope.allowed_departments(d.departments, d.schools)


def _scope(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _members(d), _open(d), d.subscriptions


@query(
    _PAIRS
    + """ select user_id, notice_id, title, place from (
  select p.user_id, n.id notice_id, n.title, row_number() over (partition by p.user_id order by n.published_at desc nulls last, n.created_at desc, n.id) place
  from pairs p join notices n on n.id = p.notice_id where not exists (select 1 from reads r where r.user_id = p.user_id and r.notice_id = p.notice_id)
  and contains(lower(n.title), 'urgent')) where place <= 40"""
)
def inbox_page(d: Domain) -> DataFrame:
    urgent = d.notices.where(scope.has_terms("urgent", ["title"])).withColumnRenamed("id", "notice_id")
    return scope.first_unread(urgent.where("notice_id is not null"), *_scope(d), d.reads, ranking.newest("notice_id"), 40).select("user_id", "notice_id", "title", "place")


@query(_MEMBERS + " select notice_id, department_id from members")
def memberships(d: Domain) -> DataFrame:
    return _members(d)


@query(_MEMBERS + " select distinct m.notice_id id from members m join departments d on d.id = m.department_id join schools s on s.id = d.school_id and s.enabled join notices n on n.id = m.notice_id")
def source_scope(d: Domain) -> DataFrame:
    return scope.in_departments(d.notices, _members(d), _open(d)).select("id")


@query(" select id, name from departments where coalesce(nullif(trim(group_name), ''), 'default') = 'default'")
def group_filter(d: Domain) -> DataFrame:
    return d.departments.where(scope.group_is("default")).select("id", "name")


@query(_PAIRS + " select user_id, count(*)::bigint n, count(*) filter (r.notice_id is null)::bigint n_unread from pairs left join reads r using (user_id, notice_id) group by 1")
def scope_totals(d: Domain) -> DataFrame:
    reads = scope.known(d.reads).groupBy("user_id", "notice_id").agg(F.count(F.lit(1)).alias("times"))
    seen = scope.in_scope(reads, *_scope(d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_read"), F.sum(F.col("times") - 1).alias("more"))
    none = F.lit(0).cast("long")
    return scope.scope_sizes(*_scope(d)).join(seen, "user_id", "left").select(
        "user_id", (F.col("n") + F.coalesce("more", none)).alias("n"), (F.col("n") - F.coalesce("n_read", none)).alias("n_unread")
    )


@query(_PAIRS + " select user_id, count(*)::bigint n, min(notice_id) least from pairs anti join reads using (user_id, notice_id) group by 1")
def unread_notices(d: Domain) -> DataFrame:
    seen = scope.in_scope(scope.known(d.reads), *_scope(d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_read"))
    left = scope.scope_sizes(*_scope(d)).join(seen, "user_id", "left").select("user_id", (F.col("n") - F.coalesce("n_read", F.lit(0))).alias("n")).where("n > 0")
    first = scope.first_unread(_members(d).select("notice_id").distinct(), *_scope(d), d.reads, [F.asc_nulls_last("notice_id")], 1)
    least = first.select(F.col("user_id").alias("__user"), F.col("notice_id").alias("least"))
    return left.join(least, F.col("user_id").eqNullSafe(F.col("__user"))).select("user_id", "n", "least")


@query(_PAIRS + " select user_id, notice_id from pairs semi join reads using (user_id, notice_id)")
def read_notices(d: Domain) -> DataFrame:
    return scope.in_scope(scope.known(d.reads), *_scope(d))


@query(" select id from notices where coalesce(published_at, created_at) >= timestamp '1998-07-26 00:00:00'")
def last_week(d: Domain) -> DataFrame:
    return d.notices.where(scope.in_last_week(AS_OF)).select("id")


@query(" select id from notices where year(coalesce(published_at, created_at)) = 1996 and month(coalesce(published_at, created_at)) = 12")
def archive_month(d: Domain) -> DataFrame:
    return d.notices.where(scope.in_month(1996, 12)).select("id")


@query("select doc_id from documents where contains(lower(coalesce(text, '')), 'and') and contains(lower(coalesce(text, '')), '%')", domain=False)
def keyword_search(d: Domain) -> DataFrame:
    return d.table("documents").where(scope.has_terms("AND %", ["text"])).select("doc_id")


@query("select doc_id from documents where coalesce(text, '') ilike '%an_d%' and (coalesce(text, '') ilike '%the%')", domain=False)
def global_search(d: Domain) -> DataFrame:
    return d.table("documents").where(scope.like_terms("an_d the", ["text"])).select("doc_id")


@query(" select distinct notice_id from states where starred or trashed_at >= timestamp '1998-07-03 00:00:00'")
def pinned_notices(d: Domain) -> DataFrame:
    return scope.pinned(d.states, AS_OF)


@query(" select distinct user_id, notice_id from states where not starred and trashed_at >= timestamp '1998-07-03 00:00:00'")
def trashed_notices(d: Domain) -> DataFrame:
    return scope.trash(d.states, AS_OF)


@query(_PAIRS + " select user_id, count(*)::bigint n from (select user_id, notice_id from pairs union select user_id, notice_id from states where starred or trashed_at >= timestamp '1998-07-03 00:00:00') group by 1")
def readable_notices(d: Domain) -> DataFrame:
    kept = d.states.where("starred").select("user_id", "notice_id").union(scope.trash(d.states, AS_OF)).distinct()
    others = kept.subtract(scope.in_scope(kept, *_scope(d))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return scope.scope_sizes(*_scope(d)).unionByName(others).groupBy("user_id").agg(F.sum("n").alias("n"))


@query(" select id from notices where id <= 1000000000 and published_at < timestamp '1999-01-01' and id not in (select notice_id from states where starred or trashed_at >= timestamp '1998-07-03 00:00:00')")
def cleanup_candidates(d: Domain) -> DataFrame:
    return scope.cleanup_scope(d.notices, dt.datetime(1999, 1, 1), 1_000_000_000, scope.pinned(d.states, AS_OF)).select("id")


@query("select doc_id, left(text, 150) excerpt from documents", domain=False)
def list_rows(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", scope.excerpt("text").alias("excerpt"))


@query(_MEMBERS + " select m.notice_id, m.department_id, d.name department, d.school_id, s.name school from members m join departments d on d.id = m.department_id join schools s on s.id = d.school_id and s.enabled")
def notice_sources(d: Domain) -> DataFrame:
    return joins.sources_of(_members(d), d.departments, d.schools)


@query(
    _MEMBERS
    + """ select m.notice_id, m.department_id, d.name department, s.name school, d.list_url, a.first_seen, a.last_seen, a.first_seen is not null observed
  from members m join departments d on d.id = m.department_id join schools s on s.id = d.school_id and s.enabled left join appearances a using (notice_id, department_id)"""
)
def publication_links(d: Domain) -> DataFrame:
    return joins.publication_links(_members(d), d.departments, d.schools, d.appearances)


@query(" select t.id, t.school_id, t.state, coalesce(s.name, 'deleted school #' || t.school_id) school from tasks t left join schools s on s.id = t.school_id")
def log_names(d: Domain) -> DataFrame:
    return joins.with_school_name(d.tasks.select("id", "school_id", "state"), d.schools)


@query(
    """, snap as (select o_orderkey notice_id, l_linenumber revision, case when l_returnflag = 'N' then o_orderpriority else l_returnflag end title
  from orders join lineitem on l_orderkey = o_orderkey), cur as (select o_orderkey notice_id, o_orderpriority title from orders)
  select notice_id, max(revision)::bigint revision from snap semi join cur using (notice_id, title) group by 1"""
)
def latest_summary(d: Domain) -> DataFrame:
    lines = d.table("lineitem").join(d.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    title = F.when(F.col("l_returnflag") == "N", F.col("o_orderpriority")).otherwise(F.col("l_returnflag"))
    snapshots = lines.select(F.col("o_orderkey").alias("notice_id"), F.col("l_linenumber").cast("long").alias("revision"), title.alias("title"))
    now = d.table("orders").select(F.col("o_orderkey").alias("notice_id"), F.col("o_orderpriority").alias("title"))
    return joins.latest_valid(now, snapshots, ["title"]).select("notice_id", "revision")


@query(
    """, a as (select id, title, published_at from notices where created_at < timestamp '1998-01-01'),
  b as (select id, case when title like '%O' then 'open' else title end title, published_at from notices where created_at >= timestamp '1996-01-01')
  select coalesce(a.id, b.id) id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end change
  from a full join b on a.id = b.id where a.id is null or b.id is null or a.title is distinct from b.title or a.published_at is distinct from b.published_at"""
)
def snapshot_delta(d: Domain) -> DataFrame:
    rows = d.notices.select("id", "title", "published_at", "created_at")
    before = rows.where("created_at < timestamp '1998-01-01'").drop("created_at")
    after = rows.where("created_at >= timestamp '1996-01-01'").drop("created_at").withColumn("title", F.when(F.endswith("title", F.lit("O")), "open").otherwise(F.col("title")))
    return joins.delta(before, after, "id")


@query(
    """, o as (select p_type name, min(p_brand) brand, max(p_size) size from part group by 1), e as (select distinct p_type name, p_brand brand, p_size size from part)
  select e.*, case when o.name is null then 'missing' when e.brand is distinct from o.brand then 'name' when e.size is distinct from o.size then 'brand' else 'size' end status from e left join o using (name)"""
)
def baseline_status(d: Domain) -> DataFrame:
    part = d.table("part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    observed = part.groupBy("name").agg(F.min("brand").alias("brand"), F.max("size").alias("size"))
    return joins.graded_match(part.distinct(), observed, "name", ["brand", "size"])


@query(_PAIRS + " select user_id, notice_id from pairs intersect select user_id, notice_id from states where starred")
def starred_in_scope(d: Domain) -> DataFrame:
    return scope.in_scope(d.states.where("starred").select("user_id", "notice_id"), *_scope(d))


@query(_MEMBERS + " select notice_id, department_id from members except select id, department_id from notices")
def observed_elsewhere(d: Domain) -> DataFrame:
    return _members(d).exceptAll(d.notices.select("id", "department_id").distinct())


@query(" select distinct notice_id, user_id from states where starred union select notice_id, user_id from reads")
def kept_or_read(d: Domain) -> DataFrame:
    return d.states.where("starred").select("notice_id", "user_id").union(d.reads.select("notice_id", "user_id")).distinct()


@query(
    """ select id, started, place from (select event_id id, ts started, row_number() over (order by ts desc, event_id desc) place
  from events, (select ts c, event_id i from events where event_id = (select max(event_id) from events)) where ts < c or ts = c and event_id < i) where place <= 201"""
)
def log_page(d: Domain) -> DataFrame:
    rows = d.table("events").select(F.col("event_id").alias("id"), F.col("ts").alias("started"))
    cursor = rows.agg(F.max_by(F.struct("started", "id"), "id").alias("c")).first().c
    return ranking.keyset(rows, [F.col("started"), F.col("id")], (cursor.started, cursor.id), 201)
