"""Queries of counts, ledgers, windows and merges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.operators import aggregates, merge, ranking, scope, windows
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query

_MEMBERS = ", members as (select id notice_id, department_id from notices where department_id is not null union select notice_id, department_id from appearances)"
_CALLS = """with calls as (
  select event_id execution_id, event_type model, user_id page, case when event_type = 'view' then null else user_id end branch, ts at_,
         case when value >= 0 and event_type <> 'error' then floor(value)::bigint end tokens, case when event_type <> 'error' then floor(value)::bigint + 7 end input_tokens,
         floor(value / 2)::bigint hit from events)"""


def _calls(d: Domain) -> DataFrame:
    """Model calls: events, with tokens from their values; errors have unknown usage."""
    value = F.floor("value").cast("long")
    fine = F.col("event_type") != "error"
    return d.table("events").select(
        F.col("event_id").alias("execution_id"), F.col("event_type").alias("model"), F.col("user_id").alias("page"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("branch"), F.col("ts").alias("at"),
        F.when((F.col("value") >= 0) & fine, value).alias("tokens"), F.when(fine, value + 7).alias("input_tokens"), F.floor(F.col("value") / 2).cast("long").alias("hit"),
    )


def _members(d: Domain) -> DataFrame:
    return scope.memberships(d.notices, d.appearances)


@query(_MEMBERS + " select department_id, count(*)::bigint n from members group by 1")
def source_counts(d: Domain) -> DataFrame:
    return aggregates.per_source(_members(d))


@query(_MEMBERS + " select d.school_id, count(distinct m.notice_id)::bigint n from members m join departments d on d.id = m.department_id group by 1")
def school_counts(d: Domain) -> DataFrame:
    return aggregates.per_school(_members(d), d.departments)


@query(
    _MEMBERS + """ select m.department_id, count(*)::bigint n, count(*) filter (r.notice_id is not null)::bigint n_read, max(n.published_at) newest
  from members m join notices n on n.id = m.notice_id left join (select distinct notice_id from reads) r on r.notice_id = m.notice_id group by 1"""
)
def channel_stats(d: Domain) -> DataFrame:
    return aggregates.channel_stats(_members(d), d.notices, d.reads)


@query(" select distinct year(published_at)::bigint y from notices where published_at is not null")
def available_years(d: Domain) -> DataFrame:
    return d.notices.where("published_at is not null").select(F.year("published_at").cast("long").alias("y")).distinct()


_RECENT = "from (select *, json_extract_string(props, '$.k')::bigint k from tasks where queued_at > timestamp '2024-01-13 12:00:00' and queued_at <= timestamp '2024-01-20 12:00:00')"


@query(f" select count(*)::bigint n, count(*) filter (state = 'purchase')::bigint n_good, count(*) filter (state = 'error')::bigint n_bad, coalesce(sum(k), 0)::bigint \"new\", case when count(*) filter (state in ('purchase', 'error')) > 0 then (count(*) filter (state = 'purchase') * 10000 // count(*) filter (state in ('purchase', 'error')))::bigint end success {_RECENT}")
def outcome_stats(d: Domain) -> DataFrame:
    logs = d.tasks.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return aggregates.outcomes(logs, "state", "purchase", "error", "k", "queued_at", dt.datetime(2024, 1, 20, 12))


@query(" select s state, c capability, count(*)::bigint n, case when s = 'pending' then greatest(0, epoch(timestamp '2030-01-01') - floor(epoch(min(queued_at))))::bigint end oldest_s from (select *, case when state = 'view' then 'pending' else state end s, ['http', 'browser', 'model'][id % 3 + 1] c from tasks) group by 1, 2")
def queue_metrics(d: Domain) -> DataFrame:
    capability = F.element_at(F.array(F.lit("http"), F.lit("browser"), F.lit("model")), (F.col("id") % 3 + 1).cast("int"))
    tasks = d.tasks.withColumns({"state": F.when(F.col("state") == "view", "pending").otherwise(F.col("state")), "capability": capability})
    return aggregates.queue_metrics(tasks, dt.datetime(2030, 1, 1))


@query(
    """, o as (select *, case when state in ('error', 'purchase') then 0 when state = 'click' then 1 else 2 end u from tasks)
  select m.id task_id, count(*)::bigint ahead from o, (select * from o where id = (select max(id) from o)) m where (o.u, o.queued_at, o.id) < (m.u, m.queued_at, m.id) group by 1"""
)
def queue_ahead(d: Domain) -> DataFrame:
    tasks = d.tasks
    last = tasks.agg(F.max("id").alias("last")).first().last
    return aggregates.queue_ahead(tasks, ranking.claim_order(), tasks.where(F.col("id") == last))


@query(" select case when title like '%F' then 'body' else 'attachment' end kind, n.id in (select notice_id from states where starred) pinned, count(*)::bigint n, coalesce(sum(case when id % 4 > 0 then content_bytes end), 0)::bigint bytes from notices n group by 1, 2")
def storage_usage(d: Domain) -> DataFrame:
    rows = d.notices.withColumn("content_bytes", F.when(F.col("id") % 4 > 0, F.col("content_bytes")))
    return aggregates.storage_usage(rows, d.states.where("starred").select("notice_id").distinct(), F.when(F.endswith("title", F.lit("F")), "body").otherwise("attachment"))


@query(
    _CALLS + """ select day::date as day, coalesce(tokens, 0)::bigint tokens from (select unnest(generate_series(date '2024-01-31' - 364, date '2024-01-31', interval 1 day))::date as day)
  left join (select (at_ + interval 480 minute)::date as day, sum(tokens) tokens from calls group by 1) using (day)""",
    domain=False,
)
def usage_calendar(d: Domain) -> DataFrame:
    return aggregates.calendar(_calls(d), dt.date(2024, 1, 31), 365, 480).withColumn("tokens", F.col("tokens").cast("long"))


@query(_CALLS + " select branch, count(*)::bigint calls, sum(tokens)::bigint tokens from calls group by 1", domain=False)
def cost_by_branch(d: Domain) -> DataFrame:
    calls = _calls(d)
    return aggregates.attributed(calls.union(calls), ["branch"])


@query(_CALLS + " select page, bool_and(tokens is not null) comparable from calls group by 1", domain=False)
def cost_comparable(d: Domain) -> DataFrame:
    return aggregates.comparable(_calls(d).withColumn("known", F.col("tokens").isNotNull()), "page")


@query(" select school_id, count(*) filter (state = 'view')::bigint as \"view\", count(*) filter (state = 'error')::bigint error from tasks group by 1")
def state_counts(d: Domain) -> DataFrame:
    return aggregates.state_counts(d.tasks, "school_id", "state", ["view", "error"])


@query("select l_suppkey from lineitem group by 1 having bool_and(l_quantity < 50 or l_discount < 0.1)", domain=False)
def article_only_targets(d: Domain) -> DataFrame:
    return aggregates.all_edges(d.table("lineitem"), "l_suppkey", (F.col("l_quantity") < 50) | (F.col("l_discount") < 0.1))


@query(" select school_id, max(queued_at) queued_at from tasks group by 1")
def last_checks(d: Domain) -> DataFrame:
    return aggregates.newest(d.tasks, "school_id", "queued_at")


@query("select p_brand, p_type, count(*)::bigint uses, count(distinct p_size)::bigint schools, floor(sum(p_size) * 1000 / count(*))::bigint confidence, count(distinct p_size) >= 2 promoted from part group by 1, 2", domain=False)
def selector_knowledge(d: Domain) -> DataFrame:
    return aggregates.selector_knowledge(d.table("part"), "p_brand", "p_type", "p_size", "p_size")


@query("select l_suppkey, l_returnflag, count(*)::bigint probes, count(distinct case when l_linestatus = 'F' then l_orderkey end)::bigint validated from lineitem group by 1, 2", domain=False)
def coverage_cells(d: Domain) -> DataFrame:
    return aggregates.coverage(d.table("lineitem"), "l_suppkey", "l_returnflag", "l_orderkey", F.col("l_linestatus") == "F")


@query(" select school_id, case max(case state when 'error' then 2 when 'purchase' then 1 else 0 end) when 2 then 'error' when 1 then 'purchase' else '' end state from tasks group by 1")
def failure_kind(d: Domain) -> DataFrame:
    return aggregates.precedence(d.tasks, "school_id", "state", ["error", "purchase"])


@query(
    """, c as (select *, sum(content_bytes) over (partition by author_id) - coalesce(sum(content_bytes) over (partition by author_id order by created_at, id rows between unbounded preceding and 1 preceding), 0) rest from notices)
  select id from c where created_at < timestamp '1995-06-01' or rest > 60000000"""
)
def cache_evictions(d: Domain) -> DataFrame:
    return windows.evictions(d.notices, ["author_id"], ["created_at", "id"], "content_bytes", 60_000_000, dt.datetime(1995, 6, 1), "created_at").select("id")


@query(" select id from (select *, row_number() over (partition by school_id order by id desc) p from tasks) where p > 5 or queued_at < timestamp '2024-01-05'")
def rotated_events(d: Domain) -> DataFrame:
    return windows.rotated(d.tasks, "school_id", "id", 5, "queued_at", dt.datetime(2024, 1, 5)).select("id")


@query(
    """, m as (select *, (state is distinct from lag(state) over w)::int nw from tasks window w as (partition by school_id order by id)), g as (select *, sum(nw) over (partition by school_id order by id) run from m)
  select school_id, state, min(id) as first, max(id) as last, count(*)::bigint length from g group by school_id, run, state"""
)
def state_runs(d: Domain) -> DataFrame:
    return windows.runs(d.tasks, "school_id", "id", "state")


@query(
    """, f as (select *, (state = 'view')::int fl from tasks), r as (select *, sum(1 - fl) over (partition by school_id order by id) rs from f),
  s as (select *, sum(fl) over (partition by school_id, rs order by id) st from r),
  t as (select *, coalesce(sum(case when st >= 2 then 1 end) over (partition by school_id order by id rows between unbounded preceding and 1 preceding), 0) dn from s) select id from t where dn = 0"""
)
def stop_after_streak(d: Domain) -> DataFrame:
    return windows.until_streak(d.tasks, "school_id", "id", F.col("state") == "view", 2).select("id")


@query(" select id, row_number() over (partition by school_id order by queued_at, id)::bigint revision from tasks")
def revision_numbers(d: Domain) -> DataFrame:
    return windows.revisions(d.tasks, "school_id", ["queued_at", "id"]).select("id", F.col("revision").cast("long").alias("revision"))


@query(" select id, case when published_at is null then 'unknown' when published_at::date = date '1998-08-02' then 'today' when published_at::date = date '1998-08-01' then 'yesterday' else strftime(published_at, '%Y-%m-%d') end as \"day\" from notices")
def day_labels(d: Domain) -> DataFrame:
    return d.notices.select("id", windows.day_label("published_at", dt.datetime(1998, 8, 2)).alias("day"))


@query(
    """, p as (select id, school_id, row_number() over (partition by school_id order by queued_at desc, id) - 1 place, count(*) over (partition by school_id) n from tasks)
  select id, place::bigint place from p where place in (0, 1, 2) or place = n // 2 or place = n - 2 or place = n - 1"""
)
def spread_sample(d: Domain) -> DataFrame:
    return windows.spread_sample(d.tasks, "school_id", [F.desc("queued_at"), F.col("id")]).select("id", F.col("place").cast("long").alias("place"))


@query(
    _MEMBERS + """ select notice_id, department_id from (select m.*, row_number() over (partition by m.notice_id order by d.group_name is null, not s.enabled, m.department_id) p
  from members m join departments d on d.id = m.department_id join schools s on s.id = d.school_id) where p = 1"""
)
def preferred_source(d: Domain) -> DataFrame:
    dep = d.departments.select(F.col("id").alias("department_id"), "school_id", "group_name")
    rows = _members(d).join(dep, "department_id").join(d.schools.select(F.col("id").alias("school_id"), "enabled"), "school_id")
    return ranking.preferred(rows, ["notice_id"], [F.col("group_name").isNotNull(), F.col("enabled")], "department_id").select("notice_id", "department_id")


@query(" select id, title, created_at from notices where created_at < timestamp '1997-01-01' union all select id, 'imported', created_at from notices where created_at >= timestamp '1997-01-01'")
def additive_import(d: Domain) -> DataFrame:
    rows = d.notices.select("id", "title", "created_at")
    return merge.insert_absent(rows.where("created_at < timestamp '1997-01-01'"), rows.withColumn("title", F.lit("imported")), ["id"])


@query(
    """ select author_id, title, max(id) id, min(created_at) created_at, bool_or(title like '1%') starred, count(*)::bigint copies from notices group by 1, 2"""
)
def merged_duplicates(d: Domain) -> DataFrame:
    rows = d.notices.select("author_id", F.col("title").alias("key"), "title", "id", "created_at", F.startswith("title", F.lit("1")).alias("starred"))
    return merge.merge_duplicates(rows, ["author_id", "key"], "id").drop("key")


@query(" select n.id, k.kept from notices n join (select author_id, title, max(id) kept from notices group by 1, 2) k using (author_id, title) where n.id <> k.kept")
def duplicate_aliases(d: Domain) -> DataFrame:
    return merge.alias_map(d.notices, ["author_id", "title"], "id")


@query("select l_orderkey notice_id, l_suppkey department_id, min(l_shipdate) first_seen, max(l_shipdate) last_seen from lineitem group by 1, 2", domain=False)
def merged_appearances(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_suppkey").alias("department_id"), F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_seen"), "l_linestatus")
    return merge.merge_appearances(rows.where("l_linestatus = 'F'").drop("l_linestatus"), rows.where("l_linestatus <> 'F'").drop("l_linestatus"))


@query("select p_partkey, case when p_size > 25 then md5(p_name) <> md5(p_brand) else false end changed from part", domain=False)
def updated_notices(d: Domain) -> DataFrame:
    now = d.table("part").select("p_partkey", F.md5("p_name").alias("digest"))
    new = d.table("part").select("p_partkey", F.when(F.col("p_size") > 25, F.md5("p_brand")).alias("digest"))
    return merge.changed(now, new, "p_partkey", "digest")


@query("select p_brand page, arg_min(p_type, (p_size, p_type)) kind, min(p_size) priority, min(p_partkey) depth from part group by 1", domain=False)
def enqueued_pages(d: Domain) -> DataFrame:
    rows = d.table("part").select(F.col("p_brand").alias("page"), F.col("p_type").alias("kind"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("depth"))
    return merge.enqueue(rows.where("priority < 20"), rows.where("priority >= 20"), "page")


@query(" select user_id, notice_id from (select * from states where starred) anti join reads using (user_id, notice_id)")
def bulk_read(d: Domain) -> DataFrame:
    return merge.mark_read(d.reads, d.states.where("starred").select("user_id", "notice_id"))


@query(" select t.user_id, t.notice_id, not t.starred starred, case when t.starred then r.o_orderdate end trashed_at from states t join orders r on r.o_orderkey = t.notice_id")
def toggled_stars(d: Domain) -> DataFrame:
    at = d.table("orders").select(F.col("o_orderkey").alias("notice_id"), F.col("o_orderdate").alias("at"))
    return merge.toggle_star(d.states.join(at, "notice_id"), "at").select("user_id", "notice_id", "starred", "trashed_at")


@query(" select school_id, max(x).id id from (select school_id, {'queued_at': queued_at, 'id': id, 'state': state} x from tasks) group by 1")
def newest_snapshot(d: Domain) -> DataFrame:
    return merge.newest_wins(d.tasks.select("school_id", "queued_at", "id", "state"), ["school_id"], "queued_at").select("school_id", "id")


@query(
    _MEMBERS + """ select g.notice_id, r.department_id from (select distinct notice_id from members where department_id <= 5) g
  left join (select notice_id, min(department_id) department_id from members where department_id > 5 group by 1) r using (notice_id)"""
)
def kept_when_deleted(d: Domain) -> DataFrame:
    return merge.new_owner(_members(d), d.departments.where("id <= 5").select(F.col("id").alias("department_id")))
