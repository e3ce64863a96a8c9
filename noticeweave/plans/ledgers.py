"""Queries of counts, usage, costs, queues and clocks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.operators import aggregates, merge, ranking, schedule, windows
from noticeweave.plans.domain import Domain
from noticeweave.plans.inbox import _MEMBERS, _members
from noticeweave.plans.registry import query

NOON = dt.datetime(2024, 1, 20, 12)
#: Model calls on events: status, what is known of usage, skill and purpose by the event's id and user.
_USAGE = """with raw as (select event_id, ts as_at, event_type model, user_id, value, event_id % 9 <> 0 sent, case event_id % 6 when 0 then 'sending' when 1 then 'failed' when 2 then 'partial' when 3 then 'lost' else 'succeeded' end status,
    event_id % 5 <> 0 known, floor(value)::bigint - 1 total, floor(value / 2)::bigint inp, case when event_id % 11 = 0 then floor(value)::bigint + 5 else floor(value / 4)::bigint end outp,
    floor(value / 3)::bigint hit, event_id % 13 = 0 invalid, case when event_id % 17 = 0 then 'connection-test' else 'x' end skill, case user_id % 4 when 0 then 'directory' when 1 then 'summary' when 2 then 'test' else 'chat' end purpose from events),
  u as (select *, known and total >= 0 k, known and total >= 0 and inp + outp <= total fits from raw where sent),
  v as (select event_id, as_at, model, user_id, case when k then total else 0 end tokens, case when fits then inp else 0 end rd, case when fits then outp else 0 end wr, not k and status <> 'sending' unknown,
    case when k and hit >= 0 and (case when user_id % 2 = 0 then inp - hit else 3 end) >= 0 and hit + (case when user_id % 2 = 0 then inp - hit else 3 end) = (case when fits then inp else 0 end) then hit end hits,
    case when user_id % 2 = 0 then inp - hit else 3 end miss, case status when 'sending' then 'pending' when 'lost' then 'uncertain' else status end bucket, status = 'failed' and invalid bad,
    case when skill = 'connection-test' then 'test' when purpose = 'chat' then 'other' else purpose end purpose from u)"""


def usage_calls(d: Domain) -> DataFrame:
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    whole = F.floor(v).cast("long")
    inp, hit = F.floor(v / 2).cast("long"), F.floor(v / 3).cast("long")
    status = F.when(e % 6 == 0, "sending").when(e % 6 == 1, "failed").when(e % 6 == 2, "partial").when(e % 6 == 3, "lost").otherwise("succeeded")
    purpose = F.when(u % 4 == 0, "directory").when(u % 4 == 1, "summary").when(u % 4 == 2, "test").otherwise("chat")
    return d.table("events").select(
        e.alias("execution_id"), F.col("ts").alias("at"), F.col("event_type").alias("model"), (e % 9 != 0).alias("request_sent"), status.alias("status"), (e % 5 != 0).alias("known"),
        (whole - 1).alias("total_tokens"), inp.alias("input_tokens"), F.when(e % 11 == 0, whole + 5).otherwise(F.floor(v / 4).cast("long")).alias("output_tokens"), hit.alias("cache_hit_tokens"),
        F.when(u % 2 == 0, inp - hit).otherwise(3).alias("cache_miss_tokens"), (e % 13 == 0).alias("invalid"), F.when(e % 17 == 0, "connection-test").otherwise("x").alias("skill"), purpose.alias("purpose"),
    )


@query(
    _USAGE + """ select model, purpose, (grouping(model) * 2 + grouping(purpose))::bigint level, count(*)::bigint calls, count(*) filter (unknown)::bigint unknown, sum(tokens)::bigint tokens, sum(tokens - rd - wr)::bigint unclassified,
  count(*) filter (bucket = 'succeeded')::bigint succeeded, count(*) filter (bucket = 'partial')::bigint partial, count(*) filter (bucket = 'failed')::bigint failed, count(*) filter (bucket = 'pending')::bigint pending,
  count(*) filter (bucket = 'uncertain')::bigint uncertain, count(*) filter (bad)::bigint invalid,
  case when count(*) filter (bucket in ('succeeded', 'failed', 'partial')) > 0 then (count(*) filter (bucket = 'succeeded') * 1000 // count(*) filter (bucket in ('succeeded', 'failed', 'partial')))::bigint end success,
  case when sum(hits) + sum(miss) filter (hits is not null) > 0 then (sum(hits) * 1000 // (sum(hits) + sum(miss) filter (hits is not null)))::bigint end cache_hits
  from v group by cube (model, purpose)""",
    domain=False,
)
def usage_dashboard(d: Domain) -> DataFrame:
    return aggregates.usage_rollup(aggregates.usage_row(usage_calls(d))).withColumn("level", F.col("level").cast("long"))


@query(
    _USAGE + """, w as (select *, (as_at + interval 330 minute)::date as "day" from v) select count(*) filter ("day" > date '2024-01-20' - 7)::bigint calls, coalesce(sum(tokens) filter ("day" > date '2024-01-20' - 7), 0)::bigint tokens,
  count(*)::bigint all_calls, sum(tokens)::bigint all_tokens, min("day") since from w""",
    domain=False,
)
def usage_ranges(d: Domain) -> DataFrame:
    return aggregates.usage_ranges(aggregates.usage_row(usage_calls(d)), NOON.date(), 7, 330)


@query(
    _USAGE + """, c as (select "day"::date as "day", coalesce(t, 0)::bigint tokens from (select unnest(generate_series(date '2024-01-20' - 6, date '2024-01-20', interval 1 day))::date as "day")
  left join (select as_at::date as "day", sum(tokens) t from v group by 1) using ("day")) select "day", tokens, case when max(tokens) over () > 0 then ceil(tokens * 4 / max(tokens) over ()) else 0 end::bigint as level from c""",
    domain=False,
)
def usage_trend(d: Domain) -> DataFrame:
    days = aggregates.calendar(aggregates.usage_row(usage_calls(d)), NOON.date(), 365).withColumn("tokens", F.col("tokens").cast("long"))
    return windows.trend(days, NOON.date(), 7)


@query(
    _USAGE + """, c as (select as_at::date as "day", sum(tokens)::bigint tokens from v where as_at::date between date '2024-01-20' - 29 and date '2024-01-20' group by 1) select "day", tokens from c order by tokens desc, "day" limit 1""",
    domain=False,
)
def usage_peak(d: Domain) -> DataFrame:
    return aggregates.peak(aggregates.calendar(aggregates.usage_row(usage_calls(d)), NOON.date(), 30).withColumn("tokens", F.col("tokens").cast("long")))


@query(
    """with r as (select event_id, case when user_id % 6 > 0 then user_id % 6 end branch, event_id % 9 <> 0 sent, case event_id % 6 when 0 then 'sending' when 1 then 'failed' when 2 then 'partial' when 3 then 'lost' else 'succeeded' end status,
    event_id % 5 <> 0 and floor(value) - 1 >= 0 k, floor(value)::bigint - 1 t, event_id % 7 = 0 hand, case when event_id % 9 = 0 then event_id % 100 else -3 end res from events)
  select branch, count(*)::bigint executions, count(*) filter (sent)::bigint sent, count(*) filter (sent and k and not hand)::bigint confirmed, count(*) filter (sent and k and hand)::bigint reconciled, count(*) filter (sent and not k)::bigint "unknown",
    count(*) filter (not sent and status in ('reserved', 'sending'))::bigint reserved, coalesce(sum(t) filter (sent and k), 0)::bigint tokens, sum(greatest(res, 0))::bigint reserved_tokens from r group by 1""",
    domain=False,
)
def cost_buckets(d: Domain) -> DataFrame:
    e = F.col("execution_id")
    users = d.table("events").select(F.col("event_id").alias("execution_id"), (F.col("user_id") % 6).alias("b"))
    rows = usage_calls(d).select("execution_id", "request_sent", "status", "known", "total_tokens").join(users, "execution_id")
    rows = rows.withColumns({"branch": F.when(F.col("b") > 0, F.col("b")), "source": F.when(e % 7 == 0, "administrator_reconciliation"), "reserved_tokens": F.when(e % 9 == 0, e % 100).otherwise(-3)}).drop("b")
    return aggregates.cost_buckets(rows.unionByName(rows), "branch")


@query(_MEMBERS + " select school_id, count(*)::bigint n_read from (select distinct r.user_id, m.notice_id, d.school_id from reads r join members m on m.notice_id = r.notice_id join departments d on d.id = m.department_id) group by 1")
def school_reads(d: Domain) -> DataFrame:
    return aggregates.per_school_read(_members(d), d.departments, d.reads)


@query(" select school_id, count(*)::bigint n from departments group by 1")
def school_departments(d: Domain) -> DataFrame:
    return aggregates.count_by(d.departments, "school_id")


@query(" select school_id, state, count(*)::bigint n from tasks group by 1, 2")
def proposal_states(d: Domain) -> DataFrame:
    return aggregates.count_by(d.tasks, "school_id", "state")


@query("select p_brand category, count(*)::bigint total, count(*) filter (p_size > 20)::bigint matched, (count(*) filter (p_size > 20) * 1000 // count(*))::bigint share from part group by 1", domain=False)
def baseline_metrics(d: Domain) -> DataFrame:
    return aggregates.baseline_metrics(d.table("part").withColumnRenamed("p_brand", "category"), "category", F.col("p_size") > 20)


_STATES = "(case event_type when 'view' then 'pending' when 'click' then 'running' when 'error' then 'failed' when 'signup' then 'partial' else 'done' end)"


def _sources(d: Domain) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "view", "pending").when(kind == "click", "running").when(kind == "error", "failed").when(kind == "signup", "partial").otherwise("done")
    return d.table("events").select("user_id", state.alias("state"), F.get_json_object("props", "$.k").cast("long").alias("new_count"))


_TOTALS = f"""count(*)::bigint total, count(*) filter (s in ('pending', 'running'))::bigint active, count(*) filter (s = 'failed')::bigint failed, count(*) filter (s = 'done')::bigint done,
  count(*) filter (s = 'partial')::bigint incomplete, count(*) filter (s in ('done', 'failed', 'partial'))::bigint processed, sum(k)::bigint "new" from (select user_id, {_STATES} s, json_extract_string(props, '$.k')::bigint k from events)"""


@query(f"select {_TOTALS}", domain=False)
def refresh_totals(d: Domain) -> DataFrame:
    return aggregates.refresh_totals(_sources(d))


@query(f"select user_id, {_TOTALS} group by 1", domain=False)
def refresh_by_user(d: Domain) -> DataFrame:
    return aggregates.refresh_totals(_sources(d), "user_id")


@query(" select school_id, count(*)::bigint total, count(*) filter (id % 3 > 0)::bigint configured, count(*) filter (id % 3 > 0 and id % 2 = 0)::bigint batch from departments group by 1")
def scope_summary(d: Domain) -> DataFrame:
    return aggregates.scope_summary(d.departments, F.col("id") % 3 > 0, F.col("id") % 2 == 0)


@query(
    """select l_suppkey scope, count(distinct l_orderkey)::bigint materials, count(distinct case when l_returnflag = 'A' then l_partkey end)::bigint sources, count(distinct case when l_linestatus = 'O' then l_linenumber end)::bigint entries
  from lineitem group by 1""",
    domain=False,
)
def foraging_counts(d: Domain) -> DataFrame:
    rows = d.table("lineitem").withColumnRenamed("l_suppkey", "scope")
    material, receipts, entries = rows.select("scope", F.col("l_orderkey").alias("url")), rows.where("l_returnflag = 'A'").select("scope", F.col("l_partkey").alias("source")), rows.where("l_linestatus = 'O'").select("scope", F.col("l_linenumber").alias("target"))
    return aggregates.foraging_counts(material, receipts, entries, "scope")


@query(" select school_id, count(*)::bigint n from departments where id in (select l_suppkey from lineitem where l_quantity > 49) group by 1")
def verified_columns(d: Domain) -> DataFrame:
    return aggregates.verified_columns(d.departments, d.table("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("department_id")))


@query(
    """, n as (select user_id, segment category, 1000 + floor(250 * greatest(0, user_id % 4 - 1) / greatest(1, user_id % 3 - 1))::bigint weight from subscriptions where segment <> 'MACHINERY')
  select c category, coalesce(count(distinct user_id), 0)::bigint contributors, coalesce(sum(weight) // count(*), 1000)::bigint weight from (select unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'OTHER']) c) left join n on category = c group by 1"""
)
def interest_weights(d: Domain) -> DataFrame:
    u = F.col("user_id")
    needs = d.subscriptions.where("segment <> 'MACHINERY'").select("user_id", F.col("segment").alias("category"), schedule.overlap_weight(u % 4, u % 3).alias("weight"))
    return aggregates.interest_weights(needs, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER"])


@query(
    """with s as (select l_orderkey source, l_linenumber <> 2 and l_quantity > 12 matched, case when l_quantity > 12 then 'access_restricted' when l_quantity > 8 then 'title_abbreviated' when l_quantity > 4 then 'access_restricted' when l_quantity > 2 then 'material_incomplete' else 'rule_error' end kind,
    l_discount >= 0.095 conflict, max(l_linenumber) over (partition by l_orderkey) available from lineitem),
  a as (select source, count(*) n, max(available) av, count(*) filter (matched) m, count(*) filter (not matched) f, count(*) filter (not matched and kind not in ('access_restricted', 'title_abbreviated')) b, count(*) filter (not matched and kind = 'access_restricted') g,
    count(*) filter (conflict) c, max(case when matched then 0 when kind = 'rule_error' then 3 when kind = 'access_restricted' then 1 else 2 end) w from s group by 1),
  r as (select *, case when av = 1 then 1 else 2 end need from a), p as (select *, b = 0 and c = 0 and (m >= need or m > 0 and f > 0 and g = f and n >= least(av, 5)) ok from r)
  select source, m::bigint matched, need::bigint required, ok passed, m > 0 and (av = 1 or f > 0) limited, case when ok then '' else ['', 'access_restricted', 'material_incomplete', 'rule_error'][w + 1] end failure from p""",
    domain=False,
)
def sample_summaries(d: Domain) -> DataFrame:
    rows, q = d.table("lineitem"), F.col("l_quantity")
    most = rows.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("available"))
    kind = F.when(q > 12, "access_restricted").when(q > 8, "title_abbreviated").when(q > 4, "access_restricted").when(q > 2, "material_incomplete").otherwise("rule_error")
    samples = rows.join(most, "l_orderkey").select(F.col("l_orderkey").alias("source"), ((F.col("l_linenumber") != 2) & (q > 12)).alias("matched"), kind.alias("kind"), (F.col("l_discount") >= 0.095).alias("conflict"), "available")
    return aggregates.sample_summary(samples, "source")


@query(
    """, w as (select school_id, count(*) t, count(*) filter (state <> 'view') dn, count(*) filter (state = 'error') f from tasks where school_id % 3 > 0 and (school_id % 2 = 0 or state = 'click') group by 1),
  g as (select school_id, count(*) n, string_agg(distinct k, ',' order by k) ks from (select school_id, case when id % 2 = 0 then 'no list' else 'no heading' end k from departments where id % 4 = 1) group by 1)
  select coalesce(w.school_id, g.school_id) school_id, coalesce(t, 0)::bigint total, coalesce(dn - f, 0)::bigint done, coalesce(f, 0)::bigint failed, coalesce(n, 0)::bigint gaps, coalesce(ks, '') kinds, coalesce(t, 0) > 0 and t = dn - f and n is null complete
  from w full join g on w.school_id = g.school_id"""
)
def work_coverage(d: Domain) -> DataFrame:
    state = F.when(F.col("state") == "error", "failed").when(F.col("state") == "view", "open").otherwise("done")
    work = d.tasks.where("school_id % 3 > 0 and (school_id % 2 = 0 or state = 'click')").select("school_id", state.alias("state"))
    gaps = d.departments.where("id % 4 = 1").select("school_id", F.when(F.col("id") % 2 == 0, "no list").otherwise("no heading").alias("gap"))
    return aggregates.work_coverage(work, "school_id", gaps)


@query("select count(*) filter (l_returnflag = 'A')::bigint \"new\", count(*) filter (l_returnflag = 'R')::bigint changed, count(*) filter (l_returnflag = 'N')::bigint unchanged from lineitem where l_linenumber <= 2 and l_linestatus = 'F'", domain=False)
def change_counts(d: Domain) -> DataFrame:
    change = F.when(F.col("l_returnflag") == "A", "new").when(F.col("l_returnflag") == "R", "changed").otherwise("unchanged")
    pages = d.table("lineitem").select(F.when(F.col("l_linenumber") <= 2, "fetched").otherwise("pending").alias("state"), change.alias("change"), "l_linestatus")
    return aggregates.change_counts(pages, F.col("l_linestatus") == "F")


@query(
    """with s as (select l_orderkey doc, case when l_quantity > 47 then 'mixed' when l_quantity > 40 then 'relevant' when l_quantity > 33 then 'potential' when l_quantity > 8 then 'low' else 'unknown' end v,
    case when l_tax > 0.07 then 'high' when l_tax > 0.06 then 'possible' when l_tax > 0.01 then 'low' else 'unknown' end h, l_returnflag || l_partkey % 3 f from lineitem)
  select doc, case when bool_or(v = 'mixed') or bool_or(v = 'low') and bool_or(v in ('relevant', 'potential')) then 'mixed' when bool_or(v = 'relevant') then 'relevant' when bool_or(v = 'potential') then 'potential' when bool_and(v = 'low') then 'low' else 'unknown' end "value",
    case when bool_or(h = 'high') then 'high' when bool_or(h = 'possible') then 'possible' when bool_and(h = 'low') then 'low' else 'unknown' end historical, count(distinct f)::int facts from s group by 1""",
    domain=False,
)
def assessments(d: Domain) -> DataFrame:
    q, t = F.col("l_quantity"), F.col("l_tax")
    value = F.when(q > 47, "mixed").when(q > 40, "relevant").when(q > 33, "potential").when(q > 8, "low").otherwise("unknown")
    past = F.when(t > 0.07, "high").when(t > 0.06, "possible").when(t > 0.01, "low").otherwise("unknown")
    facts = F.array(F.struct(F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 3).alias("quote")))
    return aggregates.combined(d.table("lineitem").select(F.col("l_orderkey").alias("doc"), value.alias("value"), past.alias("historical"), facts.alias("facts")), "doc")


@query(
    """with v as (select l_orderkey list, l_shipmode_ selector, count(distinct l_linenumber) votes from (select *, ['span.date', 'time', 'em.day'][l_suppkey % 3 + 1] l_shipmode_ from lineitem) where l_linenumber <= 5 and l_partkey % 4 > 0 group by 1, 2)
  select list, selector, votes::bigint votes, place::int place from (select *, row_number() over (partition by list order by votes desc, selector) place from v) where place <= 2""",
    domain=False,
)
def date_selectors(d: Domain) -> DataFrame:
    selector = F.element_at(F.array(F.lit("span.date"), F.lit("time"), F.lit("em.day")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    items = d.table("lineitem").select(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("nth"), selector.alias("selector"), "l_partkey")
    return aggregates.date_selectors(items, "list", "selector", F.col("l_partkey") % 4 > 0)


@query(" select school_id key, max({'a': queued_at, 'b': id, 's': state}).s state, count(*)::bigint generation from tasks group by 1")
def task_states(d: Domain) -> DataFrame:
    rows = d.tasks.select(F.col("school_id").alias("key"), "queued_at", "id", "state")
    return schedule.latest_state(rows, "key", "queued_at", "id").select("key", "state", "generation")


_QUEUE = """with q as (select event_id id, case event_type when 'view' then 'content' when 'click' then 'collect' when 'error' then 'onboard' when 'signup' then 'inbox' else 'other' end kind,
   case when event_id % 4 = 0 then 'onboarding_collection' else '' end phase, event_id % 3 claim_count, ts queued_at, ts + to_minutes((event_id % 5)::int) available_at, case when event_id % 2 = 0 then 'pending' else 'running' end state,
   ts + interval 1 day lease_until from events),
 r as (select *, case when kind = 'content' then -3 when kind = 'collect' and phase = 'onboarding_collection' or kind = 'onboard' and claim_count = 0 then -2 when queued_at <= timestamp '2024-01-20 11:55:00' then -1 when kind in ('collect', 'inbox') then 1 else 2 end rk from q)"""


def _queue(d: Domain) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    named = F.when(kind == "view", "content").when(kind == "click", "collect").when(kind == "error", "onboard").when(kind == "signup", "inbox").otherwise("other")
    return d.table("events").select(
        e.alias("id"), named.alias("kind"), F.when(e % 4 == 0, "onboarding_collection").otherwise("").alias("phase"), (e % 3).alias("claim_count"), F.col("ts").alias("queued_at"),
        (F.col("ts") + F.make_dt_interval(mins=(e % 5).cast("int"))).alias("available_at"), F.when(e % 2 == 0, "pending").otherwise("running").alias("state"), (F.col("ts") + F.expr("interval 1 day")).alias("lease_until"),
    )


@query(_QUEUE + " select id, rk as rank from r where state = 'pending' and available_at <= timestamp '2024-01-20 12:00:00' or state = 'running' and lease_until <= timestamp '2024-01-20 12:00:00' order by rk, claim_count, queued_at, available_at, id limit 16", domain=False)
def claim_window(d: Domain) -> DataFrame:
    return schedule.claim_window(_queue(d), NOON, ("collect", "inbox")).select("id", "rank")


@query(_QUEUE + " select id, (row_number() over (order by rk, claim_count, queued_at, available_at, id) - 1)::bigint ahead from r", domain=False)
def queue_positions(d: Domain) -> DataFrame:
    order = [schedule.claim_rank(NOON, ("collect", "inbox")), *map(F.col, ("claim_count", "queued_at", "available_at", "id"))]
    return schedule.positions(_queue(d), order, "id").withColumn("ahead", F.col("ahead").cast("long"))


@query(
    _QUEUE + """ select l.event_id id, case when l.user_id % 2 = 0 and not coalesce(q.state = 'running' and q.lease_until > timestamp '2024-01-20 12:00:00' and q.claim_count = l.user_id % 3, false) then 'interrupted' when l.user_id % 2 = 0 then 'running' else 'done' end state
  from events l left join q on q.id = l.event_id // 2""",
    domain=False,
)
def interrupted_logs(d: Domain) -> DataFrame:
    u = F.col("user_id")
    logs = d.table("events").select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 2).alias("task_id"), (u % 3).alias("task_generation"), F.when(u % 2 == 0, "running").otherwise("done").alias("state"), F.lit(None).cast("timestamp").alias("finished_at"))
    return schedule.interrupted(logs, _queue(d).withColumn("generation", F.col("claim_count")), NOON).select("id", "state")


@query(
    """, t as (select school_id key, arg_max(state, (queued_at, id)) s, max(queued_at) f from tasks where school_id % 4 > 0 group by 1)
  select w.key, case when t.key is null then 'missing' else 'elapsed' end reason from (select distinct school_id key from tasks) w left join t using (key) where t.key is null or s in ('error', 'purchase') and f <= timestamp '2024-01-20 12:00:00' - interval 3600 second"""
)
def due_tasks(d: Domain) -> DataFrame:
    rows = d.tasks.withColumnRenamed("school_id", "key")
    state = F.when(F.col("state") == "error", "failed").when(F.col("state") == "purchase", "done").otherwise("running")
    done = rows.where("key % 4 > 0").groupBy("key").agg(F.max(F.struct("queued_at", "id", "state")).alias("m")).select("key", F.col("m.state").alias("state"), F.col("m.queued_at").alias("finished_at")).withColumn("state", state)
    return schedule.due(rows.select("key").distinct(), done, "key", NOON, 3600)


@query(
    """select user_id budget, coalesce(sum(floor(value)::bigint) filter (event_type = 'click'), 0)::bigint used, (100 * count(*) filter (event_type = 'view') - 100 * count(*) filter (event_type in ('click', 'signup')))::bigint reserved,
  count(*) filter (event_type = 'view')::bigint requests from events where event_type <> 'purchase' group by 1""",
    domain=False,
)
def budget_balances(d: Domain) -> DataFrame:
    kind = F.col("event_type")
    entries = d.table("events").where(kind != "purchase").select(
        F.col("user_id").alias("budget"), F.when(kind == "view", "reserve").when(kind == "signup", "release").otherwise("settle").alias("kind"), F.lit(100).cast("long").alias("reserved"),
        F.when(kind == "click", F.floor("value").cast("long")).alias("tokens"),
    )
    return schedule.balances(entries, "budget")


@query(
    """select event_id id, case when s in ('reserved', 'sending') and h < timestamp '2024-01-20 11:57:00' then case when sent then 'uncertain' else 'failed' end else s end status, case when s in ('reserved', 'sending') and h < timestamp '2024-01-20 11:57:00' and not sent then 0 else 50 end::int reserved_tokens
  from (select event_id, case event_id % 4 when 0 then 'reserved' when 1 then 'sending' else 'succeeded' end s, coalesce(case when event_id % 3 = 0 then ts + interval 2 day end, ts) h, event_id % 5 > 1 sent from events)""",
    domain=False,
)
def recovered_executions(d: Domain) -> DataFrame:
    e = F.col("event_id")
    rows = d.table("events").select(e.alias("id"), F.when(e % 4 == 0, "reserved").when(e % 4 == 1, "sending").otherwise("succeeded").alias("status"), F.when(e % 3 == 0, F.col("ts") + F.expr("interval 2 days")).alias("heartbeat_at"), F.col("ts").alias("created_at"), (e % 5 > 1).alias("request_sent"), F.lit(50).alias("reserved_tokens"))
    return schedule.recovered(rows, NOON).select("id", "status", "reserved_tokens")


@query(
    """select event_id id, case when event_type <> 'purchase' then event_type when event_id % 7 = 0 then 'skipped' when event_id % 5 = 0 then 'retry_wait' when event_id % 5 = 1 then 'needs_check' when event_id % 3 = 0 then 'partial' else 'done' end shown from events""",
    domain=False,
)
def collection_states(d: Domain) -> DataFrame:
    e = F.col("event_id")
    state = F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type"))
    outcome = F.when(e % 5 == 0, "waiting").when(e % 5 == 1, "needs_check").when(e % 5 == 2, "done")
    return d.table("events").select(e.alias("id"), schedule.display_state(state, e % 7 == 0, outcome, F.when(e % 3 == 0, F.lit(True))).alias("shown"))


@query(
    """with recursive d0 as (select user_id branch, event_id // 3 dec, min(event_id) o from events group by 1, 2), d1 as (select *, row_number() over (partition by branch order by o, dec) n from d0),
  res as (select e.user_id branch, min(d1.n) n from events e join d1 on d1.branch = e.user_id and d1.dec = e.event_id // 3 where event_type = 'click' group by e.user_id, floor(value)::bigint % 6),
  c as (select d1.branch, d1.n, (select count(*) from res where res.branch = d1.branch and res.n <= d1.n) seen from d1),
  w(branch, n, last, idle, seen) as (select branch, 0::bigint, 0::bigint, 0, 0::bigint from (select distinct branch from d1)
    union all select c.branch, c.n, case when c.n % 2 = 0 then c.seen else w.last end, case when c.n % 2 > 0 then w.idle when c.seen > w.last then 0 else w.idle + 1 end, c.seen from w join c on c.branch = w.branch and c.n = w.n + 1 where w.idle < 3)
  select branch, max(n)::int decisions, max(seen)::bigint seen, max(idle) >= 3 stopped from w group by 1""",
    domain=False,
)
def progress_clocks(d: Domain) -> DataFrame:
    rows = d.table("events").select(F.col("user_id").alias("branch"), F.col("event_id").alias("o"), F.floor(F.col("event_id") / 3).alias("decision"), F.when(F.col("event_type") == "click", F.floor("value").cast("long") % 6).alias("result"))
    return schedule.progress_clock(rows, "branch", "o", "decision", "result", 2, 3).select("branch", F.col("decisions").cast("int").alias("decisions"), "seen", "stopped")


_ROUTES = """with p as (select event_id, 'u' || lpad(event_id::varchar, 9, '0') url, user_id branch, case when event_type = 'error' then 'unit' else 'menu' end kind, event_id % 4 lane, event_id % 7 priority, event_id % 5 depth, floor(value)::bigint attempts, ts queued_at from events)"""


def _routes(d: Domain) -> DataFrame:
    e = F.col("event_id")
    return d.table("events").select(F.concat(F.lit("u"), F.lpad(e.cast("string"), 9, "0")).alias("url"), F.col("user_id").alias("branch"), F.when(F.col("event_type") == "error", "unit").otherwise("menu").alias("kind"), (e % 4).alias("lane"), (e % 7).alias("priority"), (e % 5).alias("depth"), F.floor("value").cast("long").alias("attempts"), F.col("ts").alias("queued_at"))


@query(
    _ROUTES + """ (select 4 turn, url from p order by queued_at, url limit 1) union all (select 3, url from p join (select branch, sum(attempts) t from p group by 1) using (branch) order by t, branch, lane, priority, depth, url limit 1)
  union all (select 1, url from p order by lane, priority, depth, url limit 1)""",
    domain=False,
)
def route_choices(d: Domain) -> DataFrame:
    pages = _routes(d)
    some = [schedule.choose_route(pages, turn).select(F.lit(turn).alias("turn"), "url") for turn in (4, 3, 1)]
    return some[0].unionByName(some[1]).unionByName(some[2])


@query(
    """select event_id id, least(case user_id % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 4 else 5 end, case when user_id % 5 > 2 and event_id % 6 in (2, 3, 4) then 3 when user_id % 5 = 4 and event_type = 'view' then 3 else 5 end,
    case when event_id % 11 = 0 then 1 else 5 end, case when event_id % 4 = 0 and user_id % 5 in (2, 4) then 2 else 5 end) as lane from events""",
    domain=False,
)
def route_lanes(d: Domain) -> DataFrame:
    u, e = F.col("user_id") % 5, F.col("event_id")
    kind = F.when(u == 0, "root").when(u == 1, "channel").when(u == 2, "gateway").when(u == 3, "directory").otherwise("navigation")
    label = F.when(F.col("event_type") == "view", "All News").otherwise("other")
    return d.table("events").select(e.alias("id"), schedule.lane(kind, label, e % 6, e % 11 == 0, e % 4 == 0).alias("lane"))


@query("select event_id id, (dense_rank() over (order by -((2 + case when user_id % 3 = 0 then 1 else 0 end) * 1000000 // (2 + event_id % 50))))::bigint place from events", domain=False)
def foraging_places(d: Domain) -> DataFrame:
    from pyspark.sql.window import Window as W

    score = schedule.foraging_order(F.col("user_id") % 3 == 0, F.col("event_id") % 50)
    # places over distinct scores only: there are few of them
    rows = d.table("events").select(F.col("event_id").alias("id"), score.alias("score"))
    places = rows.select("score").distinct().withColumn("place", F.row_number().over(W.orderBy(F.desc("score"))).cast("long"))
    return rows.join(places, "score").select("id", "place")


@query(
    """, c as (select *, sum(content_bytes) over () - coalesce(sum(content_bytes) over (order by created_at, id rows between unbounded preceding and 1 preceding), 0) rest from notices)
  select id from c where created_at < timestamp '1995-03-01' or rest > (select sum(content_bytes) // 3 from notices)"""
)
def whole_cache_evictions(d: Domain) -> DataFrame:
    rows = d.notices
    limit = rows.agg(F.floor(F.sum("content_bytes") / 3)).first()[0]
    return windows.evictions_of_all(rows, [F.col("created_at"), F.col("id")], "content_bytes", limit, F.col("created_at") < F.lit(dt.datetime(1995, 3, 1))).select("id")


@query(
    """, c as (select *, sum(content_bytes) over () t, coalesce(sum(content_bytes) over (order by created_at, id rows between unbounded preceding and 1 preceding), 0) b from notices)
  select id from c where t > 1000000000 and 4 * (t - b) > 3000000000"""
)
def trimmed_snapshots(d: Domain) -> DataFrame:
    return windows.trimmed(d.notices, [F.col("created_at"), F.col("id")], "content_bytes", 1_000_000_000, F.lit(False)).select("id")


@query(" select id from (select *, row_number() over (partition by school_id order by queued_at desc, id desc) p from tasks) where p > 2 and queued_at < timestamp '2024-01-19'")
def old_generations(d: Domain) -> DataFrame:
    return windows.newest_versions(d.tasks, "school_id", [F.desc("queued_at"), F.desc("id")], 2, F.col("queued_at") >= F.lit(dt.datetime(2024, 1, 19))).select("id")


@query(" select id from (select *, coalesce(sum((a and b)::int) over (partition by school_id order by id rows between unbounded preceding and 1 preceding), 0) dn from (select *, state = 'view' a, coalesce(lag(state) over (partition by school_id order by id) = 'view', false) b from tasks)) where dn = 0")
def two_old_pages(d: Domain) -> DataFrame:
    return windows.two_old_pages(d.tasks, "school_id", "id", F.col("state") == "view").select("id")


@query(" select id, place from (select id, row_number() over (partition by state order by queued_at, id)::int place from tasks) where place = 1")
def first_tasks(d: Domain) -> DataFrame:
    return ranking.first_of(d.tasks, ["state"], [F.col("queued_at"), F.col("id")]).select("id", F.lit(1).alias("place"))


@query("select l_orderkey page, max((l_partkey % 4, l_suppkey % 3, -l_linenumber))[1]::bigint valid, max((l_partkey % 4, l_suppkey % 3, -l_linenumber))[2]::bigint specificity, -max((l_partkey % 4, l_suppkey % 3, -l_linenumber))[3] nth from lineitem group by 1", domain=False)
def best_profiles(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("nth"), (F.col("l_partkey") % 4).alias("valid"), (F.col("l_suppkey") % 3).alias("specificity"))
    return ranking.best_profile(rows, "page").select("page", "valid", "specificity", "nth")


@query("select l_orderkey page, l_linenumber nth, row_number() over (partition by l_orderkey order by l_suppkey % 3, l_partkey % 5 desc, l_linenumber)::int place from lineitem", domain=False)
def candidate_places(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("nth"), (F.col("l_suppkey") % 3).alias("prior"), (F.col("l_partkey") % 5).alias("score"))
    return ranking.candidate_order(rows, "page").select("page", "nth", "place")


@query("select event_id id, case event_type when 'view' then 3 when 'click' then 2 when 'error' then 1 when 'signup' then 0 else 4 end + case event_id % 6 when 0 then -2 when 1 then 2 when 2 then -1 else 0 end priority from events", domain=False)
def link_priorities(d: Domain) -> DataFrame:
    t, e = F.col("event_type"), F.col("event_id") % 6
    kind = F.when(t == "view", "channel").when(t == "click", F.when(e < 3, "unit").otherwise("major")).when(t == "error", "directory").when(t == "signup", "root").otherwise(t)
    value = F.when(e == 0, "relevant").when(e == 1, "low").when(e == 2, "potential").when(e == 3, "mixed").when(e == 4, "unknown")
    return d.table("events").select(F.col("event_id").alias("id"), ranking.route_priority(kind, value).alias("priority"))


@query(
    """with x as (select l_orderkey list, l_linenumber nth, min(l_partkey) % 5 address, min(l_quantity) > 25 good from lineitem group by 1, 2), f as (select list, address, min(nth) nth from x group by 1, 2), t as (select f.*, row_number() over (partition by list order by nth) tr, good from f join x using (list, nth)),
  b as (select *, coalesce(sum(good::int) over (partition by list order by tr rows between unbounded preceding and 1 preceding), 0) bf from t where tr <= 4) select list, nth from b where bf < 2""",
    domain=False,
)
def sampled_articles(d: Domain) -> DataFrame:
    lines = d.table("lineitem").groupBy(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("nth")).agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    rows = lines.select("list", "nth", (F.col("p") % 5).alias("address"), (F.col("q") > 25).alias("good"))
    return ranking.sampled_articles(rows, "list", "address", 4, 2).select("list", "nth")


@query(" select school_id, (sum(case when id % 3 = 0 then 6 when id % 3 = 1 then 3 else 2 end))::decimal(34,6) demand from tasks group by 1")
def demand_scores(d: Domain) -> DataFrame:
    rows = d.tasks.select("school_id", F.lit(6).alias("weight"), (F.col("id") % 3).alias("done"))
    return ranking.demand(rows, "school_id", "weight", "done").withColumn("demand", F.col("demand").cast("decimal(34,6)"))


@query(
    """, b as (select id, title from notices where created_at < timestamp '1997-01-01'), a as (select id, case when id % 5 = 0 then 'x' else title end title from notices where created_at >= timestamp '1996-01-01' and created_at < timestamp '1997-06-01'),
  ch as (select coalesce(a.id, b.id) id, case when a.id is null then 'removed' when b.id is null then 'added' else 'changed' end change from a full join b on a.id = b.id where a.id is null or b.id is null or a.title <> b.title)
  select id % 7 k, id, change, row_number() over (partition by id % 7 order by id, change)::int + 100 revision from ch"""
)
def change_journal(d: Domain) -> DataFrame:
    from noticeweave.operators.joins import delta

    rows = d.notices.select("id", "title", "created_at")
    before = rows.where("created_at < timestamp '1997-01-01'").drop("created_at")
    after = rows.where("created_at >= timestamp '1996-01-01' and created_at < timestamp '1997-06-01'").select("id", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("title")).alias("title"))
    return merge.journal(delta(before, after, "id").withColumn("k", F.col("id") % 7), "k", 100).select("k", "id", "change", "revision")


@query("select user_id k, count(*)::bigint n, max(event_id // 7) - 20 = count(*) complete from events where event_id // 7 > 20 and event_id % 7 = 0 group by 1", domain=False)
def changes_since(d: Domain) -> DataFrame:
    log = d.table("events").where("event_id % 7 = 0").select(F.col("user_id").alias("k"), F.floor(F.col("event_id") / 7).alias("revision"))
    return merge.since(log, "k", 20)


@query("select l_orderkey parent, l_partkey child from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_linenumber = 5) union all select l_orderkey, l_suppkey from lineitem where l_linenumber = 5", domain=False)
def replaced_edges(d: Domain) -> DataFrame:
    rows = d.table("lineitem")
    fresh = rows.where("l_linenumber = 5").select(F.col("l_orderkey").alias("parent"), F.col("l_suppkey").alias("child"))
    return merge.replace_parents(rows.select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child")), fresh, "parent")


@query("select l_orderkey parent, l_partkey child from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O')", domain=False)
def kept_edges(d: Domain) -> DataFrame:
    return merge.without_dangling(d.table("lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child")), d.table("orders").where("o_orderstatus = 'O'"), "parent", "o_orderkey")


@query(
    """with o as (select distinct l_orderkey parent, l_partkey child from lineitem), f as (select distinct l_orderkey parent, case when l_orderkey % 4 = 0 then l_partkey else l_suppkey end child from lineitem where l_orderkey % 3 > 0),
  so as (select parent, list(child order by child) x from o group by 1), sf as (select parent, list(child order by child) y from f group by 1) select o.parent, o.child from o join so using (parent) join sf using (parent) where x <> y""",
    domain=False,
)
def archived_edges(d: Domain) -> DataFrame:
    rows = d.table("lineitem")
    edges = rows.select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child")).distinct()
    fresh = rows.where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("parent"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("child"))
    return merge.archived(edges, fresh, "parent")


_OLD = "(select * from notices where published_at < timestamp '1996-01-01')"


@query(f" select count(*)::bigint n, count(*) || ':' || sum(('0x' || substr(md5(id || '|' || strftime(published_at, '%Y-%m-%d %H:%M:%S')), 1, 8))::bigint)::bigint as \"token\" from {_OLD}")
def deletion_preview(d: Domain) -> DataFrame:
    return merge.preview(d.notices.where("published_at < timestamp '1996-01-01'"), "id", "published_at")


@query(" select id, true fresh from notices where published_at is null or published_at >= timestamp '1996-01-01' union all select id, false from notices")
def bound_deletions(d: Domain) -> DataFrame:
    rows = d.notices.select("id", "published_at")
    scope = rows.where("published_at < timestamp '1996-01-01'")
    token = merge.preview(scope, "id", "published_at").first().token
    done, refused = merge.deleted(rows, scope, "id", "published_at", token), merge.deleted(rows, scope, "id", "published_at", "0:0")
    return done.select("id", F.lit(True).alias("fresh")).unionByName(refused.select("id", F.lit(False).alias("fresh")))
