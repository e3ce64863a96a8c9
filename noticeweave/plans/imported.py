"""Queries of imports: orders are notices, of which some are there, some come, and some are both under the same address or without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeweave.operators import imports
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query

_NOTICES = """
with n as (
  select o_orderkey id, o_orderkey // 6 % 7 school, o_orderkey // 6 % 5 dep, case when o_orderkey % 11 = 0 then o_orderpriority else 'T' || o_orderkey // 6 end t, case when o_orderkey // 6 % 4 = 0 then '' else 'u' || o_orderkey // 6 end u,
         case when o_orderkey // 6 % 3 = 0 then null else date_trunc('year', o_orderdate) end pub, case when o_orderkey // 6 % 6 = 0 then null else timestamp '2024-01-01' end cre,
         case when o_orderkey % 4 = 1 then 'S' || o_orderkey end summary, case when o_orderkey % 5 = 0 then 'body ' || o_orderkey when o_orderkey % 5 = 1 then '' end txt, case when o_orderkey % 7 = 0 then '<p>' || o_orderkey end html
  from orders
),
k as (
  select *, case when u <> '' then 'u' || school || '|' || u else 'h' || school || '|' || dep || '|' || t || '|' || coalesce(coalesce(pub, cre)::varchar, 'none') || case when coalesce(pub, cre) is null then '|' || coalesce(txt, '') || '|' || coalesce(html, '') else '' end end key from n
),
cur as (select *, row_number() over (partition by key order by id) r from k where id % 3 = 0),
inc as (select * from k where id % 2 = 0),
bo as (select key, id, true c, t, u, pub, summary, txt, html from cur where r = 1 union all select key, id, false, t, u, pub, summary, txt, html from inc),
b as (select *, coalesce(txt, '') <> '' or coalesce(html, '') <> '' body from bo)
"""


def _tables(d: Domain) -> tuple[DataFrame, DataFrame]:
    o = F.col("o_orderkey")
    g = F.floor(o / 6)
    none: Column = F.lit(None)
    rows = d.table("orders").select(
        o.alias("id"), (g % 7).alias("school"), (g % 5).alias("department"), F.when(o % 11 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("T"), g)).alias("title"), F.when(g % 4 == 0, "").otherwise(F.concat(F.lit("u"), g)).alias("url"),
        F.when(g % 3 != 0, F.date_trunc("year", "o_orderdate")).alias("published_at"), F.when(g % 6 != 0, F.lit("2024-01-01").cast("timestamp")).alias("created_at"), F.when(o % 4 == 1, F.concat(F.lit("S"), o)).alias("summary"),
        F.when(o % 5 == 0, F.concat(F.lit("body "), o)).when(o % 5 == 1, "").alias("body_text"), F.when(o % 7 == 0, F.concat(F.lit("<p>"), o)).alias("body_html"), none.cast("string").alias("hash"),
    )
    return rows.where("id % 3 = 0"), rows.where("id % 2 = 0")


@query(
    _NOTICES + """, m as (
  select key, min(case when c then 0 else 1 end) = 1 added, coalesce(min(id) filter (c), min(id)) kept, count(*) filter (not c) copies, bool_or(body) any_body, coalesce(bool_or(c and body), false) had, arg_min(t, (not c, id)) t,
         arg_min(summary, (not c, id)) filter (summary is not null) summary, arg_min(pub, (not c, id)) filter (pub is not null) pub, arg_min(coalesce(txt, '~'), (not c, id)) filter (body) txt, arg_min(coalesce(html, '~'), (not c, id)) filter (body) html
  from b group by key
)
select kept, added, copies, any_body and not had and copies > 0 restored, t title, summary, strftime(pub, '%Y') published, nullif(txt, '~') body_text, nullif(html, '~') body_html from m
union all select id, false, 0, false, t, summary, strftime(pub, '%Y'), txt, html from cur where r > 1""",
    domain=False,
)
def imported_notices(d: Domain) -> DataFrame:
    merged = imports.merged_notices(*_tables(d))
    return merged.select("kept", "added", "copies", "restored", "title", "summary", F.date_format("published_at", "yyyy").alias("published"), "body_text", "body_html")


@query(
    _NOTICES + " select id, coalesce((select min(id) from cur where cur.key = inc.key), (select min(id) from inc j where j.key = inc.key)) kept, not exists (select 1 from cur where cur.key = inc.key) added from inc",
    domain=False,
)
def import_identities(d: Domain) -> DataFrame:
    return imports.import_map(*_tables(d))


@query(
    """with c as (select o_orderkey id, o_orderkey % 5 school, 'u' || o_orderkey u, o_orderkey % 4 dep, o_orderpriority t from orders), l as (select l_orderkey k, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey nth, l_suppkey % 4 dep, 'New ' || l_partkey t, case l_partkey % 3 when 0 then '1-URGENT' when 1 then '5-LOW' else 'none' end v from lineitem)
  select id, arg_min(l.t, nth) title from c join l on l.k = c.id and l.dep = c.dep and l.v = c.t group by id""",
    domain=False,
)
def corrected_titles(d: Domain) -> DataFrame:
    o, p = F.col("o_orderkey"), F.col("l_partkey")
    current = d.table("orders").select(o.alias("id"), (o % 5).alias("school"), F.concat(F.lit("u"), o).alias("url"), (o % 4).alias("department"), F.col("o_orderpriority").alias("title"))
    k = F.col("l_orderkey")
    nth = F.col("l_linenumber") * F.lit(1_000_000_000_000) + p * 100_000 + F.col("l_suppkey")
    variants = F.array(F.when(p % 3 == 0, "1-URGENT").when(p % 3 == 1, "5-LOW").otherwise("none"), F.lit("other"))
    listed = d.table("lineitem").select((k % 5).alias("school"), F.concat(F.lit("u"), k).alias("url"), (F.col("l_suppkey") % 4).alias("department"), nth.alias("nth"), F.concat(F.lit("New "), p).alias("title"), variants.alias("variants"))
    return imports.retitled(current, listed)


@query(
    """with recursive nm as (select s_suppkey school, 'a' || s_suppkey as name from supplier union select s_suppkey, 'a' || s_suppkey + 1 from supplier where s_suppkey % 5 = 0 union select s_suppkey, 'b' || s_suppkey from supplier),
  e as (select distinct a.school x, b.school y from nm a join nm b on a.name = b.name), w(x, y) as (select x, y from e union select w.x, e.y from w join e on e.x = w.y), c as (select x school, count(distinct y) n from w group by 1),
  i as (select distinct 'a' || p_partkey % 200 as name from part union select distinct 'b' || p_partkey % 30 from part)
  select i.name, case when max(c.n) = 1 then min(nm.school) end school, case when max(c.n) is null then 'new' when max(c.n) = 1 then 'known' else 'conflict' end "state" from i left join nm on nm.name = i.name left join c on c.school = nm.school group by i.name""",
    domain=False,
)
def school_identities(d: Domain) -> DataFrame:
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    supplier = d.table("supplier")
    named = lambda rows, letter, n: rows.select(s.alias("school"), F.concat(F.lit(letter), n).alias("name"))
    names = named(supplier, "a", s).unionByName(named(supplier.where(s % 5 == 0), "a", s + 1)).unionByName(named(supplier, "b", s))
    incoming = d.table("part").select(F.explode(F.array(F.concat(F.lit("a"), p % 200), F.concat(F.lit("b"), p % 30))).alias("name"))
    return imports.school_identities(incoming, names)
