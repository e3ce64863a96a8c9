"""Queries of typed facts: three sites whose pages are orders, departments suppliers, records and links lines, and directory entries parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.operators import facts
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query

_FACTS = """
with recursive pages as (
  select o_orderkey % 3 site, 'u' || o_orderkey url, case o_orderstatus when 'P' then 'queued' else 'fetched' end state, 'h' || o_orderkey % 4 hash, case when o_orderkey % 5 > 0 then o_orderkey % 9 > 0 end retained from orders
),
dep as (
  select s_suppkey % 3 site, s_suppkey id, case s_suppkey % 4 when 0 then 'source' when 3 then 'directory_group' else 'organization' end kind, case when s_suppkey % 5 > 0 then 'k' || s_suppkey % 37 end k,
         case when s_suppkey % 4 = 0 then 'source:' || s_suppkey else 'entity:' || s_suppkey % 3 || ':' || case when s_suppkey % 5 > 0 then 'k' || s_suppkey % 37 else s_suppkey::varchar end end node,
         'w' || s_suppkey url, 'c' || s_suppkey % 6 cfg from supplier
),
line as (
  select l_orderkey % 3 site, 'u' || l_orderkey ref, 'k' || l_suppkey % 37 k, case when l_partkey % 4 > 0 then 'k' || l_partkey % 37 end pk, ['page_identity', 'menu_group', 'directory_entry', 'sub_unit', 'attached_unit', 'publication_column', 'x'][l_partkey % 7 + 1] rel,
         case when l_suppkey % 3 = 0 then '' else 'v' || l_partkey % 50 end url, case when l_partkey % 11 = 0 then l_suppkey end dep, case when l_quantity < 2 then ' ' else 'li' || l_linenumber end loc,
         case when l_discount < 0.08 then 'h' || l_orderkey % 4 else 'old' end hash, l_linenumber n from lineitem
),
ent as (
  select p_partkey id, p_partkey % 3 site, 3 * (p_partkey % 30) + p_partkey % 3 parent, 3 * (p_partkey % 23 + 3) + p_partkey % 3 child, ['organization_membership', 'organization_membership', 'source_ownership', 'source_ownership', 'other'][p_size % 5 + 1] ty,
         case p_partkey % 3 when 0 then 'sub_unit' when 1 then 'attached_unit' end obs, case when p_partkey % 2 = 1 then 'k' || (3 * (p_partkey % 23 + 3) + p_partkey % 3) % 37 end k,
         'u' || (3 * (p_partkey % 500) + p_partkey % 3) ref, i, ['th', 'td'][i + 1] loc, case when p_partkey % 10 < 8 or i = 0 then 'h' || (3 * (p_partkey % 500) + p_partkey % 3) % 4 else 'old' end hash
  from part, range(2) r(i)
),
claim as (
  select 'line' src, site, ref, loc, hash, null::bigint id, 0 i from line where n <= 5 union all select 'ent', site, ref, loc, hash, id, i from ent
),
fault as (
  select distinct c.*, case when trim(loc) = '' then 'incomplete_web_evidence' when p.url is null or p.state <> 'fetched' or p.hash <> c.hash then 'stale_or_unavailable_material' when not coalesce(p.retained, true) then 'original_material_not_retained' end f
  from claim c left join pages p on p.site = c.site and p.url = c.ref
),
goodline as (select distinct line.* from line join fault f on f.src = 'line' and f.site = line.site and f.ref = line.ref and f.loc = line.loc and f.hash = line.hash where f.f is null),
gooden as (select ent.* from ent join fault f on f.src = 'ent' and f.id = ent.id and f.i = ent.i where f.f is null),
byent as (select g.site, g.ref, g.k, min(node) node from gooden g join dep on dep.site = g.site and dep.id = g.child and kind <> 'source' where g.k is not null group by 1, 2, 3 having count(distinct node) = 1),
bykey as (select site, k, min(node) node from dep where kind <> 'source' and k is not null group by 1, 2 having count(*) = 1),
rec as (
  select l.*, case when l.dep is not null then case when d.kind <> 'source' then d.node end else coalesce(e.node, b.node) end bound, 'page:' || l.site || ':' || substr(sha256(l.ref), 1, 24) page
  from goodline l left join dep d on d.site = l.site and d.id = l.dep left join byent e on e.site = l.site and e.ref = l.ref and e.k = l.k left join bykey b on b.site = l.site and b.k = l.k where l.n <= 4
),
rec2 as (
  select *, case when rel = 'page_identity' then page else coalesce(bound, 'observation:' || site || ':' || substr(sha256('{"reference":"' || ref || '","node_key":"' || k || '","locator":"' || loc || '"' || case when pk is null then '' else ',"parent_key":"' || pk || '"' end || '}'), 1, 24)) end node from rec
),
par as (select site, ref, k pk, min(node) above from rec2 group by 1, 2, 3 having count(distinct node) = 1),
lst as (select r.*, case when r.pk is null then page else above end above from rec2 r left join par on par.site = r.site and par.ref = r.ref and par.pk = r.pk where rel in ('directory_entry', 'sub_unit', 'attached_unit')),
org as (select distinct site, node from dep where kind = 'organization'),
raw as (select l.*, exists (select 1 from org o where o.site = l.site and o.node = l.above) and exists (select 1 from org o where o.site = l.site and o.node = l.node) ok from lst l where above is not null and rel <> 'directory_entry'),
jud as (
  select e.id, any_value(e.site) site, any_value(e.parent) parent, any_value(e.child) child, any_value(e.ty) ty, any_value(e.obs) obs, count(g.id) good, any_value(p.node) pn, any_value(c.node) cn, any_value(p.kind) pkind, any_value(c.kind) ckind
  from ent e left join gooden g on g.id = e.id and g.i = e.i left join dep p on p.site = e.site and p.id = e.parent left join dep c on c.site = e.site and c.id = e.child group by e.id
),
jud2 as (
  select *, case when ty = 'other' then 'legacy_membership_without_evidence' when pn is null or cn is null then 'missing_membership_endpoint'
    when ty = 'organization_membership' and not (pkind = 'organization' and ckind = 'organization') then 'invalid_organization_endpoints' when ty = 'organization_membership' and obs is null then 'organization_claim_not_explicit'
    when ty = 'organization_membership' and not (id % 13 > 0 and good = 2) then 'organization_assertion_unverified'
    when ty = 'source_ownership' and not (pkind = 'organization' and ckind = 'source') then 'invalid_ownership_endpoints' when ty = 'source_ownership' and id % 2 = 0 and id % 7 = 2 then 'ownership_receipt_not_current'
    when ty = 'source_ownership' and not (good = 2 and id % 4 < 3) then 'publisher_identity_assertion_unverified' end code from jud
),
typed as (select j.site, pn, cn, j.ty, j.obs, g.ref, g.hash, g.loc from jud2 j join gooden g on g.id = j.id where code is null),
rels as (
  select site, 'page:' || site || ':' || substr(sha256(url), 1, 24) source, node target, 'source_on_page' "type", null observed, url || '|departments:' || id || ':list' || '|' || cfg p from dep where kind = 'source'
  union all select site, 'page:' || site || ':' || substr(sha256(ref), 1, 24), 'page:' || site || ':' || substr(sha256(url), 1, 24), 'navigation_link', null, ref || '|' || loc || '|' || hash from goodline where url <> '' and (n = 5 or n <= 4 and rel in ('menu_group', 'directory_entry', 'publication_column'))
  union all select site, bound, 'page:' || site || ':' || substr(sha256(url), 1, 24), 'entity_page', null, ref || '|' || loc || '|' || hash from rec2 where rel <> 'page_identity' and bound is not null and url <> ''
  union all select site, above, node, 'directory_listing', rel, ref || '|' || loc || '|' || hash from lst where above is not null
  union all select site, pn, cn, ty, obs, ref || '|' || loc || '|' || hash from typed
),
relations as (select site, source, target, "type", observed, count(distinct p)::int proofs from rels where source <> target group by all)
"""
_GAPS = """,
gaps as (
  select site, f code, ref subject, loc other from fault where f is not null
  union all select site, 'unresolved_entity_binding', dep::varchar, ref from rec2 where dep is not null and bound is null
  union all select site, 'missing_or_ambiguous_structural_parent', node, ref from lst where above is null
  union all select site, case when ok then 'organization_assertion_unverified' else 'organization_identity_not_bound' end, above, node from raw r
    where not ok or not exists (select 1 from typed t where t.ty = 'organization_membership' and t.site = r.site and t.pn = r.above and t.cn = r.node and t.ref = r.ref and t.hash = r.hash)
  union all select site, code, parent::varchar, child::varchar from jud2 where code is not null
)
select distinct site::bigint site, code, subject, other from gaps
"""
_DERIVED = """,
m as (select distinct site, source, target from relations where "type" = 'organization_membership'),
anc(site, source, target, steps) using key (site, source, target) as (
  select m.site, m.source, n.target, 2 from m join m n on n.site = m.site and n.source = m.target where m.source <> n.target
  union select a.site, a.source, m.target, min(a.steps) + 1 from anc a join m on m.site = a.site and m.source = a.target left join recurring.anc x on x.site = a.site and x.source = a.source and x.target = m.target where a.source <> m.target and x.site is null group by 1, 2, 3
),
up as (select site, source, target, 1 steps from m union all select site, source, target, steps from anc),
low as (select u.site, u.source, o.target, min(u.steps) + 1 steps from up u join relations o on o.site = u.site and o.source = u.target and o."type" = 'source_ownership' where u.source <> o.target group by 1, 2, 3)
select site::bigint site, source, target, 'organization_ancestry' "type", steps from anc union all select site::bigint, source, target, 'source_below', steps from low
"""


def _facts(d: Domain) -> tuple[DataFrame, DataFrame]:
    o, s, p = F.col("o_orderkey"), F.col("s_suppkey"), F.col("p_partkey")
    pages = d.table("orders").select(
        (o % 3).alias("site"), F.concat(F.lit("u"), o).alias("url"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("fetched").alias("state"), F.concat(F.lit("h"), o % 4).alias("content_hash"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("checked_at"), F.when(o % 5 > 0, o % 9 > 0).alias("retained"),
    )
    departments = d.table("supplier").select(
        (s % 3).alias("site"), s.alias("id"), F.when(s % 4 == 0, "column").when(s % 4 == 3, "group").otherwise("unit").alias("kind"), F.when(s % 5 > 0, F.concat(F.lit("k"), s % 37)).alias("structure_key"),
        F.concat(F.lit("w"), s).alias("url"), F.concat(F.lit("c"), s % 6).alias("config"), F.lit(None).cast("string").alias("config_at"),
    )
    lo, lp, ls, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    names = F.array(*map(F.lit, ("page_identity", "menu_group", "directory_entry", "sub_unit", "attached_unit", "publication_column", "x")))
    lines = d.table("lineitem").select(
        (lo % 3).alias("site"), F.concat(F.lit("u"), lo).alias("reference"), F.concat(F.lit("k"), ls % 37).alias("node_key"), F.when(lp % 4 > 0, F.concat(F.lit("k"), lp % 37)).alias("parent_key"), F.get(names, (lp % 7).cast("int")).alias("relation"),
        F.when(ls % 3 == 0, "").otherwise(F.concat(F.lit("v"), lp % 50)).alias("url"), F.when(lp % 11 == 0, ls).alias("department"), F.when(F.col("l_quantity") < 2, " ").otherwise(F.concat(F.lit("li"), n)).alias("locator"),
        F.when(F.col("l_discount") < 0.08, F.concat(F.lit("h"), lo % 4)).otherwise("old").alias("hash"), F.lit(None).cast("string").alias("at"), n.alias("n"),
    )
    site = p % 3
    child, place = 3 * (p % 23 + 3) + site, 3 * (p % 500) + site
    types = F.array(*map(F.lit, ("organization_membership", "organization_membership", "source_ownership", "source_ownership", "other")))
    kind = F.get(types, (F.col("p_size") % 5).cast("int"))
    observed = F.when(p % 3 == 0, "sub_unit").when(p % 3 == 1, "attached_unit")
    owner = kind == "source_ownership"
    predicate = F.when(owner, "publication_owner").when(p % 13 == 0, "unknown").when(p % 3 == 1, "attached_unit").otherwise("subordinate_unit")
    assertion = F.struct(
        F.when(owner, "explicit_publisher_identity").otherwise("explicit_table_header").alias("kind"), predicate.alias("predicate"), F.when(owner, "publisher_to_source").otherwise("parent_to_child").alias("direction"),
        F.lit("th").alias("locator"), F.lit("td").alias("child_locator"), F.when(p % 4 < 3, F.concat(F.lit("w"), child)).otherwise("").alias("entry_url"),
    )
    entries = d.table("part").select(
        p.alias("id"), site.alias("site"), (3 * (p % 30) + site).alias("parent"), child.alias("child"), kind.alias("type"), observed.alias("observed"), F.when(p % 2 == 1, F.concat(F.lit("k"), child % 37)).alias("node_key"),
        F.concat(F.lit("c"), child % 6).alias("config"), F.when(p % 7 == 2, "r9").otherwise("r1").alias("receipt"), F.when(p % 2 == 0, "official_structure").otherwise("hand").alias("writer"), assertion.alias("assertion"),
        F.concat(F.lit("u"), place).alias("reference"), F.lit(None).cast("string").alias("at"), F.explode(F.array(F.struct(F.lit("th").alias("locator"), F.concat(F.lit("h"), place % 4).alias("hash")), F.struct(F.lit("td").alias("locator"), F.when(p % 10 < 8, F.concat(F.lit("h"), place % 4)).otherwise("old").alias("hash")))).alias("c"),
    ).select("*", "c.*").drop("c")
    receipts = d.table("supplier").select((s % 3).alias("site"), s.alias("department"), F.concat(F.lit("c"), s % 6).alias("config"), F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("receipt"))
    edges = lines.where("n = 5 and url <> ''").withColumnRenamed("url", "target").drop("node_key", "parent_key", "relation", "department", "n")
    more = lines.where("n = 5 and url = ''").withColumn("target", F.lit("")).drop("url", "node_key", "parent_key", "relation", "department", "n")
    return facts.structure_facts(pages, departments, lines.where("n <= 4").drop("n"), edges.unionByName(more), entries, receipts)


@query(_FACTS + " select site::bigint site, source, target, \"type\", observed, proofs from relations", domain=False)
def fact_relations(d: Domain) -> DataFrame:
    return _facts(d)[0].select("site", "source", "target", "type", "observed", F.size("proofs").alias("proofs"))


@query(_FACTS + _GAPS, domain=False)
def fact_gaps(d: Domain) -> DataFrame:
    return _facts(d)[1]


@query(_FACTS + _DERIVED, domain=False)
def derived_facts(d: Domain) -> DataFrame:
    return facts.derived(_facts(d)[0]).select("site", "source", "target", "type", "steps")
