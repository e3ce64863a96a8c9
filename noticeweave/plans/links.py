"""Queries of directories, branches, ways and groups of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.functions.scalars import host
from noticeweave.operators import graphs, hierarchy, placements
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query
from noticeweave.plans.scopes import tree

_DAG = """with recursive n as (select s_suppkey id from supplier), e as (select id // 4 parent, id child from n where id >= 4 union select id // 3, id from n where id >= 3 and id % 5 = 0),"""
_CHAINS = _DAG + """ w(node, chain) as (select id, [id] from n union all select w.node, list_prepend(e.parent, w.chain) from w join e on e.child = w.chain[1] and not list_contains(w.chain, e.parent)),
  ways as (select distinct node, chain from w where not exists (select 1 from e where e.child = w.chain[1]))"""


def dag(d: Domain) -> DataFrame:
    """A directory in which each fifth department has a second parent."""
    more = d.departments.where("id >= 3 and id % 5 = 0").select(F.floor(F.col("id") / 3).alias("parent"), F.col("id").alias("child"))
    return tree(d).union(more).distinct()


@query(_CHAINS + " select node, array_to_string(chain, '/') chain from ways", domain=False)
def all_chains(d: Domain) -> DataFrame:
    chains = hierarchy.all_chains(dag(d), d.departments.select(F.col("id").alias("node")))
    return chains.select("node", F.array_join(F.transform("chain", lambda x: x.cast("string")), "/").alias("chain"))


@query(
    _CHAINS + """, u as (select node, list_filter(chain[1:len(chain) - 1], lambda x: x % 3 > 0) units from ways), k as (select * from u where len(units) > 0)
  select node, array_to_string(max((len(units), units))[2], '/') units from k group by node having count(distinct units[-1]) = 1""",
    domain=False,
)
def unit_chains(d: Domain) -> DataFrame:
    chains = hierarchy.all_chains(dag(d), d.departments.select(F.col("id").alias("node")))
    found = hierarchy.unit_chain(chains, d.departments.where("id % 3 > 0").select(F.col("id").alias("node")))
    return found.select("node", F.array_join(F.transform("units", lambda x: x.cast("string")), "/").alias("units"))


_SITE = _DAG + """ lv(id, depth) as (select id, 0 from n where id not in (select child from e) union all select e.child, lv.depth + 1 from lv join e on e.parent = lv.id), pg as (select id url, max(depth) depth, case when id < 3 then 'root' when id % 7 = 0 then 'unit' else 'menu' end kind from lv group by id)"""


def _site(d: Domain) -> DataFrame:
    """Pages of the directory: depth is the longest way, computed by levels."""
    chains = hierarchy.all_chains(dag(d), d.departments.select(F.col("id").alias("node")))
    depth = chains.groupBy(F.col("node").alias("url")).agg(F.max(F.size("chain") - 1).alias("depth"))
    kind = F.when(F.col("url") < 3, "root").when(F.col("url") % 7 == 0, "unit").otherwise("menu")
    return depth.withColumn("kind", F.when(F.col("depth") == 0, "root").otherwise(kind))



@query(
    _SITE.replace("case when id < 3 then 'root'", "case when max(depth) = 0 then 'root' when id < 3 then 'root'")
    + """, b(url, depth, branch) using key (url) as (select url, depth, url from pg where depth = 0 union
  select g.url, g.depth, case when g.kind in ('root', 'unit') or g.lo is null or g.lo <> g.hi or g.rt then g.url else g.lo end from (
    select p.url, p.depth, p.kind, min(x.branch) lo, max(x.branch) hi, bool_or(q.kind = 'root') rt from pg p join (select max(depth) dd from b) m on p.depth = m.dd + 1 left join e on e.child = p.url
      left join recurring.b x on x.url = e.parent left join pg q on q.url = e.parent group by 1, 2, 3) g) select url, branch from b""",
    domain=False,
)
def branch_clocks(d: Domain) -> DataFrame:
    return hierarchy.branches(_site(d), dag(d))


@query(
    _DAG + """ one as (select child, min(parent) parent from e group by 1 having count(*) = 1), c(url) as (select id from n where id % 11 = 0 union select one.parent from c join one on one.child = c.url where one.parent // 2 = c.url // 8 or one.parent % 2 = c.url % 2)
  select distinct url from c""",
    domain=False,
)
def path_credit(d: Domain) -> DataFrame:
    # one scope for all pages whose parents are near: scopes are given here, edges between scopes carry no credit
    edges = dag(d)
    near = (F.floor(F.col("parent") / 2) == F.floor(F.col("child") / 8)) | (F.col("parent") % 2 == F.col("child") % 2)
    only = graphs.only_parents(edges).where(near)
    scopes = d.departments.select(F.col("id").alias("url"), F.lit(1).alias("branch"))
    return hierarchy.credited(scopes, only, d.departments.where("id % 11 = 0").select(F.col("id").alias("url")))


@query(
    _DAG + """ e2 as (select * from e union all select id, id - 1 from n where id % 13 = 1 and id > 13 and id - 1 < 4), pc as (select child, min(parent) parent, count(*) k from (select distinct * from e2) group by 1),
  t(url, pos, steps, seen) as (select id, id, 0, [id] from n union all select t.url, pc.parent, steps + 1, list_append(seen, pc.parent) from t join pc on pc.child = t.pos and pc.k = 1 where t.pos > 2 and not list_contains(seen, pc.parent))
  select url, max((steps, pos))[2] top, max(steps)::bigint steps, case when max((steps, pos))[2] <= 2 then 'root_reached' when (select k from pc where child = max((steps, pos))[2]) > 1 then 'ambiguous_parents' else 'no_parent' end reason from t group by url""",
    domain=False,
)
def path_trails(d: Domain) -> DataFrame:
    pages = d.departments.select(F.col("id").alias("url"), F.when(F.col("id") <= 2, "root").otherwise("menu").alias("kind"))
    return hierarchy.trails(pages, dag(d)).select("url", "top", F.col("steps").cast("long").alias("steps"), "reason")


@query(
    """with recursive e as (select o_orderkey a, o_orderkey + 7 b from orders where o_orderkey % 5 > 1 and o_orderkey + 7 in (select o_orderkey from orders)), s as (select a, b from e union select b, a from e),
  c(node, component) using key (node) as (select a, min(a) from s group by 1 union select s.a, min(c.component) from c join s on s.b = c.node join recurring.c x on x.node = s.a where c.component < x.component group by 1)
  select node, component from c""",
    domain=False,
)
def address_groups(d: Domain) -> DataFrame:
    o = d.table("orders").select(F.col("o_orderkey").alias("a"))
    edges = o.where("a % 5 > 1").withColumn("b", F.col("a") + 7).join(o.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    return hierarchy.connected(edges)


@query(
    """with recursive ev as (select user_id k, event_id id, case when event_id % 4 > 0 then event_id // 2 * 2 - event_id % 4 * 2 end p, event_id s from events), t as (select *, row_number() over (partition by k order by s desc) nth from ev),
  a(k, id, hops) using key (k, id) as (select k, id, 0 from t where nth <= 3 union select ev.k, ev.id, min(a.hops) + 1 from a join ev c on c.k = a.k and c.id = a.id join ev on ev.k = c.k and ev.id = c.p left join recurring.a x on x.k = ev.k and x.id = ev.id where x.k is null group by 1, 2),
  r as (select *, row_number() over (partition by k order by hops, id desc) place from a) select k, id event_id, hops = 0 recent from r where place <= 6""",
    domain=False,
)
def causal_windows(d: Domain) -> DataFrame:
    e = F.col("event_id")
    rows = d.table("events").select(F.col("user_id").alias("k"), "event_id", F.when(e % 4 > 0, F.floor(e / 2) * 2 - e % 4 * 2).alias("parent_id"), e.alias("sequence"))
    return hierarchy.causal_window(rows, "k", 3, 6).select("k", "event_id", "recent")


@query("select user_id k, event_id + 1 parent_id from events where event_id % 3 = 0 and event_id + 1 not in (select event_id from events e where e.event_id % 3 = 0 and e.user_id = events.user_id) group by 1, 2", domain=False)
def missing_parents(d: Domain) -> DataFrame:
    rows = d.table("events").where("event_id % 3 = 0").select(F.col("user_id").alias("k"), "event_id", (F.col("event_id") + 1).alias("parent_id"))
    return hierarchy.missing_parents(rows, "k")


@query("select distinct l_orderkey source, l_partkey target from lineitem join orders on o_orderkey = l_orderkey and o_orderstatus = l_linestatus where l_orderkey <> l_partkey and l_linenumber > 1", domain=False)
def page_relations(d: Domain) -> DataFrame:
    records = d.table("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.when(F.col("l_linenumber") > 1, "li a").otherwise("").alias("locator"), F.col("l_linestatus").alias("content_hash"))
    return hierarchy.page_relations(records, d.table("orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("hash")))


@query(
    """with r as (select l_orderkey reference, l_linenumber % 3 node, case when l_linenumber > 2 then (l_linenumber + 1) % 3 end parent, l_partkey % 40 url from lineitem),
  o as (select reference, node parent, min(url) source from r group by 1, 2 having count(distinct url) = 1) select distinct source, url target, reference from r join o using (reference, parent) where source <> url""",
    domain=False,
)
def menu_relations(d: Domain) -> DataFrame:
    n = F.col("l_linenumber")
    return hierarchy.menu_relations(d.table("lineitem").select(F.col("l_orderkey").alias("reference"), (n % 3).alias("node"), F.when(n > 2, (n + 1) % 3).alias("parent"), (F.col("l_partkey") % 40).alias("url")))


@query(
    """with e as (select l_suppkey k, 'u' || l_partkey % 5 u, 'n' || l_linenumber n, l_returnflag p, l_linestatus h, 'l' || l_partkey % 3 l from lineitem), p as (select k, p, h, string_agg(distinct l, ',' order by l) ls from e group by 1, 2, 3),
  r as (select k, string_agg(p || h || ':' || ls, ';' order by p, h) pages from p group by 1) select k, string_agg(distinct u, ',' order by u) urls, string_agg(distinct n, ',' order by n) as names, any_value(pages) pages from e join r using (k) group by 1""",
    domain=False,
)
def merged_paths(d: Domain) -> DataFrame:
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    rows = d.table("lineitem").select(
        F.col("l_suppkey").alias("k"), F.concat(F.lit("u"), part % 5).alias("entry_url"), F.concat(F.lit("n"), line).alias("entry_name"), F.col("l_returnflag").alias("page"), F.col("l_linestatus").alias("hash"), F.concat(F.lit("l"), part % 3).alias("locator"),
    )
    found = hierarchy.merged_paths(rows, ["k"])
    shown = F.transform("pages", lambda p: F.concat(p["page"], p["hash"], F.lit(":"), F.array_join(p["locators"], ",")))
    return found.select("k", F.array_join("urls", ",").alias("urls"), F.array_join("names", ",").alias("names"), F.array_join(shown, ";").alias("pages"))


@query(
    """with s as (select p_partkey id, p_size % 5 h, '/a/' || p_partkey % 4 || '/' || p_partkey % 3 p from part), u as (select s_suppkey unit, s_suppkey % 5 h, case s_suppkey % 3 when 0 then '/a' when 1 then '/a/' || s_suppkey % 4 else '/b' end b from supplier),
  m as (select s.id source, unit, b from s join u on u.h = s.h and (p = b or starts_with(p, b || '/'))) select source, min(unit) unit from m where length(b) = (select max(length(b)) from m x where x.source = m.source) group by 1 having count(distinct unit) = 1""",
    domain=False,
)
def website_owners(d: Domain) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    sources = d.table("part").select(p.alias("id"), (F.col("p_size") % 5).cast("long").alias("host"), F.concat(F.lit("/a/"), p % 4, F.lit("/"), p % 3).alias("path"))
    units = d.table("supplier").select(s.alias("id"), (s % 5).alias("host"), F.when(s % 3 == 0, "/a/").when(s % 3 == 1, F.concat(F.lit("/a/"), s % 4)).otherwise("/b").alias("path"))
    return placements.website_owners(sources, units)


@query("select l_partkey target, min(l_suppkey % 3) as \"owner\" from lineitem where l_linenumber < 3 and l_quantity < 6 group by 1 having count(distinct l_suppkey % 3) = 1", domain=False)
def publication_owners(d: Domain) -> DataFrame:
    claims = d.table("lineitem").where("l_linenumber < 3 and l_quantity < 6").select(F.col("l_partkey").alias("target"), (F.col("l_suppkey") % 3).alias("owner"))
    return hierarchy.only_owner(claims, "target", "owner")


@query(_DAG + " x as (select 1) select id, case when s_acctbal < 0 then 'default' when s_acctbal < 5000 then 'news' else 'default' end as \"group\", coalesce(string_agg(parent, ',' order by parent), '') parents from n join supplier on s_suppkey = id left join e on child = id group by 1, 2", domain=False)
def source_placements(d: Domain) -> DataFrame:
    named = F.coalesce(F.nullif(F.trim("group_name"), F.lit("")), F.lit("default"))
    rows = hierarchy.placements(d.departments, dag(d), named)
    return rows.select("id", "group", F.array_join(F.transform("parents", lambda x: x.cast("string")), ",").alias("parents"))


@query(_CHAINS + " select node id, array_to_string(chain, '/') path from ways where len(chain) <= 9", domain=False)
def source_tree(d: Domain) -> DataFrame:
    rows = hierarchy.source_tree(d.departments, dag(d), F.lit("all"))
    return rows.select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query(
    """with i as (select distinct l_partkey % 40 k, l_suppkey o, l_linenumber x from lineitem where l_quantity < 20), s as (select k, o, list(x order by x) xs from i group by 1, 2), f as (select k, xs, min(o) o from s group by 1, 2)
  select k, o, len(xs)::int n from f where not exists (select 1 from f g where g.k = f.k and len(g.xs) > len(f.xs) and list_has_all(g.xs, f.xs))""",
    domain=False,
)
def folded_displays(d: Domain) -> DataFrame:
    rows = d.table("lineitem").where("l_quantity < 20").select((F.col("l_partkey") % 40).alias("k"), F.col("l_suppkey").alias("o"), F.col("l_linenumber").alias("x"))
    return hierarchy.folded(rows, "k", "o", "x")


@query(
    _CHAINS + """, m as (select node, list(chain) cs from ways group by 1) select node, array_to_string(list_filter(cs[1], lambda x, i: len(list_filter(cs, lambda c: array_to_string(c[1:i], '/') = array_to_string(cs[1][1:i], '/'))) = len(cs)), '/') ancestors, len(cs)::int n from m""",
    domain=False,
)
def common_ancestors(d: Domain) -> DataFrame:
    chains = hierarchy.all_chains(dag(d), d.departments.select(F.col("id").alias("node")))
    found = hierarchy.common_ancestors(chains, "node", "chain")
    return found.select("node", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), "/").alias("ancestors"), "n")


@query(
    _DAG + """ r(root, node) as (select id, id from n where id <= 9 union select r.root, e.child from r join e on e.parent = r.node) select root, n, floor(1000 * (3 + least(7.0, 2 * log2(1 + n))))::bigint radius from (select root, count(distinct node) filter (node % 2 = 0)::bigint n from r group by 1)""",
    domain=False,
)
def configured_below(d: Domain) -> DataFrame:
    roots = d.departments.where("id <= 9").select(F.col("id").alias("node"))
    return hierarchy.configured_below(dag(d), roots, d.departments.where("id % 2 = 0").select(F.col("id").alias("node")))


@query(_DAG + " r(node, hops) as (select 60::bigint, 0 union select e.parent, hops + 1 from r join e on e.child = r.node) select node, min(hops)::int hops from r group by 1", domain=False)
def upstream_owners(d: Domain) -> DataFrame:
    return graphs.ancestors(dag(d), d.spark.createDataFrame([(60,)], "node long"))


@query(_DAG + " r(node, hops) as (select 1::bigint, 0 union select e.child, hops + 1 from r join e on e.parent = r.node), m as (select node, min(hops) h from r group by 1) select b.node, a.node parent, b.h::int hops from m a join e on e.parent = a.node join m b on b.node = e.child and b.h = a.h + 1", domain=False)
def shortest_parents(d: Domain) -> DataFrame:
    edges = dag(d)
    return graphs.shortest_parents(edges, graphs.descendants(edges, d.spark.createDataFrame([(1,)], "node long")))


@query(_DAG + " w(node, path) as (select 2::bigint, [2::bigint] union all select e.child, list_append(path, e.child) from w join e on e.parent = w.node and not list_contains(path, e.child) where len(path) <= 8) select node, array_to_string(path, '/') path from w", domain=False)
def stored_paths(d: Domain) -> DataFrame:
    found = graphs.bounded_paths(dag(d), d.spark.createDataFrame([(2,)], "node long"))
    return found.select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("select h host, count(*)::bigint n from (select regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') h from pages) group by 1", domain=False)
def pages_per_host(d: Domain) -> DataFrame:
    return d.table("pages").groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
