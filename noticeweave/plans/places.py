"""Queries of placements: whose website, whose name, and where in a directory a source stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.operators import displays, placements
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query

# Sources are parts of five schools; each line of an order is a way on which its part was seen: a group, a unit and sometimes a unit below it.
_PLACED = """
with src as (
  select p_partkey id, p_size % 5 school, 'https://h' || p_size % 5 || '.edu/' school_url,
         case p_partkey % 5 when 0 then 'u' || p_partkey % 7 || '-news' when 1 then 'u' || p_partkey % 7 || '-v' || p_partkey % 3 || '－x' when 2 then 'u' || p_partkey % 7 else 'column' end as name,
         case p_partkey % 3 when 0 then '' when 1 then 'G' || p_partkey % 4 else 'u' || p_partkey % 7 end cur,
         'https://h' || p_size % 5 || '.edu/a' || p_partkey % 4 || case when p_partkey % 9 = 0 then '/index.htm' else '/c' || p_partkey % 3 || '/' end url
  from part
),
grp as (select x school, 'G' || y g from range(4) a(x), range(2) b(y)),
pth as (
  select l_partkey id, l_orderkey * 10 + l_linenumber path, case when l_quantity > 46 then 'other' when l_quantity < 3 then 'school_website_entry' else 'official_website_entry' end basis,
         l_quantity < 3 hollow, l_quantity > 40 and l_quantity < 45 major, 'G' || l_suppkey % 4 g, l_tax < 0.07 named_group, l_linenumber % 3 entries,
         ['u' || l_suppkey % 7] || case when l_linenumber % 2 = 1 then ['v' || l_suppkey % 3] else [] end nm,
         ['a' || l_suppkey % 4 || '/index.htm'] || case when l_linenumber % 2 = 1 then [case when l_suppkey % 5 = 0 then 'a' || l_suppkey % 4 || '/w?x=1' else 'a' || l_suppkey % 4 || '/index.htm' end] else [] end u
  from lineitem
),
own as (
  select pth.* exclude (u), src.* exclude (id), list_transform(u, lambda x: school_url || x) u from pth join src using (id)
),
flag as (
  select *, cur = nm[-1] or list_bool_or(list_transform([nm[-1], array_to_string(nm, '-')], lambda p: name = p or starts_with(name, p || '-') or starts_with(name, p || '－') or starts_with(name, p || '—'))) named,
         case when contains(u[-1], '?') then url = u[-1] else starts_with(url, replace(u[-1], 'index.htm', '')) end below
  from own
),
ent as (select distinct id from own where hollow),
cand as (
  select f.*, k.g is not null known from flag f left join grp k on k.school = f.school and k.g = f.g
  where not hollow and not major and basis = 'official_website_entry' and named_group and (f.id not in (select id from ent) or named and url = u[-1])
    and (k.g is not null or cur = '' or list_contains(nm, cur)) and (named or below)
),
k1 as (select * from cand c where case when (select bool_or(known) from cand d where d.id = c.id) then known else (select count(distinct g) from cand d where d.id = c.id) = 1 end),
k2 as (select * from k1 c where cur = '' or not exists (select 1 from k1 d where d.id = c.id and d.g = c.cur) or g = cur),
one as (select id, g, nm, u, arg_min(named, (entries, path)) named, arg_min(path, (entries, path)) path from k2 group by all),
pool as (select *, count(distinct (nm[-1], split_part(u[-1], '.edu/', 2))) over (partition by id, u[-1]) last_units, bool_or(named) over (partition by id, u[-1]) any_named from one),
spec as (select * from pool p where last_units > 1 and named and not exists (select 1 from pool q where q.id = p.id and q.u[-1] = p.u[-1] and q.named and len(q.nm) > len(p.nm) and q.nm[:len(p.nm)] = p.nm and q.u[:len(p.nm)] = p.u)),
common as (select id, u[-1] site, min(nm[1]) lo, max(nm[1]) hi, min(u[1]) ulo, max(u[1]) uhi from pool where last_units > 1 and not any_named group by 1, 2),
res as (
  select id, g, nm, path from pool where last_units = 1
  union all select id, g, nm, path from spec s where (select count(distinct nm[-1]) from spec t where t.id = s.id and t.u[-1] = s.u[-1]) = 1
  union all select p.id, g, [lo], min(path) from pool p join common c on c.id = p.id and c.site = p.u[-1] where last_units > 1 and not any_named and lo = hi and ulo = uhi and ulo = site group by all
)
"""


def _sources(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, ways and established groups as in _PLACED."""
    k = F.col("p_partkey")
    unit = F.concat(F.lit("u"), k % 7)
    school_url = F.concat(F.lit("https://h"), F.col("p_size") % 5, F.lit(".edu/"))
    name = F.when(k % 5 == 0, F.concat(unit, F.lit("-news"))).when(k % 5 == 1, F.concat(unit, F.lit("-v"), k % 3, F.lit("－x"))).when(k % 5 == 2, unit).otherwise("column")
    sources = d.table("part").select(
        k.alias("id"), (F.col("p_size") % 5).cast("long").alias("school"), school_url.alias("school_url"), name.alias("name"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" G"), k % 4)).otherwise(unit).alias("group_name"),
        F.concat(school_url, F.lit("a"), k % 4, F.when(k % 9 == 0, "/index.htm").otherwise(F.concat(F.lit("/c"), k % 3, F.lit("/")))).alias("url"),
    )
    s, n, q = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity")
    base = F.concat(F.col("school_url"), F.lit("a"), s % 4)
    home = F.concat(base, F.lit("/index.htm"))
    node = lambda kind, relation, label, url: F.struct(F.lit(kind).alias("kind"), relation.alias("relation"), label.alias("name"), url.alias("url"))
    entry = F.lit("directory_entry")
    nodes = F.concat(
        F.array(node("group", F.when(F.col("l_tax") < 0.07, "menu_group").otherwise("shared_table_row"), F.concat(F.lit("G"), s % 4), F.lit(""))),
        F.when(q.between(41, 44), F.array(node("major", entry, F.lit("M"), F.lit("")))).otherwise(F.array()),
        F.array(node("unit", entry, F.concat(F.lit("u"), s % 7), home)),
        F.when(n % 2 == 1, F.array(node("unit", entry, F.concat(F.lit("v"), s % 3), F.when(s % 5 == 0, F.concat(base, F.lit("/w?x=1"))).otherwise(home)))).otherwise(F.array()),
    )
    kind = "array<struct<kind: string, relation: string, name: string, url: string>>"
    paths = d.table("lineitem").join(sources.select(F.col("id").alias("l_partkey"), "school_url"), "l_partkey").select(
        F.col("l_partkey").alias("source"), (F.col("l_orderkey") * 10 + n).alias("path"), F.when(q > 46, "other").when(q < 3, placements.SCHOOL_ENTRY).otherwise("official_website_entry").alias("basis"),
        F.lit(None).cast("string").alias("website_url"), F.array_repeat(F.lit("menu"), (n % 3).cast("int")).alias("entry_nodes"), F.when(q < 3, F.array().cast(kind)).otherwise(nodes.cast(kind)).alias("nodes"),
    )
    groups = sources.where("school < 4").select("school", F.explode(F.array(F.lit("G0"), F.lit("G1"))).alias("group")).distinct()
    return sources, paths, groups


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "group", F.array_join(F.transform("way", lambda u: u["name"]), "/").alias("way"), "path")


@query(_PLACED + " select id, g as \"group\", array_to_string(nm, '/') way, path from res", domain=False)
def placed_sources(d: Domain) -> DataFrame:
    return _shown(placements.source_placements(*_sources(d)))


@query(
    """with s as (select p_partkey id, 'h' || p_partkey // 80 h, '/a/' || p_partkey % 4 || '/' || p_partkey % 3 || case when p_partkey % 10 = 0 then '?q=' || p_partkey % 3 else '' end p from part),
  u as (select s_suppkey id, 'h' || s_suppkey // 4 h, case s_suppkey % 4 when 0 then '/a/index.html' when 1 then '/a/' || s_suppkey % 4 || '/' when 2 then '/b' else '/a/' || s_suppkey % 4 || '/' || s_suppkey % 3 || '?q=' || s_suppkey % 3 end p from supplier),
  m as (select s.id source, u.id unit, case when contains(u.p, '?') then 1000 else length(rtrim(replace(u.p, 'index.html', ''), '/')) end n from s join u on u.h = s.h
        and case when contains(u.p, '?') then s.p = u.p else starts_with(split_part(s.p, '?', 1) || '/', rtrim(replace(u.p, 'index.html', ''), '/') || '/') end)
  select source, min(unit) unit from m where n = (select max(n) from m x where x.source = m.source) group by 1 having count(distinct unit) = 1""",
    domain=False,
)
def address_owners(d: Domain) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    at = lambda key, size: F.concat(F.lit("https://h"), F.floor(key / size), F.lit("/a/"))
    sources = d.table("part").select(p.alias("id"), F.concat(at(p, 80), p % 4, F.lit("/"), p % 3, F.when(p % 10 == 0, F.concat(F.lit("?q="), p % 3)).otherwise("")).alias("url"))
    routed = F.concat(at(s, 4), s % 4, F.lit("/"), s % 3, F.lit("?q="), s % 3)
    url = F.when(s % 4 == 0, F.concat(at(s, 4), F.lit("index.html"))).when(s % 4 == 1, F.concat(at(s, 4), s % 4, F.lit("/"))).when(s % 4 == 2, F.concat(F.lit("https://h"), F.floor(s / 4), F.lit("/b"))).otherwise(routed)
    return placements.address_owners(sources, d.table("supplier").select(s.alias("id"), url.alias("url")))


# Two levels of shown units for each nation: suppliers at the top, below them what they sell; sources are parts.
_SHOWN = """
with top as (
  select s_nationkey tree, 'a' || s_suppkey unit, s_suppkey nth, 'N' || s_suppkey % 3 as name, s_suppkey % 5 = 0 verified, s_suppkey % 11 > 0 wide,
         case when s_suppkey % 3 = 0 then '' else 'https://x/' || s_suppkey % 2 end url, case when s_suppkey % 6 = 3 then 'record:' || s_suppkey % 4 else 'k' || s_suppkey end nav, s_suppkey % 12 = 6 preset
  from supplier
),
kid as (
  select distinct s_nationkey tree, 'a' || l_suppkey parent, 'b' || l_suppkey || '-' || l_partkey % 3 unit, l_partkey % 3 nth, 'K' || l_partkey % 3 as name, case when l_suppkey % 4 = 0 then 'https://x/k' || l_partkey % 3 else '' end url
  from lineitem join supplier on s_suppkey = l_suppkey where l_quantity > 30
),
src as (
  select distinct s_nationkey tree, 'a' || l_suppkey unit, l_suppkey % 3 * 10 + l_partkey % 2 source from lineitem join supplier on s_suppkey = l_suppkey where l_quantity < 3
  union select s_nationkey, 'b' || l_suppkey || '-' || l_partkey % 3, 100 + l_partkey % 4 from lineitem join supplier on s_suppkey = l_suppkey where l_quantity > 49
),
t1 as (
  select *, case when preset and url = '' and lo = hi then lo else url end u from (select *, min(case when not verified and wide and url <> '' then url end) over w lo, max(case when not verified and wide and url <> '' then url end) over w hi from top window w as (partition by tree, name))
),
t2 as (select *, case when verified or not wide then null when u <> '' then 'e' || name || u when starts_with(nav, 'record:') then 'r' || name || nav end same from t1),
t3 as (select *, case when same is null then unit else arg_min(unit, nth) over (partition by tree, same) end kept from t2),
k1 as (select kid.*, t3.kept above, t3.nth tn from kid join t3 on t3.tree = kid.tree and t3.unit = kid.parent),
k2 as (select *, case when url <> '' then arg_min(unit, (nth, unit)) over (partition by tree, above, name, url) else unit end kept from k1),
ko as (select k2.tree, k2.kept unit, list_sort(list(distinct source)) own from k2 join src on src.tree = k2.tree and src.unit = k2.unit group by all),
k3 as (select distinct k2.tree, k2.above, k2.unit, k2.nth, k2.name, k2.url, coalesce(own, []) own from k2 left join ko on ko.tree = k2.tree and ko.unit = k2.unit where k2.unit = k2.kept),
k4 as (select *, case when url = '' then row_number() over (partition by tree, above, name, url, own order by nth, unit) else 1 end place from k3),
k5 as (select * from k4 where place = 1),
inn as (select tree, above unit, list_sort(list((name, url, own))) inn, list(distinct x) filter (x is not null) deep from (select *, unnest(case when len(own) = 0 then [null] else own end) x from k5) group by all),
inn2 as (select tree, above unit, list_sort(list(name || '|' || url || '|' || array_to_string(own, ','))) inn from k5 group by all),
town as (select t3.tree, t3.kept unit, list_sort(list(distinct source)) own from t3 join src on src.tree = t3.tree and src.unit = t3.unit group by all),
t4 as (select t3.tree, t3.unit, t3.nth, t3.name, verified, wide, u, coalesce(town.own, []) own, coalesce(inn2.inn, []) inn, coalesce(inn.deep, []) deep
       from t3 left join town on town.tree = t3.tree and town.unit = t3.unit left join inn on inn.tree = t3.tree and inn.unit = t3.unit left join inn2 on inn2.tree = t3.tree and inn2.unit = t3.unit where t3.unit = t3.kept),
t5 as (select *, case when not verified and wide and u = '' then row_number() over (partition by tree, verified, wide, name, u, own, inn order by nth, unit) else 1 end place, list_distinct(list_concat(own, deep)) ids from t4),
t6 as (select * from t5 where place = 1),
t7 as (
  select * from t6 a where case when not wide then not list_has_all(coalesce((select list(distinct i) from (select unnest(ids) i from t6 b where b.tree = a.tree and b.wide)), []), ids)
    when not verified then not exists (select 1 from t6 b where b.tree = a.tree and b.verified and b.wide and b.name = a.name and list_has_all(b.ids, a.ids)) else true end
)
select tree::bigint tree, unit, name, u url, 0 as "depth", array_to_string(own, ',') own from t7
union all select k5.tree::bigint, k5.unit, k5.name, k5.url, 1, array_to_string(k5.own, ',') from k5 join t7 on t7.tree = k5.tree and t7.unit = k5.above
"""


@query(_SHOWN, domain=False)
def shown_trees(d: Domain) -> DataFrame:
    s, p = F.col("s_suppkey"), F.col("l_partkey")
    tree = F.col("s_nationkey").cast("long").alias("tree")
    top = d.table("supplier").select(
        tree, F.concat(F.lit("a"), s).alias("unit"), F.lit(None).cast("string").alias("parent"), s.alias("nth"), F.concat(F.lit("N"), s % 3).alias("name"), F.when(s % 5 == 0, displays.VERIFIED).otherwise(displays.DISPLAY).alias("basis"),
        (s % 11 > 0).alias("expandable"), F.when(s % 3 != 0, F.concat(F.lit("https://x/"), s % 2)).alias("url"), F.when(s % 6 == 3, F.concat(F.lit("record:"), s % 4)).otherwise(F.concat(F.lit("k"), s)).alias("navigation"), (s % 12 == 6).alias("preset"),
    )
    sold = d.table("lineitem").join(d.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    parent, unit = F.concat(F.lit("a"), F.col("l_suppkey")), F.concat(F.lit("b"), F.col("l_suppkey"), F.lit("-"), p % 3)
    kid = sold.where("l_quantity > 30").select(
        tree, unit.alias("unit"), parent.alias("parent"), (p % 3).alias("nth"), F.concat(F.lit("K"), p % 3).alias("name"), F.lit(displays.DISPLAY).alias("basis"), F.lit(True).alias("expandable"),
        F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("https://x/k"), p % 3)).alias("url"), F.lit("").alias("navigation"), F.lit(False).alias("preset"),
    ).distinct()
    own = sold.where("l_quantity < 3").select(tree, parent.alias("unit"), (F.col("l_suppkey") % 3 * 10 + p % 2).alias("source"))
    deep = sold.where("l_quantity > 49").select(tree, unit.alias("unit"), (p % 4 + 100).alias("source"))
    shown = displays.display_tree(top.unionByName(kid), own.unionByName(deep).distinct())
    return shown.select("tree", "unit", "name", "url", "depth", F.array_join(F.col("own").cast("array<string>"), ",").alias("own"))
