"""Queries of inbox arguments, subscriptions, filters and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.functions import scalars as S
from noticeweave.operators import joins, placements, ranking, scope
from noticeweave.plans.domain import Domain
from noticeweave.plans.inbox import AS_OF, _MEMBERS, _PAIRS, _members
from noticeweave.plans.registry import query
from noticeweave.sources import files

_TREE = ", tree as (select id // 4 parent, id child from departments where id >= 4)"
_BELOW = _TREE + """, recursive_pairs as (
  with recursive r(root, node) as (select parent, child from tree union select r.root, t.child from r join tree t on t.parent = r.node) select * from r)"""


def tree(d: Domain) -> DataFrame:
    """A directory of departments: four children each."""
    return d.departments.where("id >= 4").select(F.floor(F.col("id") / 4).alias("parent"), F.col("id").alias("child"))


def _picked(d: Domain) -> DataFrame:
    """Subscriptions of three kinds: all of a school, nothing, and one department of it."""
    u = d.subscriptions.select("user_id", "school_id")
    third = F.col("user_id") % 3
    dep = d.departments.select((F.col("id") % 10).alias("slot"), F.col("id").alias("department_id"), F.col("school_id").alias("dep_school")).where("department_id <= 10")
    rows = u.join(dep, F.col("user_id") % 10 == F.col("slot"), "left")
    return rows.select(
        "user_id", F.when(third == 2, F.coalesce("dep_school", "school_id")).otherwise(F.col("school_id")).alias("school_id"),
        F.when(third == 0, F.lit(None).cast("array<bigint>")).when(third == 1, F.array().cast("array<bigint>")).otherwise(F.array("department_id")).alias("department_ids"),
    )


@query(
    _BELOW
    + """, dep as (select id % 10 slot, id department_id, school_id dep_school from departments where id <= 10),
  sub as (select s.user_id, case when s.user_id % 3 = 2 then coalesce(dep_school, s.school_id) else s.school_id end school_id, s.user_id % 3 k, department_id
    from subscriptions s left join dep on slot = s.user_id % 10)
  select distinct user_id, d.id department_id from sub join departments d on d.school_id = sub.school_id
  where k = 0 or k = 2 and (d.id = sub.department_id or exists (select 1 from recursive_pairs p where p.root = sub.department_id and p.node = d.id))"""
)
def subscribed_departments(d: Domain) -> DataFrame:
    return scope.expanded_subscriptions(_picked(d), d.departments, tree(d))


def _filtered(d: Domain, args: dict[str, str], chosen: list[int] | None = None) -> DataFrame:
    return scope.filtered_inbox(args, AS_OF, d.notices, _members(d), d.departments, d.schools, d.subscriptions, d.states, d.reads, chosen=chosen).select("user_id", "notice_id")


@query(_PAIRS + " select p.user_id, p.notice_id from pairs p join notices n on n.id = p.notice_id where coalesce(n.published_at, n.created_at) >= timestamp '1998-07-26 00:00:00'")
def inbox_by_default(d: Domain) -> DataFrame:
    return _filtered(d, {"view": "unknown", "period": "never"})


@query(
    _MEMBERS + """ select distinct s.user_id, s.notice_id from states s join notices n on n.id = s.notice_id join members m on m.notice_id = n.id
  join departments d on d.id = m.department_id where s.starred and d.school_id = 3 and coalesce(nullif(trim(d.group_name), ''), 'default') = 'news'"""
)
def saved_in_group(d: Domain) -> DataFrame:
    return _filtered(d, {"view": "saved", "school": "3", "group": "news"})


@query(
    _PAIRS + """ select p.user_id, p.notice_id from pairs p join notices n on n.id = p.notice_id join reads r using (user_id, notice_id)
  where year(coalesce(n.published_at, n.created_at)) = 1996 and contains(lower(n.title), 'high')
  and exists (select 1 from members m join departments d on d.id = m.department_id join schools s on s.id = d.school_id and s.enabled where m.notice_id = n.id and d.id between 1 and 59)"""
)
def read_in_archive(d: Domain) -> DataFrame:
    return _filtered(d, {"view": "focus", "mailbox": "inbox", "period": "archive", "year": "1996", "month": "0", "q": " HIGH ", "read": "read"}, list(range(1, 60)))


@query(" select user_id, notice_id from states where not starred and trashed_at >= timestamp '1998-07-03 00:00:00' and notice_id in (select id from notices)")
def trash_box(d: Domain) -> DataFrame:
    return _filtered(d, {"view": "focus", "mailbox": "trash"})


@query(" select id from notices where contains(lower(title), 'medium')")
def title_search(d: Domain) -> DataFrame:
    return d.notices.where(scope.title_has(" MEDIUM ")).select("id")


@query(" select id, name from schools where contains(lower(replace(name, '_', '')), 'nation1') or contains(lower(name), '_13') or contains(lower(name), 'nation') and province = 3")
def school_search(d: Domain) -> DataFrame:
    rows = d.schools.withColumn("url", F.concat(F.lit("https://"), F.col("name")))
    found = scope.in_directory(rows, " Nation-1 ").union(scope.in_directory(rows, "_13")).union(scope.in_directory(rows, "NATION", 3))
    return found.select("id", "name").distinct()


@query(" select id from departments where id % 7 = 3 and contains(list_url, '-00000')")
def channel_search(d: Domain) -> DataFrame:
    wide = F.when(F.col("id") % 7 == 3, F.lit("ＮＥＷＳ ﬁrst")).otherwise(F.lit("other"))
    return scope.channels_with(d.departments.withColumn("crumb", wide), "news FIRST ＃-00000".replace("＃", "").strip(), ["crumb", "list_url"]).select("id")


@query(" select id from departments where id not in (select department_id from (select l_suppkey department_id, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) f from lineitem group by 1) where f = 'R')")
def active_sources(d: Domain) -> DataFrame:
    life = d.table("lineitem").select(F.col("l_suppkey").alias("department_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"), F.when(F.col("l_returnflag") == "R", "retired").otherwise("active").alias("state"))
    return scope.active_sources(d.departments, life).select("id")


@query(" select id from schools where enabled and id in (select school_id from subscriptions where segment = 'BUILDING')")
def active_schools(d: Domain) -> DataFrame:
    return scope.active_schools(d.schools, d.subscriptions.where("segment = 'BUILDING'")).select("id")


@query(_TREE + " select id from departments where id % 5 <> 0 and id % 3 <> 1 and id not in (select parent from tree)")
def collected_sources(d: Domain) -> DataFrame:
    rows = d.departments.withColumns({"kind": F.when(F.col("id") % 3 == 1, "unit").otherwise("column"), "list_url": F.when(F.col("id") % 5 > 0, F.col("list_url"))})
    return scope.collected_sources(rows, tree(d)).select("id")


@query(
    """ select omitted, count(*)::bigint n from (select case when not (h = 'example.com' or h like '%.example.com') then 'outside' when page_id % 5 = 0 then 'unread' when page_id % 7 = 0 then 'content' else '' end omitted
  from (select page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') h from pages)) group by 1"""
)
def graph_omissions(d: Domain) -> DataFrame:
    pages = d.table("pages").select("url", S.host(F.col("url")).alias("host"), F.when(F.col("page_id") % 7 == 0, "article").otherwise("menu").alias("kind"), F.when(F.col("page_id") % 5 == 0, "failed").otherwise("fetched").alias("state"))
    return scope.graph_scope(pages, "example.com").groupBy("omitted").agg(F.count(F.lit(1)).alias("n"))


@query(" select l.l_orderkey parent, count(*)::bigint n from lineitem l join orders o on o.o_orderkey = l.l_orderkey and o.o_orderstatus = 'F' where l.l_returnflag = case when o.o_custkey % 2 = 0 then 'R' else 'A' end group by 1")
def fresh_edges(d: Domain) -> DataFrame:
    pages = d.table("orders").select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "F", "fetched").otherwise("pending").alias("state"), F.when(F.col("o_custkey") % 2 == 0, "R").otherwise("A").alias("hash"))
    edges = d.table("lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_returnflag").alias("content_hash"))
    return joins.fresh_edges(edges, pages).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


@query(" select a.id a, b.id b from departments a join departments b on a.id % 50 = b.id % 50 and b.id % 2 = 1 where a.id % 2 = 1")
def same_pages(d: Domain) -> DataFrame:
    n = F.col("id")
    odd = d.departments.where("id % 2 = 1")
    left = odd.select(F.concat(F.lit("http://Host.example/p"), n % 50, F.lit("/")).alias("base"), n).select(F.concat("base", F.lit("?n=1")).alias("url"), "id")
    right = odd.select(F.concat(F.lit("https://host.example/p"), n % 50, F.lit("?n=1")).alias("url"), "id")
    pairs = joins.same_pages(left.select("url").distinct(), right.select("url").distinct(), S.same_page_key(F.col("url")))
    return pairs.join(left.select(F.col("url").alias("a"), F.col("id").alias("x")), "a").join(right.select(F.col("url").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


@query(
    """, k as (select p_partkey id, nullif(p_size, 1) kk, p_brand a from part), bk as (select kk, min(id) i, count(*) n from k where kk is not null group by 1), ba as (select a, min(id) i, count(*) n from k group by 1),
  r as (select o_orderkey row, case when o_orderkey % 3 = 0 then o_orderkey % 60 end kk, case when o_orderkey % 2 = 0 then 'Brand#' || (o_orderkey % 70) end a from orders)
  select row, case when bk.n = 1 then 'key' when bk.n > 1 then 'conflict' when ba.n = 1 then 'alias' when ba.n > 1 then 'conflict' else 'new' end how,
    case when bk.n = 1 then bk.i when bk.n is null and ba.n = 1 then ba.i end id from r left join bk using (kk) left join ba using (a)"""
)
def alias_identities(d: Domain) -> DataFrame:
    known = d.table("part").select(F.col("p_partkey").alias("id"), F.nullif(F.col("p_size"), F.lit(1)).alias("kk"), F.col("p_brand").alias("a"))
    o = F.col("o_orderkey")
    rows = d.table("orders").select(o.alias("row"), F.when(o % 3 == 0, o % 60).cast("int").alias("kk"), F.when(o % 2 == 0, F.concat(F.lit("Brand#"), o % 70)).alias("a"))
    return joins.by_identity(rows, known, "kk", "a").select("row", "how", "id")


@query(" select l_orderkey relation, bool_and(l_quantity > 5) valid, count(*) filter (l_quantity <= 5)::bigint gaps from lineitem group by 1")
def witnessed_relations(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select(F.col("l_orderkey").alias("relation"), F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("locator"), F.concat_ws("/", "l_partkey", "l_quantity").alias("hash"), "l_quantity")
    return joins.witnessed(rows.drop("l_quantity"), rows.where("l_quantity > 5"), "relation")


@query(
    """, sc as (select distinct p_size registry_key from part), k as (select id % 40 registry_key, count(*) n, min(id) i, bool_and(id % 4 <> 0) ready from departments group by 1)
  select registry_key, case when n is null then 'not_registered' when n > 1 then 'identity_conflict' when ready then 'ready' else 'pending' end state, case when n = 1 then i end school_id
  from sc left join k using (registry_key)"""
)
def registry_acceptance(d: Domain) -> DataFrame:
    wanted = d.table("part").select(F.col("p_size").alias("registry_key")).distinct()
    schools = d.departments.select((F.col("id") % 40).cast("int").alias("registry_key"), "id", (F.col("id") % 4 != 0).alias("ready"))
    return joins.acceptance(wanted, schools, "registry_key")


@query(
    """ select n.id, d.name source from notices n join departments d on d.id = n.department_id where n.published_at is not null and n.published_at >= timestamp '1996-06-01' and n.id % 3 <> 0
  and (contains(lower(n.title), 'urgent') or contains(lower(d.name), 'urgent')) and (contains(lower(n.title), '000') or contains(lower(d.name), '000'))"""
)
def mobile_inbox(d: Domain) -> DataFrame:
    rows = d.notices.select("id", F.col("department_id").alias("source_id"), "title", (F.col("id") % 3 == 0).alias("is_read"), F.lit(False).alias("is_starred"), F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("")).alias("day"))
    return joins.mobile_rows(rows, d.departments, unread=True, since="1996-06-01", query="urgent 000").select("id", "source")


@query(
    """, l as (select l_orderkey list, 'P' || (l_partkey % 20) item, o_orderpriority name from lineitem join orders on o_orderkey = l_orderkey), f as (select name, min(list) g from l group by 1),
  i as (select distinct list, item from l), p as (select distinct l.list, f.g from l join f using (name))
  select p.list, p.g as "group" from p join i a on a.list = p.list join i b on b.list = p.g and b.item = a.item group by 1, 2 having count(*) >= 2"""
)
def same_lists(d: Domain) -> DataFrame:
    rows = d.table("lineitem").join(d.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    scheme = F.when(F.col("l_orderkey") % 2 == 0, "http:").otherwise("https:")
    samples = rows.select(F.col("l_orderkey").alias("list"), F.concat(scheme, F.lit("//a.example/P"), F.col("l_partkey") % 20).alias("url"))
    lists = rows.select(F.col("l_orderkey").alias("list"), F.col("o_orderpriority").alias("name"), F.lit("t").alias("title")).distinct()
    return joins.same_lists(samples, lists)


@query(" select 'edge' kind, l_orderkey url, count(*)::bigint n from lineitem join orders on o_orderkey = l_orderkey and o_orderstatus = l_linestatus group by 2 union all select 'node', l_orderkey, count(*)::bigint from lineitem join orders on o_orderkey = l_orderkey and o_orderstatus = l_linestatus where l_linenumber > 3 group by 2")
def monitored_pages(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_orderkey").alias("reference"), F.col("l_linestatus").alias("hash"), "l_linenumber")
    pages = d.table("orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("hash"))
    return joins.monitored(rows, rows.where("l_linenumber > 3"), pages)


@query(" select w.id, o_orderpriority, o.o_orderkey is not null found from (select distinct l_partkey id from lineitem) w left join orders o on o.o_orderkey = w.id")
def page_metadata(d: Domain) -> DataFrame:
    wanted = d.table("lineitem").select(F.col("l_partkey").alias("id"))
    return joins.looked_up(wanted, d.table("orders").withColumnRenamed("o_orderkey", "id"), "id", ["o_orderpriority"])


@query("select n_nationkey::bigint id, n_name name, null::bigint size from nation union all select p_partkey, null, p_size::bigint from part union all select s_suppkey, s_name, null from supplier", domain=False)
def tolerant_import(d: Domain) -> DataFrame:
    tables = [
        d.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey"), d.table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("size")),
        d.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("many").alias("size")),
    ]
    return files.tolerant_union(tables, {"id": "bigint", "name": "string", "size": "bigint"})


@query("select 'id is no bigint' fault, count(*) filter (p_partkey % 7 = 0)::bigint n from part union all select 'too many rows', (count(*) - 10)::bigint from part", domain=False)
def import_faults(d: Domain) -> DataFrame:
    rows = d.table("part").select(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.col("p_partkey"), F.lit("x"))).otherwise(F.col("p_partkey").cast("string")).alias("id"))
    return files.valid_import(rows, "id", 10, {"id": "bigint"})


@query(
    """ select n.id, n.owner_id from (select p.p_partkey id, p.p_name as name, (select case when count(*) filter (length(o.name) = m) = 1 then min(o.id) filter (length(o.name) = m) end from
    (select *, max(length(name)) over () m from (select p_size * 1000 + length(p_brand) id, split_part(p.p_name, ' ', 1) || repeat('x', 0) name, p_partkey from part q where q.p_partkey = p.p_partkey
      union select p_size * 1000 + 1, left(p.p_name, 3), p_partkey from part q where q.p_partkey = p.p_partkey) o where starts_with(p.p_name, o.name || ' ')) o) owner_id from part p) n""",
    domain=False,
)
def longest_owners(d: Domain) -> DataFrame:
    part = d.table("part").withColumn("key", F.col("p_partkey"))
    owners = part.select("key", (F.col("p_size") * 1000 + F.length("p_brand")).alias("id"), F.split("p_name", " ")[0].alias("name")).union(part.select("key", (F.col("p_size") * 1000 + 1).alias("id"), F.substring("p_name", 1, 3).alias("name")))
    return placements.longest_owner(part.select("key", F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), owners, "key", " ").select("id", F.col("owner_id"))


@query(" select a.id inner_id, b.id outer_id from departments a join departments b on a.school_id = b.school_id and (a.id = b.id or a.id % 3 = 0 and b.id % 3 = 1)")
def path_containment(d: Domain) -> DataFrame:
    place = F.when(F.col("id") % 3 == 0, "/a/b/c").when(F.col("id") % 3 == 1, "/a/b/").otherwise(F.concat(F.lit("/x"), F.col("id")))
    rows = d.departments.select("id", "school_id", F.when(F.col("id") % 3 == 0, F.concat(place, F.lit("/"), F.col("id"))).otherwise(place).alias("path"))
    # several rows have the path /a/b/: each is within itself only
    pairs = placements.contained(rows, rows, "school_id").join(rows.select(F.col("id").alias("inner_id"), F.col("path").alias("p")), "inner_id").join(rows.select(F.col("id").alias("outer_id"), F.col("path").alias("q")), "outer_id")
    return pairs.where((F.col("inner_id") == F.col("outer_id")) | (F.col("p") != F.col("q"))).select("inner_id", "outer_id")


@query("select page_id::bigint a, page_id + 1000 b from pages where page_id % 3 = 0 union all select page_id + 1000, page_id from pages where page_id % 3 = 0", domain=False)
def redirect_aliases(d: Domain) -> DataFrame:
    p = F.col("page_id")
    return joins.alias_edges(d.table("pages").select(p.alias("url"), F.when(p % 3 == 0, p + 1000).otherwise(p).alias("final")), "url", "final")


@query(" select id, published_at from (select * from notices order by published_at desc nulls last, created_at desc, id limit 50 offset 100)")
def search_page(d: Domain) -> DataFrame:
    return ranking.search_page(d.notices, 3).select("id", "published_at")


@query(" select id, place::int place, true has_more from (select id, row_number() over (order by published_at desc nulls last, created_at desc, id) place from notices where contains(lower(title), 'low')) where place <= 8")
def search_suggestions(d: Domain) -> DataFrame:
    return ranking.suggestions(d.notices.where(scope.title_has("low"))).select("id", "place", "has_more")


@query(" select id from (select id, row_number() over (order by name, id) p, count(*) over () n from departments) where (p - 1) // 30 = (n - 1) // 30")
def last_page(d: Domain) -> DataFrame:
    return ranking.clamped_page(d.departments, [F.col("name"), F.col("id")], 10**6).select("id")

