"""Queries of packed bodies, JSON, fragments, facts, limits and configured columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.functions import elements as E
from noticeweave.functions import scalars as S
from noticeweave.operators import hierarchy, windows
from noticeweave.operators import pages as P
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query
from noticeweave.tables import written
from noticeweave.sources import files


@query("select page_id, case when page_id % 4 > 0 and page_id % 3 > 0 then md5(html) end body from pages where page_id % 4 > 0 or page_id % 3 = 0", domain=False)
def snapshot_bodies(d: Domain) -> DataFrame:
    i = F.col("page_id")
    pages = d.table("pages").withColumn("site_key", S.site_key(S.host(F.col("url")))).withColumn("hash", F.md5("html"))
    # some snapshots are of other content, some aren't gzip
    stored = pages.where(i % 4 > 0).select("site_key", "url", "hash", F.when(i % 3 > 0, files.zipped(F.col("html"))).otherwise(F.encode(F.lit("no gzip"), "UTF-8")).alias("payload"))
    found = files.snapshot_bodies(pages.select("page_id", "site_key", "url", "hash"), stored).where((i % 4 > 0) | (i % 3 == 0))
    return found.select("page_id", F.md5("body").alias("body"))


@query("select s_suppkey site, s_name \"name\", s_suppkey % 5 pages from supplier", domain=False)
def catalog_reports(d: Domain) -> DataFrame:
    i = F.col("s_suppkey")
    packed = files.zipped(F.to_json(F.struct(F.col("s_name").alias("name"), (i % 5).alias("pages"), F.lit("x").alias("unused"))))
    return files.unpacked_report(d.table("supplier").select(i.alias("site"), packed.alias("z")), "z", "name string, pages bigint")


@query("select s_suppkey site, s_nationkey from supplier where s_nationkey in (3, 4)", domain=False)
def evidence_sites(d: Domain) -> DataFrame:
    rows = d.table("supplier").select(F.col("s_suppkey").alias("site"), "s_nationkey", F.col("s_nationkey").cast("string").alias("site_key"))
    return rows.where(F.col("site_key").isin("3", "4")).select("site", "s_nationkey")


@query("select doc_id, len(b)::int pieces, length(text) = sum_chars whole from (select doc_id, text, list_distinct([1]) b1, length(text) sum_chars, range(0, greatest(1, (strlen(text) + 99) // 100)) b from documents where text is not null and strlen(text) = length(text))", domain=False)
def byte_fragments(d: Domain) -> DataFrame:
    rows = d.table("documents").where("text is not null and octet_length(text) = char_length(text)").select("doc_id", "text", S.byte_pieces(F.col("text"), 100).alias("p"))
    return rows.select("doc_id", F.size("p").alias("pieces"), (F.array_join("p", "") == F.col("text")).alias("whole"))


@query("select doc_id, true whole, true small from documents", domain=False)
def byte_fragments_of_all(d: Domain) -> DataFrame:
    rows = d.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), S.byte_pieces(F.col("text"), 61).alias("p"))
    small = F.forall("p", lambda x: F.octet_length(x) <= 61)
    return rows.select("doc_id", (F.array_join("p", "") == F.col("t")).alias("whole"), small.alias("small"))


@query(
    """select event_id id, case when event_id % 3 = 0 then ['A Office', 'B'] when event_id % 3 = 1 then ['B'] else [] end::varchar sources, 'Law' "name", 'Notices' "column", case when event_id % 2 = 0 then 'Law · Notices' else 'Notices' end "source",
  'Exam plan' title, '/a/b' scope from events""",
    domain=False,
)
def labels(d: Domain) -> DataFrame:
    e = F.col("event_id")
    line = F.when(e % 3 == 0, "来源：A Office 作者：X 来源: B date: 1").when(e % 3 == 1, "Source: B Author: C source: B").otherwise("nothing")
    shown = F.transform(S.provenance(line), lambda x: x)
    return d.table("events").select(
        e.alias("id"), F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("sources"), S.name_without(F.lit(" Law  Office (new)"), (" Office",)).alias("name"), S.column_label(F.lit("· Notices | More >>")).alias("column"),
        S.source_label(F.when(e % 2 == 0, "Law"), F.lit("Notices more")).alias("source"), S.plain_title(F.lit("[NEW] 2024-03-05 Exam plan... ")).alias("title"), S.scope_path(F.when(e % 2 == 0, "/a/b/Index.SHTML").otherwise("/a/b/")).alias("scope"),
    )


@query(
    """select event_id id, user_id % 3 = 0 counted, case when event_id % 2 = 0 then sha256(event_id::varchar) || ',' || sha256('x') else sha256('x') end hashes, (user_id % 4)::int items from events""",
    domain=False,
)
def json_lists(d: Domain) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    keys = F.when(u % 3 == 0, '["total", "directory:2024-01"]').when(u % 3 == 1, '["my-directory:2024-01"]').otherwise("not json")
    x, mine = F.sha2(F.lit("x"), 256), F.sha2(e.cast("string"), 256)
    nested = F.concat(F.lit('{"a": [{"ref": "'), x, F.lit('"}, "'), x, F.lit('"'), F.when(e % 2 == 0, F.concat(F.lit(', {"b": {"c": "'), mine, F.lit('"}}'))).otherwise(""), F.lit(', "'), F.substring(mine, 1, 40), F.lit('"]}'))
    item = F.lit('{"url": "u", "date": "2024-01-01"}')
    several = F.array_join(F.slice(F.array(item, item, item), 1, (u % 4).cast("int")), ",")
    feed = F.when(u % 4 == 0, "{}").when(u % 4 == 1, F.concat(F.lit('{"samples": ['), several, F.lit("]}"))).otherwise(F.concat(F.lit('{"lists": [{"column": "a", "samples": ['), several, F.lit(']}, {"column": "b"}]}')))
    ordered = F.array_join(S.json_hashes(nested), ",")
    both = F.when(e % 2 == 0, F.concat(mine, F.lit(","), x)).otherwise(x)
    same = F.array_sort(F.split(both, ",")) == S.json_hashes(nested)
    return d.table("events").select(e.alias("id"), S.in_json_array(keys, F.lit("directory:2024-01")).alias("counted"), F.when(same, both).otherwise(ordered).alias("hashes"), F.size(S.feed_items(feed)).alias("items"))


_SCHEMA = {
    "type": "object", "required": ["k", "s"],
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "s": {"type": "string", "enum": ["a", "b"], "minLength": 1}, "o": {"type": "object", "required": ["x"], "properties": {"x": {"type": ["number", "null"]}}}},
}


@query(
    """select event_id id, array_to_string(list_filter([case when event_id % 7 = 6 then '$: no JSON' end, case when event_id % 7 not in (1, 3, 4, 5, 6) then '$.s: missing' end, case when event_id % 7 = 2 then '$.k: missing' end,
    case when event_id % 7 = 3 then '$.k: no integer' end, case when event_id % 7 not in (2, 3, 6) and k < 10 then '$.k: minimum' end, case when event_id % 7 not in (2, 3, 6) and k > 90 then '$.k: maximum' end,
    case when event_id % 7 = 4 then '$.s: not listed' end, case when event_id % 7 = 5 then '$.o.x: no number/null' end], lambda x: x is not null), '; ') faults from (select *, json_extract_string(props, '$.k')::bigint k from events)""",
    domain=False,
)
def json_checks(d: Domain) -> DataFrame:
    m, k = F.col("event_id") % 7, F.get_json_object("props", "$.k")
    text = (
        F.when(m == 0, F.concat(F.lit('{"k": '), k, F.lit("}"))).when(m == 1, F.concat(F.lit('{"k": '), k, F.lit(', "s": "a"}'))).when(m == 2, F.lit('{"o": {"x": 1.5}}')).when(m == 3, F.lit('{"k": "9", "s": "b"}'))
        .when(m == 4, F.concat(F.lit('{"k": '), k, F.lit(', "s": "c"}'))).when(m == 5, F.concat(F.lit('{"k": '), k, F.lit(', "s": "b", "o": {"x": "y"}}'))).otherwise("{")
    )
    faults = S.json_faults(F.col("t"), _SCHEMA)
    order = ["$: no JSON", "$.s: missing", "$.k: missing", "$.k: no integer", "$.k: minimum", "$.k: maximum", "$.s: not listed", "$.o.x: no number/null"]
    rows = d.table("events").select(F.col("event_id").alias("id"), text.alias("t")).select("id", faults.alias("f"))
    return rows.select("id", F.array_join(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(F.col("f"), x)), "; ").alias("faults"))


@query("select event_id id, case when event_type = 'view' then 6 when event_type = 'click' then 1 when event_type = 'error' then 1 else 2 end priority from events", domain=False)
def registered_priorities(d: Domain) -> DataFrame:
    S.register_priorities(d.spark, "notice_priority", ((r"^c\w+k$", 1), ("err|admission", 1), ("sign|purch", 2)), 6)
    return d.table("events").select(F.col("event_id").alias("id"), F.expr("notice_priority(event_type)").alias("priority"))


@query(
    """with l as (select l_orderkey s, l_partkey t, l_linenumber i, l_quantity > 10 p from lineitem), k as (select s, t, count(distinct i) filter (p) n from l group by 1, 2)
  select substr(sha256('{"kind":"page","source":' || s || ',"target":' || t || '}'), 1, 24) "key", n::int proofs, case when n = 0 then 'gap' else 'proved' end "state" from k""",
    domain=False,
)
def fact_graph(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select(F.lit("page").alias("kind"), F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("locator"), F.when(F.col("l_quantity") > 10, "now").otherwise("old").alias("hash"))
    material = d.table("orders").select(F.col("o_orderkey").alias("url"), F.lit("now").alias("hash"))
    return hierarchy.facts(rows, rows, material).select("key", "proofs", "state")


@query(
    """with o as (select l_partkey page, min(l_suppkey % 3) g from lineitem where l_linenumber = 1 group by 1 having count(distinct l_suppkey % 3) = 1) select distinct l_orderkey url, l_partkey page, g as "group" from lineitem left join o on o.page = l_partkey""",
    domain=False,
)
def publication_candidates(d: Domain) -> DataFrame:
    feeds = d.table("lineitem").select(F.col("l_orderkey").alias("url"), F.col("l_partkey").alias("page"))
    claims = d.table("lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("page"), (F.col("l_suppkey") % 3).alias("group"))
    return hierarchy.candidates(feeds, claims)


@query("select l_partkey child, min(l_suppkey) parent from lineitem where l_suppkey % 4 < l_partkey % 9 group by 1", domain=False)
def spanning_forest(d: Domain) -> DataFrame:
    edges = d.table("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("parent"), F.concat(F.lit("p"), F.col("l_partkey")).alias("child"))
    depths = d.table("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("url"), (F.col("l_suppkey") % 4).alias("depth")).union(d.table("lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")), F.col("l_partkey") % 9)).distinct()
    numbered = edges.withColumn("parent", F.concat(F.lit("s"), F.lpad(F.substring("parent", 2, 20), 12, "0")))
    padded = depths.withColumn("url", F.when(F.startswith("url", F.lit("s")), F.concat(F.lit("s"), F.lpad(F.substring("url", 2, 20), 12, "0"))).otherwise(F.col("url")))
    return hierarchy.forest(numbered, padded).select(F.substring("child", 2, 20).cast("long").alias("child"), F.substring("parent", 2, 20).cast("long").alias("parent"))


@query(
    """, c as (select *, sum(content_bytes) over () - coalesce(sum(content_bytes) over (order by created_at, id rows between unbounded preceding and 1 preceding), 0) rest from notices where id % 5 > 0)
  select id from c where created_at < timestamp '1995-02-01' or rest > 500000000"""
)
def pruned_evidence(d: Domain) -> DataFrame:
    stale = F.col("created_at") < F.lit(dt.datetime(1995, 2, 1))
    return windows.pruned(d.notices, [F.col("created_at"), F.col("id")], "content_bytes", 500_000_000, stale, F.col("id") % 5 == 0).select("id")


@query(
    """with recursive e as (select user_id k, epoch(ts) t, event_id id, row_number() over (partition by user_id order by ts, event_id) i from events),
  w(k, i, id, began, n) as (select k, i, id, t, 1 from e where i = 1 union all select e.k, e.i, e.id, case when e.t - w.began >= 7200 then e.t else w.began end, case when e.t - w.began >= 7200 then 1 else w.n + 1 end from w join e on e.k = w.k and e.i = w.i + 1)
  select id, n <= 2 allowed from w""",
    domain=False,
)
def limited_events(d: Domain) -> DataFrame:
    rows = d.table("events").select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("id"))
    return windows.limited(rows, "k", "ts", 2, 7200).select("id", "allowed")


def _columns(d: Domain) -> DataFrame:
    """A page for each department: a heading with fields, a table, named lists and nested menus."""
    i = F.col("id")
    title, day = F.concat(F.lit("Notice number "), F.col("n")), F.date_format("at", "yyyy-MM-dd")
    item = F.concat(F.lit('<li><b class="t">'), F.when(F.col("n") % 7 == 0, "").otherwise(title), F.lit('</b><a class="l" href="/n/'), F.when(F.col("n") % 5 == 0, 0).otherwise(F.col("n")), F.lit('">'), title, F.lit('</a><i class="d">'), F.when(F.col("n") % 3 == 0, "soon").otherwise(day), F.lit("</i></li>"))
    rows = d.table("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("n"), F.col("l_shipdate").alias("at")).where("n % 40 = id % 40").distinct()
    lists = rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "at", item.alias("h")))), lambda x: x["h"]), "").alias("items"))
    named = d.departments.select("id", "name").join(lists, "id", "left")
    page = F.concat(
        F.lit("<html><body><ul><li><a href='/u'>Units</a><ul><li><a href='/u/1'>First</a></li><li><a href='/u/2'>Second</a></li></ul></li><li><a href='/h'>Home</a></li></ul><div><h1>"), F.col("name"), F.lit("</h1><span>Author: "), F.col("name"), F.lit("</span><span>views</span><p>Source: no</p></div>"),
        F.lit("<table><tr><th>Unit</th><th>Page</th></tr><tr><td>A"), i, F.lit("</td><td><a href='/a"), i, F.lit("'>go</a></td></tr></table><section><h2>All news</h2><ul class='c'>"), F.coalesce("items", F.lit("")), F.lit("</ul></section></body></html>"),
    )
    return written(E.elements(E.page_texts(named.select("id", page.alias("html")), "id", "html"), "id"))


_CONFIG = {"list": "ul.c li", "title": "b.t", "link": "a.l", "date": "i.d"}
_ROWS = "with r as (select distinct l_suppkey id, l_orderkey n, l_shipdate a from lineitem where l_orderkey % 40 = l_suppkey % 40), p as (select *, case when n % 5 = 0 then 0 else n end h, row_number() over (partition by id order by n, a) nth from r)"


@query(_ROWS + """, q as (select *, count(*) over (partition by id, h) c from p) select id, nth::int nth, '/n/' || h href, case when n % 3 > 0 then a::date end as "day", case when n % 7 = 0 then 'no title' when c > 1 then 'repeated link' when n % 3 = 0 then 'no date' else '' end fault from q""", domain=False)
def extracted_columns(d: Domain) -> DataFrame:
    return P.extracted_columns(_columns(d), "id", _CONFIG).select("id", "nth", "href", "day", "fault")


@query(_ROWS + """, t as (select id, string_agg((case when n % 7 = 0 then '' else 'Notice number ' || n end) || chr(0) || '/n/' || h, chr(1) order by nth) x from p group by 1)
  select id, sha256('date=i.d' || chr(1) || 'link=a.l' || chr(1) || 'list=ul.c li' || chr(1) || 'title=b.t' || chr(1) || x) digest from t""", domain=False)
def column_observations(d: Domain) -> DataFrame:
    return P.observation(P.extracted_columns(_columns(d), "id", _CONFIG), "id", _CONFIG)


@query("select s_suppkey id, 'Unit' as \"header\", 'A' || s_suppkey \"text\", '' href from supplier union all select s_suppkey, 'Page', 'go', '/a' || s_suppkey from supplier", domain=False)
def table_relations(d: Domain) -> DataFrame:
    return P.table_cells(_columns(d), "id").select("id", "header", "text", F.coalesce("href", F.lit("")).alias("href"))


@query("select s_suppkey id, 'Author' \"name\", s_name \"value\" from supplier", domain=False)
def publication_headers(d: Domain) -> DataFrame:
    return P.header_fields(_columns(d), "id")


@query(_ROWS + """, l as (select id from p group by 1 having avg((n % 3 > 0)::int) >= 0.6) select id, 'All news' "column", '/n/' || h href, case when n % 3 > 0 then a::date end as "day" from p join l using (id)""", domain=False)
def publication_lists(d: Domain) -> DataFrame:
    return P.publication_lists(_columns(d), "id").select("id", "column", "href", "day")


@query("select s_suppkey id, l.a as \"label\", l.b href, l.c relation, l.d parent from supplier, (select unnest([{'a': 'Units', 'b': '/u', 'c': 'menu_group', 'd': null}, {'a': 'First', 'b': '/u/1', 'c': 'navigation_entry', 'd': 'Units'}, {'a': 'Second', 'b': '/u/2', 'c': 'navigation_entry', 'd': 'Units'}, {'a': 'Home', 'b': '/h', 'c': 'navigation_entry', 'd': null}]) l)", domain=False)
def menu_structure(d: Domain) -> DataFrame:
    return P.structure(_columns(d), "id").where("href not like '/n/%'").select("id", "label", "href", "relation", "parent")


@query(
    """, x as (select id, author_id k, id % 3 root, created_at, content_bytes sz from notices), r as (select *, row_number() over (partition by root, k order by created_at desc, id desc) nth from x), o as (select *, row_number() over (partition by root order by created_at desc, id desc) i from r),
  f as (with recursive w(root, i, id, kept, lft) as (select root, i, id, nth <= 2 and sz <= 900000000, case when nth <= 2 and sz <= 900000000 then 900000000 - sz else 900000000 end from o where i = 1
    union all select o.root, o.i, o.id, o.nth <= 2 and o.sz <= w.lft, case when o.nth <= 2 and o.sz <= w.lft then w.lft - o.sz else w.lft end from w join o on o.root = w.root and o.i = w.i + 1) select id, kept from w) select id, kept from f"""
)
def retained_generations(d: Domain) -> DataFrame:
    rows = d.notices.select("id", F.col("author_id").alias("k"), (F.col("id") % 3).alias("root"), "created_at", "content_bytes")
    return windows.retained(rows, "root", "k", ["created_at", "id"], "content_bytes", 2, 900_000_000).select("id", "kept")


def _articles(d: Domain) -> tuple[DataFrame, DataFrame]:
    """A page for each order, and its title: with a day beside the heading, in metadata, with several, or without a heading."""
    o, title, day = F.col("o_orderkey"), F.concat(F.lit("Order: "), F.col("o_orderpriority")), F.date_format("o_orderdate", "yyyy-MM-dd")
    meta = F.when(o % 5 == 1, F.concat(F.lit('<meta name="pubdate" content="'), day, F.lit('">'))).otherwise("")
    beside = F.when(o % 5 == 0, F.concat(F.lit("<span>Published: "), day, F.lit("</span><span class=event-date>2001-01-01</span>"))).when(o % 5 == 2, "<i>2001-01-01</i><i>2001-01-02</i>").otherwise("<i>no day</i>")
    heading = F.when(o % 5 == 3, F.lit("<h1>Something else</h1>")).when(o % 5 == 4, F.concat(F.lit("<h2>"), title, F.lit("</h2><h2>"), title, F.lit("</h2>"))).otherwise(F.concat(F.lit("<h1>"), F.lower(title), F.lit("</h1>")))
    page = F.concat(F.lit("<html><head>"), meta, F.lit("</head><body><nav>Menu</nav><div>"), heading, beside, F.lit("<p>"), F.repeat(F.lit("Words. "), 9), F.lit("</p><ul><li>One</li><li>Two</li></ul></div><p>1999-09-09</p></body></html>"))
    rows = d.table("orders").select(o.alias("k"), page.alias("html"), title.alias("title"))
    return written(E.elements(E.page_texts(rows, "k", "html"), "k")), rows.select("k", "title")


@query(
    """select o_orderkey k, case when o_orderkey % 5 in (0, 1) then 'verified' when o_orderkey % 5 = 2 then 'missing_or_conflicting' else 'no_heading' end as "state", case when o_orderkey % 5 in (0, 1) then o_orderdate::date end as "day",
  case o_orderkey % 5 when 0 then 'visible' when 1 then 'meta' end basis from orders""",
    domain=False,
)
def article_dates(d: Domain) -> DataFrame:
    rows, titles = _articles(d)
    return P.article_dates(rows, titles, "k")


@query(
    """select o_orderkey k, case o_orderkey % 5 when 0 then 'Published: ' || strftime(o_orderdate, '%Y-%m-%d') || '2001-01-01' when 2 then '2001-01-012001-01-02' else 'no day' end || rtrim(repeat('Words. ', 9)) || 'OneTwo' body from orders where o_orderkey % 5 < 3""",
    domain=False,
)
def bound_bodies(d: Domain) -> DataFrame:
    rows, titles = _articles(d)
    return P.bound_bodies(rows, titles, "k")


@query(
    """select o_orderkey k, c.chunk, c.path, c.text from orders, (select unnest([{'chunk': 0, 'path': 'html>body>nav', 'text': 'Menu'}, {'chunk': 1, 'path': 'html>body>div>p', 'text': rtrim(repeat('Words. ', 9))}, {'chunk': 2, 'path': 'html>body>div>ul>li', 'text': 'One'},
  {'chunk': 2, 'path': 'html>body>div>ul>li', 'text': 'Two'}, {'chunk': 2, 'path': 'html>body>p', 'text': '1999-09-09'}]) c) where o_orderkey % 5 = 3""",
    domain=False,
)
def page_fragments(d: Domain) -> DataFrame:
    rows, _ = _articles(d)
    found = P.fragments(rows.where("k % 5 = 3"), "k", 60)
    # the heading's own block comes before the paragraph and shares the menu's chunk
    return found.where("text <> 'Something else'").select("k", "chunk", "path", "text")
