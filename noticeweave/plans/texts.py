"""Queries of scalar functions, pages and graphs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.functions import html
from noticeweave.functions import scalars as S
from noticeweave.operators import graphs
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query

_CANONICAL = r"""(select page_id, url, case when not regexp_matches(url, '^https?://[^/?#@]+([/?#]|$)') then '' else
  lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || case when regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) end ||
  coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|fbclid|gclid)(=|$)'))), '&'), ''), '') end c from pages)"""
_EDGES = "with recursive edges as (select l_partkey parent, l_suppkey + 1000000 child from lineitem where l_linenumber = 1 union select l_suppkey + 1000000, l_partkey from lineitem where l_linenumber = 7)"


@query(f"select page_id, c canonical, substr(sha256(c), 1, 20) site_key, case when c <> '' then sha256(c) end url_key from {_CANONICAL}", domain=False)
def page_identity(d: Domain) -> DataFrame:
    rows = d.table("pages").select("page_id", S.canonical_ascii(F.col("url")).alias("canonical"))
    return rows.select("page_id", "canonical", S.site_key(F.col("canonical")).alias("site_key"), S.url_key(F.col("canonical")).alias("url_key"))


@query(f"select page_id, c canonical from {_CANONICAL}", domain=False)
def canonical_urls(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", html.canonical_url("url").alias("canonical"))


@query(r"select page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') host, regexp_extract(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '([^.]+\.[^.]+)$', 1) registrable, regexp_matches(regexp_extract(url, '#(.*)$', 1), '^!?/') route from pages", domain=False)
def hosts(d: Domain) -> DataFrame:
    u = F.col("url")
    return d.table("pages").select("page_id", S.host(u).alias("host"), S.registrable(u).alias("registrable"), S.fragment_route(u).alias("route"))


@query("select doc_id, md5(lang || left(coalesce(text, ''), 500) || '|' || case when source < lang then source || '|' || lang when source = lang then lang else lang || '|' || source end) hash from documents", domain=False)
def content_hashes(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", S.content_hash(F.col("lang"), F.col("text"), F.array("source", "lang", "source")).alias("hash"))


_KEYS = r"select doc_id, replace(lower(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')), 'ß', 'ss') title_key, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([\x{3400}-\x{9fff}])\s+([\x{3400}-\x{9fff}])', '\1\2', 'g') clean from documents"


@query(_KEYS, domain=False)
def title_keys(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", S.title_key(F.col("text")).alias("title_key"), S.clean(F.col("text")).alias("clean"))


@query(_KEYS, domain=False)
def title_keys_whole(d: Domain) -> DataFrame:
    return title_keys(d)


_TITLES = """(select doc_id, case doc_id % 9 when 0 then '关于' || l || '的通知' when 1 then '通知公告' when 2 then '2024-03-0' || doc_id % 10 when 3 then '讲 告' when 4 then left(l, 7) when 5 then 'More' when 6 then '' when 7 then '放假' || left(l, 3) else l end t,
  case when doc_id % 2 = 0 then 'https://a.example/info/12/' || doc_id else 'https://a.example/x' end u from (select doc_id, trim(coalesce(string_split(text, chr(10))[1], '')) l from documents))"""


def _titles(d: Domain) -> DataFrame:
    i, line = F.col("doc_id"), F.trim(F.coalesce(F.split("text", "\n")[0], F.lit("")))
    cases = [F.concat(F.lit("关于"), line, F.lit("的通知")), F.lit("通知公告"), F.concat(F.lit("2024-03-0"), (i % 10).cast("string")), F.lit("讲 告"), F.substring(line, 1, 7), F.lit("More"), F.lit(""), F.concat(F.lit("放假"), F.substring(line, 1, 3))]
    title = line
    for n, c in enumerate(cases):
        title = F.when(i % 9 == n, c).otherwise(title)
    return d.table("documents").select("doc_id", title.alias("t"), F.when(i % 2 == 0, F.concat(F.lit("https://a.example/info/12/"), i.cast("string"))).otherwise("https://a.example/x").alias("u"))


@query(
    rf"""select doc_id, t = '' or length(t) < 4 and not (regexp_matches(replace(t, ' ', ''), '^[\x{{3400}}-\x{{9fff}}]{{2,3}}$') and u like '%/info/%') or lower(t) in ('more', '通知公告') or regexp_matches(t, '^20\d\d-\d\d-\d\d$')
  or length(t) <= 8 and not regexp_matches(t, '关于|通知|公告|公示|通报|名单|结果|决定|办法|意见|召开|举行|开展|做好|申报|推荐|评选|征集|报名|放假') and not (u like '%/info/%') junk,
  (case when length(t) between 8 and 80 then 10 else 0 end + 2 * length(regexp_replace(t, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) + case when regexp_matches(t, '关于|通知|公告|公示|通报|决定|意见|办法') then 6 else 0 end)::bigint score from {_TITLES}""",
    domain=False,
)
def title_quality(d: Domain) -> DataFrame:
    return _titles(d).select("doc_id", S.junk_title(F.col("t"), F.col("u")).alias("junk"), S.title_score(F.col("t")).cast("long").alias("score"))


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_MARKED = "regexp_replace(regexp_replace({0}, '(?i)(licen)', '<mark>\\1</mark>', 'g'), '(?i)(\\.)', '<mark>\\1</mark>', 'g')"


@query(
    f"""with t as (select doc_id, trim(coalesce(text, '')) x from documents), p as (select *, instr(lower(x), 'licen') a, instr(lower(x), '.') b from t),
  q as (select *, case when a > 0 and (b = 0 or a <= b) then a else b end p, case when a > 0 and (b = 0 or a <= b) then 5 else 1 end n from p),
  r as (select *, greatest(0, p - 41) s, least(length(x), p - 1 + n + 80) e from q), v as (select doc_id, p, case when s > 0 then '…' else '' end || substr(x, s + 1, e - s) || case when e < length(x) then '…' else '' end seg from r)
  select doc_id, case when p > 0 then {_MARKED.format(_ESCAPED.format("seg"))} else '' end snippet from v""",
    domain=False,
)
def snippets(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", S.snippet(F.col("text"), "LICEN .").alias("snippet"))


_WHOLE = f"select doc_id, regexp_replace(regexp_replace({_ESCAPED.format("coalesce(text, '')")}, '(?i)(the)', '<mark>\\1</mark>', 'g'), '(?i)(%)', '<mark>\\1</mark>', 'g') html from documents"


@query(_WHOLE, domain=False)
def highlights(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", S.highlight(F.col("text"), "the %").alias("html"))


@query(f"select doc_id, regexp_replace({_ESCAPED.format("coalesce(text, '')")}, '(?i)(the)', '<mark>\\1</mark>', 'g') html from documents", domain=False)
def highlights_whole(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", S.highlight(F.col("text"), "the").alias("html"))


@query(
    """with t as (select doc_id, trim(coalesce(text, '')) x from documents), p as (select *, instr(lower(x), 'and') a, instr(lower(x), 'der') b from t), q as (select *, case when a = 0 then b when b = 0 then a else least(a, b) end p from p),
  r as (select *, greatest(0, p - 29) s from q) select doc_id, case when p > 0 then case when s > 0 then '…' else '' end || substr(x, s + 1, least(length(x), s + 160) - s) || case when s + 160 < length(x) then '…' else '' end else '' end excerpt from r""",
    domain=False,
)
def suggestion_excerpts(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", S.excerpt_of([F.lit(None).cast("string"), F.col("text")], "AND der").alias("excerpt"))


@query(
    r"""with recursive p as (select doc_id, unnest(list_transform(list_filter(string_split(regexp_replace(coalesce(text, ''), '\r?\n', chr(10), 'g'), chr(10)), lambda x: trim(x) <> ''), lambda x: x)) x,
    generate_subscripts(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''), 1) g from documents),
  c as (select doc_id, g, k, trim(substr(x, k * 8000 + 1, 8000)) y from (select doc_id, g, x, unnest(range(0, (length(x) - 1) // 8000 + 1)) k from p)), n as (select doc_id, length(y) sz, row_number() over (partition by doc_id order by g, k) i from c where y <> ''),
  w(doc_id, i, chunk, held) as (select doc_id, 1::bigint, 0, sz from n where i = 1 union all select n.doc_id, n.i, case when w.held + n.sz > 8000 then w.chunk + 1 else w.chunk end, case when w.held + n.sz > 8000 then n.sz else w.held + n.sz end from w join n on n.doc_id = w.doc_id and n.i = w.i + 1)
  select doc_id, max(i)::int pieces, max(chunk) + 1 chunks from w group by 1""",
    domain=False,
)
def packed_paragraphs(d: Domain) -> DataFrame:
    rows = d.table("documents").select("doc_id", S.paragraphs(F.col("text")).alias("p")).where(F.size("p") > 0)
    return rows.select("doc_id", F.size("p").alias("pieces"), (F.array_max(S.packed(F.col("p"))) + 1).alias("chunks"))


_ADDRESS = "'https://' || ['www.a.edu.cn', 'b.example.com', '10.1.2.3', 'localhost', 'x.local', 'user@c.example', 'd.example:8443', 'e.example:443', '172.20.1.1', '8.8.8.8'][o_orderkey % 10 + 1]"


def _addresses(d: Domain) -> DataFrame:
    hosts = F.array(*map(F.lit, ("www.a.edu.cn", "b.example.com", "10.1.2.3", "localhost", "x.local", "user@c.example", "d.example:8443", "e.example:443", "172.20.1.1", "8.8.8.8")))
    return d.table("orders").select("o_orderkey", F.concat(F.lit("https://"), F.element_at(hosts, (F.col("o_orderkey") % 10 + 1).cast("int"))).alias("base"))


@query("select o_orderkey, o_orderkey % 10 in (0, 1, 7, 9) and o_orderkey % 3 > 0 public, o_orderkey % 10 = 0 and o_orderkey % 3 > 0 same_school from orders", domain=False)
def public_addresses(d: Domain) -> DataFrame:
    tail = F.when(F.col("o_orderkey") % 3 == 0, "/a b").otherwise("/x?y=1")
    rows = _addresses(d).select("o_orderkey", F.concat("base", tail).alias("u"))
    return rows.select("o_orderkey", S.public_url(F.col("u")).alias("public"), (S.same_school(F.col("u"), F.lit("http://law.a.edu.cn/")) & (F.col("o_orderkey") % 3 > 0)).alias("same_school"))


@query("select o_orderkey, o_orderkey % 4 in (0, 1) and o_orderkey % 3 = 0 sign_in, o_orderkey % 5 in (0, 1, 2) article, o_orderkey % 5 = 4 file from orders", domain=False)
def address_kinds(d: Domain) -> DataFrame:
    o = F.col("o_orderkey")
    route = F.concat(F.lit("https://a.example"), F.when(o % 4 == 0, "/cas/login.jsp").when(o % 4 == 1, "/x/oauth2/").when(o % 4 == 2, "/news/relogins.html").otherwise("/list.htm"), F.when(o % 3 == 0, "?service=https://b.example/").when(o % 3 == 1, "?service=3").otherwise(""))
    item = F.concat(F.lit("https://a.example"), F.when(o % 5 == 0, "/info/12/345.htm").when(o % 5 == 1, "/c1a23/page.htm").when(o % 5 == 2, "/2024/0301/").when(o % 5 == 3, "/info/12/").otherwise("/files/a.PDF?x=1"))
    return d.table("orders").select("o_orderkey", S.sign_in_route(route).alias("sign_in"), S.article_address(item).alias("article"), S.file_address(item, F.lit("label")).alias("file"))


@query(
    """select o_orderkey, case o_orderkey % 11 when 0 then 'https://a.example/n/index_' || k || '.shtml' when 1 then 'https://a.example/n/index_' || k || '.htm' when 2 then 'https://a.example/n/list_x/index_' || k || '.jsp'
   when 3 then 'https://a.example/n/index' || (k - 1) || '.htm' when 4 then 'https://a.example/n/?a=1&page=' || k when 5 then 'https://a.example/n/?page=' || (k - 1) when 6 then 'https://a.example/n/list' || k || '.htm'
   when 7 then 'https://a.example/n/page/' || k when 8 then 'https://a.example/n/' || k || '.htm' when 9 then 'https://a.example/n/index_' || k || '.htm' end url from (select o_orderkey, o_orderkey % 6 + 2 k from orders)""",
    domain=False,
)
def page_addresses(d: Domain) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("o_orderkey") % 6 + 2
    cases = [
        ("https://a.example/n/", "default"), ("https://a.example/n/index.htm", "index_htm"), ("https://a.example/n/list_x/first.jsp", "index_html"), ("https://a.example/n/index.htm", "index_htm_offset"),
        ("https://a.example/n/?a=1&page=9", "query_page"), ("https://a.example/n/", "query_page_zero"), ("https://a.example/n/list.htm", "list_htm"), ("https://a.example/n/page/3/", "page_path"),
        ("https://a.example/n/first.htm", "default_htm"), ("https://a.example/n/index_4.htm", "catalog"),
    ]
    url = F.lit(None).cast("string")
    for i, (base, style) in enumerate(cases):
        url = F.when(o % 11 == i, S.page_address(F.lit(base), style, k)).otherwise(url)
    return d.table("orders").select("o_orderkey", url.alias("url"))


@query(
    """select s_suppkey, sha256('["' || s_name || '","","x"]') history, sha256('["' || s_name || '","",""]') signature, substr(sha256('unit' || chr(0) || s_name || chr(0) || '//u.example/' || s_suppkey), 1, 24) unit_key,
  substr(sha256('channel' || chr(0) || s_name || chr(0) || 'http://u.example/' || s_suppkey), 1, 24) channel_key, sha256('["' || s_name || '","b"]') input, ('0x' || substr(sha256(s_name), 1, 8))::bigint % 60 jitter,
  sha256('a#' || chr(10) || 'b') shape from supplier""",
    domain=False,
)
def digests(d: Domain) -> DataFrame:
    n, i = F.col("s_name"), F.col("s_suppkey").cast("string")
    url = lambda s: F.concat(F.lit(f"{s}://u.example/"), i)
    return d.table("supplier").select(
        "s_suppkey", S.history_digest(n, F.lit(""), F.lit("x")).alias("history"), S.source_signature(n, F.lit(None).cast("string"), F.lit("")).alias("signature"),
        F.when(F.col("s_suppkey") % 2 == 0, S.node_key(F.lit("unit"), n, url("http"))).otherwise(S.node_key(F.lit("unit"), n, url("https"))).alias("unit_key"), S.node_key(F.lit("channel"), n, url("http")).alias("channel_key"),
        S.input_hash(n, F.lit("b")).alias("input"), S.jitter(n, 60).alias("jitter"), S.shape_digest(F.array(F.concat(F.lit("a"), i), F.lit("b"), F.lit("a7"))).alias("shape"),
    )


_RULES = (("directory", 60, "directory|院系"), ("unit", 80, "college|school|学院"), ("channel", 40, "news|notice|通知"), ("navigation", 30, "about|contact"))


@query(
    """select id, case when length(t) <= 60 and regexp_matches(t, 'directory') then 'directory' when length(t) <= 80 and regexp_matches(t, 'college|school') then 'unit' when length(t) <= 40 and regexp_matches(t, 'news|notice') then 'channel'
  when length(t) <= 30 and regexp_matches(t, 'about') then 'navigation' end kind, case when regexp_matches(t, 'school') then 2 when regexp_matches(t, 'news') then 5 else 6 end as rank
  from (select event_id id, ['directory of all', 'the college', 'news', 'about us', 'notice that is quite a bit longer than forty characters', 'school news', 'other'][event_id % 7 + 1] t from events)""",
    domain=False,
)
def label_kinds(d: Domain) -> DataFrame:
    labels = F.array(*map(F.lit, ("* directory of all ·", "the college", "news", "about us", "notice that is quite a bit longer than forty characters", "school news", "other")))
    t = F.element_at(labels, (F.col("event_id") % 7 + 1).cast("int"))
    return d.table("events").select(F.col("event_id").alias("id"), S.classified(t, _RULES).alias("kind"), S.ranked_label(t, (("school", 2), ("news", 5)), 6).alias("rank"))


@query("select event_id id, case event_id % 5 when 0 then 'Law College' when 1 then 'Law College' when 2 then '' when 3 then '' else 'Office' end name, 'ab12' bare from events", domain=False)
def title_identities(d: Domain) -> DataFrame:
    e = F.col("event_id")
    t = F.when(e % 5 == 0, "Notices | Law College - Home").when(e % 5 == 1, "Law College _ Some University").when(e % 5 == 2, "A - B - C").when(e % 5 == 3, "关于放假").otherwise("Office")
    return d.table("events").select(e.alias("id"), S.title_identity(t, F.lit("Notices"), F.lit("Some University")).alias("name"), S.bare(F.lit("a-b: 1·2.")).alias("bare"))


@query("select doc_id, i::bigint i, substr(text, i * 1600 + 1, 1800) piece from (select doc_id, text, unnest(range(0, greatest(0, length(text) - 1) // 1600 + 1)) i from documents)", domain=False)
def text_windows(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", F.posexplode(S.windows_of(F.col("text"))).alias("i", "piece")).withColumn("i", F.col("i").cast("long"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') stamp, (ts + interval 480 minute)::date \"day\", json_extract_string(props, '$.k')::bigint k, case when ts::date <= date '2024-01-15' then ts end shown from events", domain=False)
def event_stamps(d: Domain) -> DataFrame:
    at = F.col("ts")
    return d.table("events").select(
        "event_id", S.utc_stamp(at).alias("stamp"), S.local_day(at, 480).alias("day"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        S.not_future(at, dt.datetime(2024, 1, 15)).alias("shown"),
    )


@query("select o_orderkey, o_orderdate::date found from orders", domain=False)
def dates_in_urls(d: Domain) -> DataFrame:
    url = F.concat(F.lit("https://a.example/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/x.html"))
    return d.table("orders").select("o_orderkey", S.url_date(url).alias("found"))


@query("select o_orderkey, least(4, greatest(1, o_orderkey % 7)) step, case least(4, greatest(1, o_orderkey % 7)) when 1 then 60 when 2 then 300 when 3 then 1800 else 7200 end::bigint delay from orders", domain=False)
def retry_delays(d: Domain) -> DataFrame:
    failures = (F.col("o_orderkey") % 7).cast("int")
    return d.table("orders").select("o_orderkey", F.least(F.lit(4), F.greatest(F.lit(1), F.col("o_orderkey") % 7)).alias("step"), S.backoff(failures).alias("delay"))


def _edges(d: Domain) -> DataFrame:
    rows = d.table("lineitem")
    there = rows.where("l_linenumber = 1").select(F.col("l_partkey").alias("parent"), (F.col("l_suppkey") + 1_000_000).alias("child"))
    back = rows.where("l_linenumber = 7").select((F.col("l_suppkey") + 1_000_000).alias("parent"), F.col("l_partkey").alias("child"))
    return there.union(back).distinct()


_REACHED = _EDGES + """, r(node, hops) using key (node) as (select 1::bigint, 0 union select e.child, min(r.hops) + 1 from r join edges e on e.parent = r.node
  left join recurring.r k on k.node = e.child where k.node is null group by e.child) select node, hops::int hops from r"""


@query(_REACHED, domain=False)
def reachable(d: Domain) -> DataFrame:
    return graphs.descendants(_edges(d), d.spark.createDataFrame([(1,)], "node long"))


@query(_REACHED, domain=False)
def reachable_all(d: Domain) -> DataFrame:
    return graphs.descendants(_edges(d), d.spark.createDataFrame([(1,)], "node long"))


@query(_EDGES + " select node, sum(o)::bigint n_out, sum(i)::bigint n_in from (select parent node, 1 o, 0 i from edges union all select child, 0, 1 from edges) group by 1", domain=False)
def edge_degrees(d: Domain) -> DataFrame:
    return graphs.degrees(_edges(d))


@query(_EDGES + " select child, min(parent) parent from edges group by 1 having count(*) = 1", domain=False)
def unambiguous_parents(d: Domain) -> DataFrame:
    return graphs.only_parents(_edges(d))
