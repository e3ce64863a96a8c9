"""Queries of pages: landed ones, and lists and articles made from the tables, whose contents SQL has without any parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.functions import elements as E
from noticeweave.functions import html
from noticeweave.operators import pages as P
from noticeweave.operators import ranking
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query
from noticeweave.tables import written

# The strings of a page's part, each without outer white space, one after the other.
_DECODED = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_PLAIN = "array_to_string(list_transform(string_split(regexp_replace({0}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda s: trim(" + _DECODED.format("s") + ", ' ' || chr(10) || chr(9) || chr(13))), '')"
_ARTICLE = "regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"


def _landed(d: Domain) -> DataFrame:
    return written(E.elements(E.page_texts(d.table("pages"), "page_id", "html"), "page_id"))


@query("select page_id, len(regexp_extract_all(html, '<[a-zA-Z]'))::bigint elements, len(regexp_extract_all(html, '<a '))::bigint links, len(regexp_extract_all(html, '<p>'))::bigint paragraphs from pages", domain=False)
def page_elements(d: Domain) -> DataFrame:
    return _landed(d).groupBy("page_id").agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "p").alias("paragraphs"))


@query(
    f"""with t as (select page_id, {_PLAIN.format(_ARTICLE)} x from pages) select page_id, 'semantic_match' "method", md5(x) hash, length(x)::int chars, (50 + 15 + case when length(x) > 2000 then 10 when length(x) > 500 then 5 else 0 end - case when (length(x) - length(replace(x, ' ', ''))) * 5 > length(x) then 10 else 0 end)::bigint confidence
  from t where length(x) >= 100""",
    domain=False,
)
def article_contents(d: Domain) -> DataFrame:
    found = P.article_content(_landed(d), "page_id").where("method = 'semantic_match'")
    return found.select("page_id", "method", F.md5("text").alias("hash"), F.char_length("text").alias("chars"), "confidence")


@query(
    f"""with h as (select page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) x, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) t, html from pages)
  select page_id, trim({_DECODED.format("t")}) title, trim({_DECODED.format("x")}) heading, len(regexp_extract_all(html, '<li><a href='))::bigint nav from h""",
    domain=False,
)
def page_headings(d: Domain) -> DataFrame:
    rows = _landed(d)
    first = rows.groupBy("page_id").agg(F.min_by(F.when(F.col("tag") == "title", F.col("text")), F.when(F.col("tag") == "title", F.col("node"))).alias("title"), F.min_by(F.when(F.col("tag") == "h1", F.col("text")), F.when(F.col("tag") == "h1", F.col("node"))).alias("heading"))
    nav = P.select_nodes(rows, "page_id", "nav ul li a").groupBy("page_id").agg(F.count(F.lit(1)).alias("nav"))
    return first.join(nav, "page_id", "left").select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("nav", F.lit(0)).alias("nav"))


@query(
    f"""with n as (select page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) l from pages)
  select page_id, {_DECODED.format("href")} href, trim({_DECODED.format("l")}) as "label", 1::bigint as "level" from n where page_id in (select page_id from n group by 1 having count(*) >= 4)""",
    domain=False,
)
def navigation_links(d: Domain) -> DataFrame:
    return P.navigation(_landed(d), "page_id").select("page_id", "href", "label", "level")


@query(
    """select page_id, row_number() over (partition by page_id order by i)::int - 1 place, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href url, l as "label", true nav from (
    select page_id, url, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*"'), 1) i, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) l from pages)""",
    domain=False,
)
def page_links(d: Domain) -> DataFrame:
    links = d.table("pages").select("page_id", F.posexplode(html.page_links("url", "html")).alias("place", "l"))
    return links.select("page_id", "place", "l.url", "l.label", "l.nav")


@query(
    f"""with t as (select page_id, {_PLAIN.format("regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<nav>.*</nav>|<footer>.*</footer>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')")} x from pages)
  select page_id, sum(length(x))::bigint >= 0 has_text, md5(regexp_replace(x, '\\s', '', 'g')) body_hash from t group by page_id, x""",
    domain=False,
)
def articles(d: Domain) -> DataFrame:
    rows = d.table("pages").select("page_id", html.page_text("html").alias("a"))
    return rows.select("page_id", F.lit(True).alias("has_text"), F.md5(F.regexp_replace("a.body", r"\s", "")).alias("body_hash"))


def _lists(d: Domain) -> DataFrame:
    """A page for each author: navigation, their notices with dates, and a pager."""
    item = F.concat(F.lit('<li class="it"><a href="/n/'), F.col("id"), F.lit('.htm">Notice about '), F.col("title"), F.lit("</a><span>"), F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("unknown day")), F.lit("</span></li>"))
    rows = d.notices.groupBy(F.col("author_id").alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", item.alias("h")))), lambda x: x["h"]), "").alias("items"), F.count(F.lit(1)).alias("n"))
    pager = F.concat(F.lit('<div class="pages">'), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit('<a href="index_'), i, F.lit('.htm">'), i, F.lit("</a>"))), " "), F.lit('<a href="index_2.htm" rel="next">Next</a></div>'))
    files = F.concat(F.lit('<p><img src="/i/'), F.col("k"), F.lit('.png" alt="Plan"><a href="/files/a.pdf?x=1">Form <b>A</b></a><a href="/files/a.pdf?x=1">again</a><a href="/about">About</a></p>'))
    page = F.concat(F.lit('<html><body><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav><div id="main"><ul class="list">'), F.col("items"), F.lit("</ul>"), pager, files, F.lit("</div><footer>Foot</footer></body></html>"))
    return written(E.elements(E.page_texts(rows.select("k", page.alias("html")), "k", "html"), "k"))


_ITEMS = ", i as (select author_id k, id, 'Notice about ' || title t, coalesce(strftime(published_at, '%Y-%m-%d'), 'unknown day') dy, published_at is not null dated from notices)"


@query(
    _ITEMS + """, g as (select k, count(*) n, avg(length(t) + length(dy)) a, avg(dated::int::double) r from i group by 1 having count(*) >= 3)
  select k, n::bigint "count", floor(n * least(a, 200.0) * (1 + 1.5 * r) * (1 + 1.0) * (0.5 + 0.5 * 1.0) + 1e-6)::bigint score from g"""
)
def repeating_blocks(d: Domain) -> DataFrame:
    rows = _lists(d)
    blocks = P.repeating_blocks(rows, "k").join(P.select_nodes(rows, "k", "ul.list").select("k", F.col("node").alias("parent")), ["k", "parent"], "left_semi")
    return blocks.select("k", "count", F.floor(F.col("score") + 1e-6).alias("score"))


@query(_ITEMS + ' select k, count(*)::bigint "count" from i group by 1 having count(*) >= 5 and avg(dated::int) >= 0.3')
def notice_lists(d: Domain) -> DataFrame:
    rows = _lists(d)
    return P.notice_lists(P.repeating_blocks(rows, "k"), rows, "k").select("k", "count")


@query(_ITEMS + """, p as (select *, row_number() over (partition by k order by id) nth from i) select k, nth::int nth, t title, '/n/' || id || '.htm' href, case when dated then dy::date end as "date", case when dated then '' else 'no date' end warning from p where nth <= 10""")
def tested_selectors(d: Domain) -> DataFrame:
    return P.test_selectors(_lists(d), "k", "ul.list li.it")


@query(_ITEMS + """, p as (select *, row_number() over (partition by k order by id) place from i where dated) select k, place::int place, '/n/' || id || '.htm' href, t title, dy::date as "date" from p where place <= 150""")
def static_notices(d: Domain) -> DataFrame:
    return P.static_notices(_lists(d), "k")


@query(_ITEMS + """ select k, case when count(*) > 1 then 'index_htm' end "style", count(*)::int as most, 'index_2.htm' href from i group by 1 having count(*) > 1""")
def pagers(d: Domain) -> DataFrame:
    rows = _lists(d)
    return P.pager(rows, "k").join(P.next_page(rows, "k"), "k").select("k", "style", "most", "href")


@query(_ITEMS + """ select distinct k, '/i/' || k || '.png' address, 'image' kind, 'Plan' "name" from i union all select distinct k, '/files/a.pdf?x=1', 'attachment', 'FormA' from i""")
def page_resources(d: Domain) -> DataFrame:
    return P.resources(_lists(d), "k").select("k", "address", "kind", "name")


@query(_ITEMS + """, s as (select k, sum(length(t)) covered, sum(length(dy)) rest, sum(length(id::varchar)) z, count(*) n from i group by 1), c as (select k, 8 + covered + 4 + 5 + 5 + 5 + 4 + (select sum(length(x::varchar)) from range(1, n + 1) t(x)) cov, rest from s)
  select k, cov * 10 >= (cov + rest) * 9 "only" from c""")
def menu_pages(d: Domain) -> DataFrame:
    return P.only_navigation(_lists(d), "k")


_WORDS = "['tzgg', 'notice', 'tongzhi', 'gonggao', 'announcement', 'news', 'xwdt', 'xwzx', 'info', 'article', 'list', 'xinwen', 'tongzhigonggao', 'ggl', 'tzg', 'xytz']"
_LINKED = """with l as (select l_orderkey k, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey node, case l_partkey % 8 when 0 then '/tzgg/' when 1 then '/News/' || l_suppkey || '/index.htm' when 2 then '/info/' || l_partkey + 10000 || '.htm' when 3 then '/about.htm' when 4 then '/list/art_' || l_suppkey when 5 then '#news' when 6 then '/x/' || repeat('y', l_linenumber::int) else '/notice2' end href,
  case l_suppkey % 4 when 0 then 'All News' when 1 then 'Notice list' when 2 then 'home' else '通知公告' end t from lineitem),"""


@query(
    _LINKED + f""" s as (select *, list_sum(list_transform({_WORDS}, lambda w: 3 * contains(lower(href), w)::int + 2 * contains(lower(t), w)::int)) p, regexp_matches(lower(href), 'index|/$|/(tzgg|notice|news)[0-9]*/*$') ix from l),
  z as (select *, round(p + 5 * ix::int - length(href) * 0.02 - 3 * (not ix and regexp_matches(lower(href), '/[0-9]{{4,}}|content_[0-9]+|art_[0-9]+'))::int, 1) sc from s where p > 0 and not starts_with(href, '#')),
  o as (select * from z qualify row_number() over (partition by k, href order by sc desc, node) = 1) select k, href, round(sc * 10)::bigint score from o qualify row_number() over (partition by k order by sc desc, node) <= 3""",
    domain=False,
)
def list_links(d: Domain) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    href = F.when(p % 8 == 0, "/tzgg/").when(p % 8 == 1, F.concat(F.lit("/News/"), s, F.lit("/index.htm"))).when(p % 8 == 2, F.concat(F.lit("/info/"), p + 10000, F.lit(".htm"))).when(p % 8 == 3, "/about.htm")
    href = href.when(p % 8 == 4, F.concat(F.lit("/list/art_"), s)).when(p % 8 == 5, "#news").when(p % 8 == 6, F.concat(F.lit("/x/"), F.repeat(F.lit("y"), n.cast("int")))).otherwise("/notice2")
    label = F.when(s % 4 == 0, "All News").when(s % 4 == 1, "Notice list").when(s % 4 == 2, "home").otherwise("通知公告")
    links = d.table("lineitem").select(F.col("l_orderkey").alias("k"), (n * F.lit(1_000_000_000_000) + p * 100_000 + s).alias("node"), href.alias("href"), label.alias("label"))
    return ranking.notice_links(links, "k", 3).select("k", "href", "score")


@query(
    """select page_id, case when page_id % 11 = 0 then 'network_error' when page_id % 11 in (1, 2) then 'denied' when page_id % 11 = 3 then 'network_error' when page_id % 11 = 4 then 'empty' when page_id % 11 = 5 then 'requires_render' when page_id % 11 = 6 then 'empty' else 'usable' end kind from pages""",
    domain=False,
)
def content_kinds(d: Domain) -> DataFrame:
    m = F.col("page_id") % 11
    status = F.when(m == 1, 403).when(m == 2, 429).when(m == 3, 502).when(m == 4, 404).when(m > 4, 200)
    words = F.when(m == 5, 0).when(m == 6, 3).otherwise(50)
    pages = d.table("pages")
    return pages.select("page_id", P.content_class(pages, status, words).alias("kind"))


@query(
    """select o_orderkey, '<p style="padding:1px">Hi <b>' || o_orderpriority || '</b></p><a href="/x" rel="noopener noreferrer" target="_blank">go</a><a rel="noopener noreferrer" target="_blank">bad</a><img alt="A &quot;b&quot;" src="i.png">&lt;3 &amp; more' html from orders""",
    domain=False,
)
def sanitised_pages(d: Domain) -> DataFrame:
    page = F.concat(
        F.lit('<script>alert(1)</script><p onclick="x()" style="padding:1px;position:fixed">Hi <b>'), F.col("o_orderpriority"), F.lit('</p><form><input>secret</form><a href="/x">go</a><a href="java\tscript:x()">bad</a><img src="i.png" alt=\'A "b"\' onerror="x"><unknown>&lt;3 &amp; more</unknown>'),
    )
    return d.table("orders").select("o_orderkey", E.sanitised(page).alias("html"))
