"""Lists, articles, navigation and pagers of pages, as operations on the table of elements (functions/elements.py).

Every operator reads rows of key, node, parent, place, depth, last (descendant), tag, classes, ident, href, attrs, begin, end and text: a table that is
written once, of which each reads the columns that it needs. An element's descendants are the nodes after it up to last, so that no tree is walked;
what lies in what comes from running values in document order (nesting.py), never from comparing elements of a page with each other. All grouping is by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeweave.functions import dates
from noticeweave.operators import nesting

# Containers of lists, parts of pages that aren't content, selectors of articles in order, titles that are navigation, and words of pages' frames.
CONTAINERS = ("ul", "ol", "div", "section", "article", "tbody", "table", "dl", "main", "body")
NOISE = ("nav", "footer", "header", "aside")
NOISE_WORDS = ("sidebar", "comment", "share", "related-post", "recommend", "breadcrumb", "toolbar", "page-nav")
LIST_NOISE = ("footer", "sidebar", "comment", "share", "related")
ARTICLES = ("article", "[role=main]", "main", ".article-content", ".article", ".content", ".main", ".post-content", ".entry-content", ".detail")
NAVIGATION_WORDS = ("首页", "下一页", "上一页", "末页", "登录", "注册", "更多", "返回", "English", "中文", "网站地图")
FOOTING_WORDS = ("首页", "末页", "登录", "注册", "版权所有")
FILES = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|txt|csv)$"


def matches(selector: str) -> Column:
    """Whether an element is what one simple selector names: tag, .class, #id or [attribute=value], and tag before any of these."""
    tag, rest = selector, ""
    for i, c in enumerate(selector):
        if c in ".#[":
            tag, rest = selector[:i], selector[i:]
            break
    found = F.col("tag") == tag if tag else F.lit(True)
    if rest.startswith("."):
        for name in rest[1:].split("."):
            found = found & F.array_contains("classes", name)
    elif rest.startswith("#"):
        found = found & (F.col("ident") == rest[1:])
    elif rest.startswith("["):
        name, value = rest[1:-1].split("=", 1)
        found = found & F.coalesce(F.element_at("attrs", F.lit(name)) == value.strip("'\""), F.lit(False))
    return found


def select_nodes(rows: DataFrame, key: str, selector: str) -> DataFrame:
    """Elements that a selector (parts with spaces between: descendants) names, in order."""
    first, *inner = selector.split()
    found = rows.withColumn("__hit", matches(first))
    for part in inner:
        found = found.withColumn("__in", nesting.covered(key, F.col("__hit"))).withColumn("__hit", matches(part) & F.col("__in"))
    return found.where("__hit").drop("__hit", "__in")


def _words_in(words: tuple[str, ...]) -> Column:
    named = F.lower(F.concat_ws(" ", "ident", "classes"))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(named, F.lit(w))
    return found


def without(rows: DataFrame, key: str, condition: Column) -> DataFrame:
    """rows without the elements that meet a condition and all that is in them."""
    return rows.withColumn("__gone", nesting.covered(key, condition, own=True)).where("not __gone").drop("__gone")


def signatures(rows: DataFrame, key: str) -> DataFrame:
    """rows with signature: tag, sorted classes and the tags of the children in order."""
    inner = rows.groupBy(key, F.col("parent").alias("node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "tag"))), lambda c: c["tag"]).alias("child_tags"))
    joined = rows.join(inner, [key, "node"], "left")
    return joined.withColumn("signature", F.concat_ws("|", "tag", F.array_join("classes", "."), F.coalesce(F.array_join("child_tags", ","), F.lit(""))))


def links_of(rows: DataFrame, key: str, owners: DataFrame) -> DataFrame:
    """owner and the links (a with href) in each of owners (key, node, last), the owner itself included: as many rows as links have owners around them."""
    links = _links(rows, key)
    held = nesting.enclosing(owners.select(key, "node", "last"), links, key)
    return links.join(held, [key, "node"])


def _links(rows: DataFrame, key: str) -> DataFrame:
    return rows.where("tag = 'a' and href <> ''").select(key, "node", "href", F.col("text").alias("label"))


def _first_links(rows: DataFrame, key: str, owners: DataFrame) -> DataFrame:
    """key, node of owners that hold a link, and a: label and href of the first."""
    return nesting.first_inside(owners, _links(rows, key), key, F.struct("label", "href")).withColumnRenamed("found", "a")


def repeating_blocks(rows: DataFrame, key: str, least: int = 3, least_text: int = 8) -> DataFrame:
    """Runs of siblings with one signature: key, parent, first, count, avg_text, date_ratio, link_ratio, unique_links, score.

    score is count * min(avg_text, 200) * (1 + 1.5 date_ratio) * (1 + link_ratio) * (0.5 + 0.5 unique_links).
    """
    held = rows.where(F.col("tag").isin(*CONTAINERS) & ~_words_in(LIST_NOISE)).select(key, F.col("node").alias("parent"))
    long = signatures(rows, key).where((F.char_length("text") >= least_text)).join(held, [key, "parent"], "left_semi")
    along = W.partitionBy(key, "parent").orderBy("place")
    new = ~F.col("signature").eqNullSafe(F.lag("signature").over(along))
    marked = long.withColumn("run", F.sum(new.cast("int")).over(along))
    sized = marked.withColumn("count", F.count(F.lit(1)).over(W.partitionBy(key, "parent", "run"))).where(F.col("count") >= least)
    linked = links_of(rows, key, sized).where(~F.col("href").rlike("^(#|javascript:)")).groupBy(key, F.col("owner").alias("node")).agg(F.collect_list("href").alias("links"))
    items = sized.join(linked, [key, "node"], "left")
    dated = dates.has_date(F.col("text"))
    runs = items.groupBy(key, "parent", "run", "signature").agg(
        F.min("node").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("count"), F.avg(F.char_length("text")).alias("avg_text"), F.avg(dated.cast("double")).alias("date_ratio"),
        F.avg(F.col("links").isNotNull().cast("double")).alias("link_ratio"), F.flatten(F.collect_list("links")).alias("all"),
    )
    share = F.when(F.size("all") > 0, F.size(F.array_distinct("all")) / F.size("all")).otherwise(0.0)
    first_of_kind = F.row_number().over(W.partitionBy(key, "parent", "signature").orderBy("first"))
    runs = runs.withColumn("unique_links", share).withColumn("nth", first_of_kind).where("nth = 1")
    score = F.col("count") * F.least("avg_text", F.lit(200.0)) * (1 + 1.5 * F.col("date_ratio")) * (1 + F.col("link_ratio")) * (0.5 + 0.5 * F.col("unique_links"))
    return runs.select(key, "parent", "first", "last", "count", "avg_text", "date_ratio", "link_ratio", "unique_links", "signature", score.alias("score"))


def notice_lists(blocks: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The blocks that may list notices: five items, half with links, three tenths with dates, different links, three titles that aren't navigation."""
    good = blocks.where("count >= 5 and link_ratio >= 0.5 and date_ratio >= 0.3 and unique_links >= 0.5")
    items = good.select(key, "parent", F.col("first").alias("b_first"), F.col("last").alias("b_last"))
    mine = rows.join(items, [key, "parent"]).where(F.col("node").between(F.col("b_first"), F.col("b_last")))
    five = mine.withColumn("nth", F.row_number().over(W.partitionBy(key, "parent", "b_first").orderBy("node"))).where("nth <= 5")
    titles = _first_links(rows, key, five).select(key, "node", F.col("a.label").alias("label"))
    nav = F.lit(False)
    for w in NAVIGATION_WORDS:
        nav = nav | F.contains("label", F.lit(w))
    named = five.join(titles, [key, "node"]).where((F.char_length("label") >= 4) & ~nav).groupBy(key, "parent").agg(F.count(F.lit(1)).alias("titles"))
    return good.join(named.where("titles >= 3"), [key, "parent"])


def test_selectors(rows: DataFrame, key: str, list_selector: str, most: int = 10) -> DataFrame:
    """For each item (up to most a page) its first link's label and address, its date, and a warning for what is missing."""
    found = select_nodes(rows, key, list_selector)
    items = found.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("node"))).where(F.col("nth") <= most)
    joined = items.join(_first_links(rows, key, items), [key, "node"], "left")
    date = dates.first_date(F.col("text"))
    warning = F.when(F.col("a").isNull(), "no link").when(F.col("a.label") == "", "no title").when(date.isNull(), "no date").otherwise("")
    return joined.select(key, "nth", F.coalesce("a.label", "text").alias("title"), F.coalesce("a.href", F.lit("")).alias("href"), date.alias("date"), warning.alias("warning"))


def _measured(rows: DataFrame, key: str) -> DataFrame:
    """rows with tags (descendants) and link_chars (of links that are in an element)."""
    chars = F.when(F.col("tag") == "a", F.char_length("text"))
    return nesting.sums_inside(rows, key, link_chars=chars).withColumn("tags", F.col("last") - F.col("node"))


def main_content(rows: DataFrame, key: str) -> DataFrame:
    """The densest article-like element of each page (key, node, method, chars, density), or else the densest container with few links."""
    kept = without(rows, key, F.col("tag").isin(*NOISE) | _words_in(NOISE_WORDS))
    measured = _measured(kept, key).withColumn("chars", F.char_length("text")).where("tags > 0").withColumn("density", F.col("chars") / F.col("tags"))
    article = F.lit(False)
    for s in ARTICLES:
        article = article | matches(s)
    semantic = measured.where(article & (F.col("chars") >= 100)).withColumn("rank", F.lit(1))
    dense = measured.where(F.col("tag").isin("div", "section", "article") & (F.col("chars") >= 200) & (F.col("link_chars") <= 0.5 * F.col("chars"))).withColumn("rank", F.lit(0))
    best = semantic.unionByName(dense).withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("rank"), F.desc("density"), "node"))).where("place = 1")
    return best.select(key, "node", F.when(F.col("rank") == 1, "semantic_match").otherwise("text_density").alias("method"), "chars", "density")


def article_content(rows: DataFrame, key: str, selector: str | None = None) -> DataFrame:
    """key, method, text and confidence of each page's article: a configured selector, article-like elements in order of ARTICLES with
    100 characters, the densest container with 200, or the body.

    confidence in hundredths is 10 and 30 for under 50 and 100 characters, else 50 and up to 20 for the method and 10 for the length, less 20 for more
    than three words of pages' frames and 10 for very many spaces.
    """
    tries = []
    if selector:
        for i, s in enumerate(selector.split(",")):
            tries.append(select_nodes(rows, key, s.strip()).select(key, "node", "last", F.lit(i).alias("rank"), F.lit("configured_selector").alias("method")))
    # the first element of each selector, all in one pass
    named = rows.select(key, "node", "last", F.char_length("text").alias("chars"), F.explode(F.array_compact(F.array(*(F.when(matches(s), 100 + i) for i, s in enumerate(ARTICLES))))).alias("rank"))
    first = named.groupBy(key, "rank").agg(F.min(F.struct("node", "last", "chars")).alias("e")).where("e.chars >= 100")
    tries.append(first.select(key, "e.node", "e.last", "rank", F.lit("semantic_match").alias("method")))
    dense = main_content(rows, key).where("chars >= 200").select(key, "node").join(rows.select(key, "node", "last"), [key, "node"])
    tries.append(dense.select(key, "node", "last", F.lit(200).alias("rank"), F.lit("text_density").alias("method")))
    tries.append(rows.where("tag = 'body'").select(key, "node", "last", F.lit(300).alias("rank"), F.lit("body_fallback").alias("method")))
    every = tries[0]
    for t in tries[1:]:
        every = every.unionByName(t)
    chosen = every.groupBy(key).agg(F.min(F.struct("rank", "node", "last", "method")).alias("c")).select(key, "c.node", "c.last", "c.method")
    # the article's stretch of the page's text without those of navigation inside it
    around = chosen.select(F.col(key).alias("c_key"), F.col("node").alias("c_node"), F.col("last").alias("c_last"))
    inner = rows.where(F.col("tag").isin("nav", "footer", "header")).join(around, (F.col(key) == F.col("c_key")) & (F.col("node") > F.col("c_node")) & (F.col("node") <= F.col("c_last")))
    gone = inner.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("gone"))
    whole = rows.select(key, "node", F.col("text").alias("whole"), F.col("begin").alias("zero"))
    joined = chosen.join(whole, [key, "node"]).join(gone, key, "left")
    text = F.aggregate(
        F.coalesce("gone", F.array().cast("array<struct<begin:int,end:int>>")),
        F.struct(F.lit("").alias("out"), F.col("zero").alias("at")),
        lambda s, g: F.struct(
            F.concat(s["out"], F.substring(F.col("whole"), s["at"] - F.col("zero") + 1, F.greatest(F.lit(0), g["begin"] - s["at"]))).alias("out"), F.greatest(s["at"], g["end"]).alias("at")
        ),
        lambda s: F.concat(s["out"], F.substring(F.col("whole"), s["at"] - F.col("zero") + 1, F.char_length("whole"))),
    )
    made = joined.select(key, "method", text.alias("text"))
    n = F.char_length("text")
    bonus = F.when(F.col("method") == "configured_selector", 20).when(F.col("method") == "semantic_match", 15).when(F.col("method") == "text_density", 10).otherwise(0)
    length = F.when(n > 2000, 10).when(n > 500, 5).otherwise(0)
    spaces = n - F.char_length(F.replace("text", F.lit(" ")))
    framing = sum(((n - F.char_length(F.replace("text", F.lit(w)))) / len(w) for w in FOOTING_WORDS), F.lit(0))
    percent = F.when(n == 0, 0).when(n < 50, 10).when(n < 100, 30).otherwise(50 + bonus + length - F.when(framing > 3, 20).otherwise(0) - F.when(spaces * 5 > n, 10).otherwise(0))
    return made.withColumn("confidence", percent.cast("long"))


def navigation(rows: DataFrame, key: str, least: int = 4) -> DataFrame:
    """Links of each page's navigation: key, node, label, href, level and parent (the link of the item around it)."""
    areas = rows.where(matches("nav") | matches("[role=navigation]") | matches(".nav") | matches(".menu"))
    inside = links_of(rows, key, areas)
    area = inside.groupBy(key, "owner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).groupBy(key).agg(F.max(F.struct("n", -F.col("owner"))).alias("m"))
    mine = inside.join(area.select(key, (-F.col("m.col2")).alias("owner")), [key, "owner"]).drop("owner")
    held = nesting.nearest(rows.where("tag = 'li'"), mine, key).withColumnRenamed("owner", "item")
    return mine.join(held, [key, "node"]).select(key, "node", "label", "href", "level", "item")


def pager(rows: DataFrame, key: str) -> DataFrame:
    """Pagers: key, style, most (page) and links of pages whose links have numbers, with the way that addresses count."""
    named = rows.where(_words_in(("page", "pagin", "pager", "fenye")))
    numbered = links_of(rows, key, named).where(F.col("label").rlike("^[0-9]+$")).select(key, "owner", F.col("label").cast("int").alias("number"), "href")
    sets = numbered.groupBy(key, "owner").agg(F.sort_array(F.collect_set(F.struct("number", "href"))).alias("links")).where(F.size("links") >= 2)
    first = sets.groupBy(key).agg(F.min_by("links", "owner").alias("links"))
    sample = F.col("links")[1]["href"]
    style = (
        F.when(sample.rlike(r"(^|/)index_\d+\.s?html?$"), "index_htm").when(sample.rlike(r"(^|/)index\d+\.htm$"), "index_htm_offset").when(sample.rlike(r"(^|/)page/\d+/?$"), "default")
        .when(sample.rlike(r"(^|/)list_\d+\.htm"), "index_htm").when(sample.rlike(r"(^|/)\d+\.htm$"), "default_htm").when(sample.rlike(r"[?&][^=&]+=\d+(&|$)"), "query_page")
    )
    return first.select(key, style.alias("style"), F.array_max(F.col("links.number")).alias("most"), F.slice(F.col("links.href"), 1, 3).alias("samples")).where("style is not null")


def next_page(rows: DataFrame, key: str) -> DataFrame:
    """key and href of the first link that says next, by its label or its rel."""
    says = F.lower(F.regexp_replace("text", r"\s+", "")).isin("next", "nextpage", "next>", "下一页", "下页") | (F.lower(F.coalesce(F.element_at("attrs", F.lit("rel")), F.lit(""))) == "next")
    found = rows.where((F.col("tag").isin("a", "link")) & (F.col("href") != "") & says)
    return found.groupBy(key).agg(F.min_by("href", "node").alias("href"))


def resources(rows: DataFrame, key: str) -> DataFrame:
    """Images and attachments, each address once: key, address, kind, name."""
    src = F.coalesce(F.element_at("attrs", F.lit("src")), F.lit(""))
    image = F.col("tag") == "img"
    address = F.when(image, src).otherwise(F.col("href"))
    file = F.regexp_extract(address, r"^[^?#]*", 0).rlike(FILES) | F.array_contains(F.map_keys("attrs"), "download") | F.col("text").rlike("(?i)attachment|download|附件|下载") | address.rlike(r"(?i)/(download|attach|attachment)(/|\.|\?|$)")
    found = rows.where((image & (src != "")) | (F.col("tag") == "a") & (F.col("href") != "") & file)
    label = F.when(image, F.coalesce(F.element_at("attrs", F.lit("alt")), F.lit(""))).otherwise(F.col("text"))
    name = F.coalesce(F.nullif(label, F.lit("")), F.nullif(F.regexp_extract(address, r"([^/?#]*)([?#].*)?$", 1), F.lit("")))
    rowed = found.select(key, "node", address.alias("address"), F.when(image, "image").otherwise("attachment").alias("kind"), name.alias("name"))
    return rowed.groupBy(key, "address").agg(F.min_by(F.struct("kind", "name"), "node").alias("r")).select(key, "address", "r.*")


def only_navigation(rows: DataFrame, key: str) -> DataFrame:
    """key and flag: whether all but a tenth of a page's shown text is in links or navigation."""
    body = rows.where("tag = 'body'").groupBy(key).agg(F.min_by(F.struct("begin", "end"), "node").alias("b"))
    nav = rows.where(F.col("tag").isin("a", *NOISE)).select(key, "node", "last", "begin", "end")
    outer = W.partitionBy(key).orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    tops = nav.withColumn("before", F.coalesce(F.max("last").over(outer), F.lit(-1))).where(F.col("node") > F.col("before")).groupBy(key).agg(F.sum(F.col("end") - F.col("begin")).alias("covered"))
    whole = F.col("b.end") - F.col("b.begin")
    return body.join(tops, key, "left").select(key, (F.coalesce("covered", F.lit(0)) * 10 >= whole * 9).alias("only"))


def static_notices(rows: DataFrame, key: str, most: int = 150) -> DataFrame:
    """Links with titles of 8 to 350 characters and the date nearest to them: in the link itself or in up to three elements around that hold no other link."""
    kept = without(rows, key, F.col("tag").isin("nav", "header", "footer"))
    links = kept.where("tag = 'a' and href <> ''").select(key, F.col("node").alias("link"), F.col("depth").alias("l_depth"), "href", F.col("text").alias("title"))
    links = links.where(F.char_length("title").between(8, 350))
    near = None
    at = links.withColumn("node", F.col("link"))
    for _ in range(4):  # the link and three elements around it, by their parents
        here = at.join(kept.select(key, "node", "parent", "last", "depth", "text"), [key, "node"])
        near = here if near is None else near.unionByName(here)
        at = here.select(*links.columns, F.col("parent").alias("node"))
    others = links_of(kept, key, near.select(key, "node", "last").distinct()).groupBy(key, F.col("owner").alias("node")).agg(F.min("href").alias("h1"), F.max("href").alias("h2")).where("h1 = h2")
    regions = near.join(others, [key, "node"]).where(F.char_length("text") <= 700).withColumn("date", dates.first_date(F.col("text")))
    best = regions.where("date is not null").groupBy(key, "link", "href", "title").agg(F.max_by("date", "depth").alias("date"))
    once = best.groupBy(key, "href").agg(F.min_by(F.struct("link", "title", "date"), "link").alias("n"))
    placed = once.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("n.link"))).where(F.col("place") <= most)
    return placed.select(key, "place", "href", "n.title", "n.date")


def content_class(texts: DataFrame, status: Column, words: Column) -> Column:
    """How a fetched page can be used, by the first rule that holds; words is the number of its words."""
    return (
        F.when(status.isNull(), "network_error").when(status.isin(401, 403), "denied").when(status == 429, "denied").when(status >= 500, "network_error").when(status >= 400, "empty")
        .when(words == 0, "requires_render").when(words < 5, "empty").otherwise("usable")
    )


def _inside(rows: DataFrame, key: str, items: DataFrame, selector: str) -> DataFrame:
    """key, node of items and found: text and href of the first element in it that a selector names."""
    return nesting.first_inside(items, select_nodes(rows, key, selector), key, F.struct("text", "href"))


def extracted_columns(rows: DataFrame, key: str, config: dict[str, str]) -> DataFrame:
    """Each item of a configured list (list, title, link, date selectors): nth, title, href, date and fault: no title, no link, no date or repeated link."""
    found = select_nodes(rows, key, config["list"])
    items = found.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("node")))
    out = items.select(key, "node", "nth")
    for name in ("title", "link", "date"):
        part = _inside(rows, key, items, config[name]).withColumnRenamed("found", name)
        out = out.join(part, [key, "node"], "left")
    date = dates.first_date(F.col("date.text"))
    again = F.count(F.lit(1)).over(W.partitionBy(key, "link.href")) > 1
    fault = F.when(F.coalesce("title.text", F.lit("")) == "", "no title").when(F.coalesce("link.href", F.lit("")) == "", "no link").when(again, "repeated link").when(date.isNull(), "no date").otherwise("")
    return out.select(key, "nth", "title.text", "link.href", date.alias("day"), fault.alias("fault"))


def observation(columns: DataFrame, key: str, config: dict[str, str]) -> DataFrame:
    """key and a digest of what a configuration selects on a page: its selectors and the items in order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("nth", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("href", F.lit("")).alias("h")))), lambda i: F.concat_ws("\u0000", i["t"], i["h"]))
    told = "\u0001".join(f"{k}={v}" for k, v in sorted(config.items()))
    return columns.groupBy(key).agg(F.sha2(F.concat_ws("\u0001", F.lit(told), F.array_join(items, "\u0001")), 256).alias("digest"))


def table_cells(rows: DataFrame, key: str) -> DataFrame:
    """row, header, text and href of each cell below a table's header row: relations of tables are read from these."""
    cells = rows.where(F.col("tag").isin("td", "th")).select(key, "node", "parent", "place", "last", "tag", "text")
    placed = nesting.nearest(rows.where("tag = 'table'"), rows.where("tag = 'tr'"), key).where("level > 0").select(key, F.col("node").alias("parent"), F.col("owner").alias("table"))
    joined = cells.join(placed, [key, "parent"])
    heads = joined.where("tag = 'th'").groupBy(key, "table", "place").agg(F.min_by("text", "node").alias("header"))
    links = _first_links(rows, key, joined).select(key, "node", F.col("a.href").alias("href"))
    return joined.where("tag = 'td'").join(heads, [key, "table", "place"]).join(links, [key, "node"], "left").select(key, F.col("parent").alias("row"), "header", "text", "href")


def header_fields(rows: DataFrame, key: str) -> DataFrame:
    """name and value of short elements beside the first heading that say name: value, up to the first paragraph."""
    first = rows.where(F.col("tag").isin("h1", "h2")).groupBy(key).agg(F.min_by(F.struct("node", "parent", "last"), "node").alias("h"))
    body = rows.where("tag = 'p'").join(first, key).where(F.col("node") > F.col("h.last")).groupBy(key).agg(F.min("node").alias("p"))
    near = rows.join(first, key).join(body, key, "left").where((F.col("node") > F.col("h.last")) & (F.col("node") < F.coalesce("p", F.lit(1 << 30))) & (F.col("node") == F.col("last")) & (F.char_length("text") <= 160))
    said = F.regexp_extract(F.col("text"), r"^\s*([^:：]{1,20})\s*[:：]\s*(.+?)\s*$", 1), F.regexp_extract(F.col("text"), r"^\s*([^:：]{1,20})\s*[:：]\s*(.+?)\s*$", 2)
    return near.select(key, said[0].alias("name"), said[1].alias("value")).where("name <> '' and value <> ''")


def publication_lists(rows: DataFrame, key: str, valid: float = 0.6) -> DataFrame:
    """column, title, href and day of lists below headings: each list's items with links, if valid of them have a title of 8 characters and a date."""
    # the latest heading before a list among the children of one element
    before = W.partitionBy(key, "parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    named = rows.where(F.col("tag").isin("h2", "h3", "h4", "ul", "ol")).withColumn("column", F.last(F.when(F.col("tag").startswith("h"), F.col("text")), ignorenulls=True).over(before))
    named = named.where(F.col("tag").isin("ul", "ol") & F.col("column").isNotNull()).select(key, F.col("node").alias("list"), "column")
    items = rows.where("tag = 'li'").withColumnRenamed("parent", "list").join(named, [key, "list"])
    links = _first_links(rows, key, items)
    whole = items.join(links, [key, "node"]).select(key, "list", "column", "node", F.col("a.label").alias("title"), "a.href", dates.first_date(F.col("text")).alias("day"))
    good = (F.char_length("title") >= 8) & F.col("day").isNotNull()
    share = whole.groupBy(key, "list").agg(F.avg(good.cast("double")).alias("share")).where(F.col("share") >= valid)
    return whole.join(share.select(key, "list"), [key, "list"], "left_semi").select(key, "column", "title", "href", "day")


def structure(rows: DataFrame, key: str) -> DataFrame:
    """Entries of nested menus: label, href, relation (menu_group with entries below it, else navigation_entry) and parent (the label of the entry around it)."""
    items = rows.where("tag = 'li'").select(key, "node", "last")
    entries = items.join(_first_links(rows, key, items), [key, "node"])
    parents = rows.select(key, "node", "parent").join(entries.select(key, "node"), [key, "node"])
    # what holds an entry holds its parent
    outer = nesting.nearest(entries, parents.select(key, F.col("parent").alias("node")).distinct(), key).where("level > 0").select(key, F.col("node").alias("parent"), F.col("owner").alias("above"))
    labels = entries.select(key, F.col("node").alias("above"), F.col("a.label").alias("o_label"))
    near = parents.join(outer, [key, "parent"], "left").join(labels, [key, "above"], "left").select(key, F.col("node").alias("item"), F.col("o_label").alias("parent"), "above")
    entries = entries.withColumnRenamed("node", "item")
    below = near.where("above is not null").select(key, F.col("above").alias("item"), F.lit(True).alias("group")).distinct()
    joined = entries.join(near.select(key, "item", "parent"), [key, "item"]).join(below, [key, "item"], "left")
    return joined.select(key, "a.label", "a.href", F.when(F.col("group"), "menu_group").otherwise("navigation_entry").alias("relation"), "parent")


def titled(rows: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """The heading (node, parent, begin, end, last) of each page that has the title of titles (key, title), if only one does."""
    from noticeweave.functions.scalars import title_key

    named = titles.select(key, title_key(F.col("title")).alias("wanted")).where("wanted <> ''")
    found = rows.where(F.col("tag").isin("h1", "h2", "h3", "h4")).withColumn("told", title_key(F.col("text"))).join(named, key).where("told = wanted")
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "parent", "begin", "end", "last")).alias("h")).where("n = 1").select(key, "h.*")


def article_dates(rows: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """key, state, day and basis of an article's publication: the only date beside its only heading, up to the first paragraph, or else the only one of the page's metadata.

    Dates of events and changes don't count; without a heading of that title, or with several dates, the day is unknown.
    """
    heads = titled(rows, titles, key).select(key, F.col("node").alias("h_node"), F.col("last").alias("h_last"))
    body = rows.where("tag = 'p'").join(heads, key).where("node > h_last").groupBy(key).agg(F.min("node").alias("p"))
    leaf = (F.col("node") == F.col("last")) & (F.col("node") > F.col("h_last")) & (F.col("node") < F.coalesce("p", F.lit(1 << 30)))
    near = rows.join(heads, key).join(body, key, "left").where(leaf & (F.char_length("text") <= 160) & ~F.concat_ws(" ", "text", "classes").rlike(dates.NOT_PUBLISHED))
    shown = near.select(key, F.lit(0).alias("rank"), dates.first_date(F.col("text")).alias("day"))
    named = F.lower(F.coalesce(F.element_at("attrs", F.lit("name")), F.element_at("attrs", F.lit("property")), F.element_at("attrs", F.lit("itemprop")), F.lit("")))
    metas = rows.where((F.col("tag") == "meta") & named.isin("pubdate", "publishdate", "date", "datepublished", "article:published_time")).join(heads, key, "left_semi")
    both = shown.unionByName(metas.select(key, F.lit(1).alias("rank"), dates.first_date(F.coalesce(F.element_at("attrs", F.lit("content")), F.lit(""))).alias("day"))).where("day is not null")
    ranked = both.groupBy(key, "rank").agg(F.countDistinct("day").alias("n"), F.min("day").alias("day")).groupBy(key).agg(F.min(F.struct("rank", "n", "day")).alias("b"))
    joined = titles.select(key).distinct().join(heads, key, "left").join(ranked, key, "left")
    fine = F.col("h_node").isNotNull() & (F.col("b.n") == 1)
    state = F.when(fine, "verified").when(F.col("h_node").isNull(), "no_heading").otherwise("missing_or_conflicting")
    return joined.select(key, state.alias("state"), F.when(fine, F.col("b.day")).alias("day"), F.when(fine, F.when(F.col("b.rank") == 0, "visible").otherwise("meta")).alias("basis"))


def bound_bodies(rows: DataFrame, titles: DataFrame, key: str, least: int = 50) -> DataFrame:
    """key and body: the text after a page's only heading of its title, within the element that holds it, if it has least characters."""
    heads = titled(rows, titles, key)
    holders = rows.select(key, F.col("node").alias("parent"), F.col("begin").alias("p_begin"), F.col("text").alias("p_text"))
    cut = heads.join(holders, [key, "parent"]).select(key, F.substring(F.col("p_text"), F.col("end") - F.col("p_begin") + 1, F.char_length("p_text")).alias("body"))
    return cut.where(F.char_length("body") >= least)


def fragments(rows: DataFrame, key: str, size: int = 16_384) -> DataFrame:
    """key, chunk, path and text: a page's innermost blocks in order, put together up to size characters, each with the tags around it."""
    from noticeweave.functions.elements import _BLOCKS
    from noticeweave.functions.scalars import packed

    blocks = rows.where(F.col("tag").isin(*sorted(_BLOCKS), "li", "td", "th"))
    lowest = nesting.innermost(blocks, key).where("text <> ''")
    around = nesting.enclosing(rows, lowest, key).where("owner <> node").join(rows.select(key, F.col("node").alias("owner"), F.col("tag").alias("o_tag")), [key, "owner"])
    shells = around.groupBy(key, "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("owner", "o_tag"))), lambda x: x["o_tag"]).alias("shell"))
    shelled = lowest.select(key, "node", "tag", "text").join(shells, [key, "node"], "left").withColumn("shell", F.coalesce("shell", F.array().cast("array<string>")))
    page = shelled.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("node", "text", F.concat_ws(">", "shell", "tag").alias("path")))).alias("b"))
    numbered = page.select(key, F.explode(F.arrays_zip("b", packed(F.col("b.text"), size).alias("chunk"))).alias("z"))
    return numbered.select(key, F.col("z.chunk").alias("chunk"), "z.b.path", "z.b.text")
