"""How fetched pages can be used, judged from what they are: walls, challenges, empty lists, shells of scripts and real content.

Literal marks are found in one pass over a page by one pattern of all of them; what elements tell is one aggregation over the table of elements. Rules are then a list in
order, of which the first that holds decides and names its evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeweave.functions.scalars import sign_in_route

# Marks of challenges that scripts solve and that people solve, names of identity pages, titles of refusals and prompts, messages of empty lists, article regions, days and links.
AUTOMATIC = ("$_ts", "/cdn-cgi/challenge-platform/", "cf-chl-", "checking your browser", "just a moment...", "正在检查您的浏览器")
MANUAL = ("verify you are human", "请完成安全验证", "请完成下方验证", "请输入验证码", "滑动滑块", "人机身份验证")
IDENTITY = r"(?i)统一身份|统一认证|统一登录|单点登录|身份认证|single\s*sign[-\s]?on|identity\s+provider|usernamepassword|webauthn|\bsso\b"
REFUSED = ("access denied", "403 forbidden", "forbidden", "error", "访问被拒绝")
PROMPTS, RESTRICTED = ("系统提示", "访问提示", "提示信息"), r"暂无权限|无权访问|没有访问权限|仅限校内访问"
EMPTY = r"(?i)^(?:暂无(?:通知|公告|新闻|内容|信息|数据|记录)|没有(?:相关)?(?:通知|公告|记录|数据)|no (?:results|records|notices|data)(?: found)?)[。.!！\s]*$"
ARTICLE_CLASSES, ARTICLE_IDS = ("v_news_content", "wp_articlecontent", "article-content", "article_content", "trs_editor"), ("vsb_content", "vsb_content_2")
DAY, PUBLICATION = r"20\d{2}[-年./]\d{1,2}[-月./]\d{1,2}|\d{1,2}[-/]\d{1,2}", r"(?i)/(?:info|article|news|content)/|(?:newsDetail|ArticleID)[?=/]"
MARKED, OPENING = 300_000, 200


def marks(html: Column) -> Column:
    """The marks of challenges that solve themselves in the beginning of a page, each once."""
    pattern = "|".join("\\Q" + m + "\\E" for m in AUTOMATIC)
    return F.array_distinct(F.regexp_extract_all(F.lower(F.substring(html, 1, MARKED)), F.lit(f"({pattern})"), 1))


def told(rows: DataFrame, key: str) -> DataFrame:
    """What elements tell of each page: title, article (a region with text or a picture), empties, publications (links that look like notices), anchors."""
    region = (F.col("tag") == "article") | F.exists("classes", lambda c: F.lower(c).isin(*ARTICLE_CLASSES)) | F.lower("ident").isin(*ARTICLE_IDS)
    picture = (F.col("tag") == "img") & (F.coalesce(F.element_at("attrs", F.lit("src")), F.lit("")) != "")
    from noticeweave.operators.nesting import sums_inside

    counted = sums_inside(rows.where(region | picture), key, pictures=picture.cast("int")).where(region & ((F.char_length("text") >= 8) | (F.col("pictures") > 0)))
    articles = counted.groupBy(key).agg(F.lit(True).alias("article"))
    around = rows.select(key, F.col("node").alias("parent"), F.col("text").alias("around"))
    links = rows.where("tag = 'a' and href <> ''").join(around, [key, "parent"], "left")
    label = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.element_at("attrs", F.lit("title")), F.lit(""))
    told_links = links.groupBy(key).agg(
        F.count_if((F.char_length(label) >= 4) & (F.coalesce("around", label).rlike(DAY) | F.col("href").rlike(PUBLICATION))).alias("publications"),
        F.count_if((F.col("text") != "") & ~F.col("href").rlike("(?i)^(javascript:|mailto:|tel:)")).alias("anchors"),
    )
    hidden = F.coalesce(F.element_at("attrs", F.lit("style")), F.lit("")).rlike(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden") | F.array_contains(F.map_keys("attrs"), "hidden")
    one = rows.groupBy(key).agg(
        F.min_by(F.when(F.col("tag") == "title", F.lower(F.trim("text"))), F.when(F.col("tag") == "title", F.col("node"))).alias("title"),
        F.count_if((F.col("node") == F.col("last")) & ~hidden & F.trim("text").rlike(EMPTY)).alias("empties"),
    )
    return one.join(articles, key, "left").join(told_links, key, "left")


def classified(pages: DataFrame, texts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, outcome, code and evidence of fetched pages.

    pages: key, url, final_url, html, status, transport (http or browser), purpose (list, directory or article), challenged (a header says so); texts: key and the page's shown text; rows: elements.
    Regions that a source demands, material that scripts still load and bodies bound to a known title are judged by their own operators.
    """
    joined = pages.join(texts.select(key, "text"), key, "left").join(told(rows, key), key, "left").withColumns(
        {"marks": marks(F.coalesce("html", F.lit(""))), "shown": F.trim(F.coalesce("text", F.lit(""))), "title": F.coalesce("title", F.lit(""))}
    )
    lower, shown, title = F.lower(F.substring(F.coalesce("html", F.lit("")), 1, MARKED)), F.col("shown"), F.col("title")
    size = F.char_length("shown")
    rendered, article = F.col("transport") == "browser", F.coalesce("article", F.lit(False))
    automatic = F.coalesce("challenged", F.lit(False)) | (F.size("marks") > 0)
    manual = F.lower("shown").rlike("|".join(MANUAL)) & (automatic | (size < 1200) | F.coalesce(F.col("status").isin(403, 412), F.lit(False)))
    named = title.rlike(IDENTITY) | F.substring("shown", 1, OPENING).rlike(IDENTITY)
    walled = sign_in_route(F.coalesce("final_url", F.lit(""))) & named & ~article
    prompted = title.isin(*PROMPTS) & (size < 1200) & shown.rlike(RESTRICTED) & ~article
    listing, directory = F.col("purpose") == "list", F.col("purpose") == "directory"
    empty = (F.col("purpose") != "article") & (F.coalesce("empties", F.lit(0)) > 0)
    shell = F.contains(lower, F.lit("<script")) & ((size < 120) | lower.rlike("""id\\s*=\\s*["'](?:app|root|__next)["']"""))
    anchors = (F.coalesce("anchors", F.lit(0)) > 0) | (size >= 60)
    status = F.col("status")
    rules = (
        (status.isNull(), "network_error", "no_response", ""),
        (manual, "needs_manual", "human_verification", "manual_challenge"),
        (automatic & rendered, "needs_manual", "access_challenge", "automatic_challenge"),
        (automatic, "requires_render", "access_challenge", "automatic_challenge"),
        (status >= 500, "network_error", "http", ""),
        (status >= 400, "denied", "http", ""),
        (F.trim(F.coalesce("html", F.lit(""))) == "", "needs_adapter", "empty_response", ""),
        (title.isin(*REFUSED), "denied", "access_denied_page", ""),
        (walled, "denied", "source_login_required", ""),
        (prompted, "denied", "source_access_restricted", "site_permission_prompt"),
        (~rendered & F.regexp_extract("url", "#(.*)$", 1).rlike("^!?/"), "requires_render", "fragment_route", "fragment_route_requires_browser"),
        ((F.col("purpose") == "article") & article, "usable", "", "article_region"),
        (directory & ~empty & anchors, "usable", "", "visible_directory_content"),
        (listing & (F.coalesce("publications", F.lit(0)) > 0), "usable", "", "publication_link"),
        (empty, "empty", "", "explicit_empty_message"),
        (shell & ~rendered, "requires_render", "javascript_shell", "javascript_shell"),
    )
    decision = F.struct(F.lit("needs_adapter").alias("outcome"), F.lit("content_not_recognized").alias("code"), F.lit("").alias("evidence"))
    for holds, outcome, code, evidence in reversed(rules):
        name = F.concat(F.lit("http_"), status.cast("string")) if code == "http" else F.lit(code)
        decision = F.when(holds, F.struct(F.lit(outcome).alias("outcome"), name.alias("code"), F.lit(evidence).alias("evidence"))).otherwise(decision)
    return joined.select(key, decision.alias("d")).select(key, "d.*")
