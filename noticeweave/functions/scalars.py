"""Column builders: addresses, hashes, names, titles and dates."""

from __future__ import annotations

import datetime as dt
import html

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track.
TRACKING = ("fbclid", "gclid")
_HOST = r"^https?://([^/?#:]+)"
# Forms of articles' addresses, titles that only are dates or labels of navigation, words of notices and common labels.
ARTICLE = (
    r"(?i)/(info/\d+/\d+|(article|detail|content)/|\d{4}/\d{4,})|/post/\d+($|[?#])|/Data/View/\d+($|[?#])|/\d{6,}\.(s?html?)|[?&](articleid|contentid|wbnewsid)=|"
    r"/news-show-\d+\.html?($|[?#])|/c\d+a\d+/page\.htm($|[?#])"
)
DATE_ONLY = (
    r"^(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?$", r"^(20\d{2})[-/.](\d{1,2})$", r"^(20\d{2})年(\d{1,2})月$", r"^\d{1,2}-\d{1,2}$", r"^\d{1,2}\.\d{1,2}$", r"^\d{8}$",
    r"(?i)^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}$", r"(?i)^\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?,?\s+\d{4}$",
)
STRONG = ("关于", "通知", "公告", "公示", "通报", "名单", "结果", "决定", "办法", "意见", "召开", "举行", "开展", "做好", "申报", "推荐", "评选", "征集", "报名", "放假")
JUNK = (
    "more", "more>>", "more »", ">>", "»", "[详细]", "详细", "详细>", "更多", "首页", "查看详情", "查看全文", "查看更多", "进入", "正文", "当前位置", "上一篇", "下一篇", "返回", "close", "附件",
    "附件下载", "english", "english version", "english website", "中文", "中文版", "网站地图", "通知公告", "新闻中心", "学校新闻", "信息公开", "组织机构", "招生就业", "科学研究", "人才培养",
    "本科教育", "研究生教育",
)
NOTICE_WORDS = ("关于", "通知", "公告", "公示", "通报", "决定", "意见", "办法")
GENERIC = ("首页", "主页", "通知公告", "通知", "公告", "新闻动态", "新闻", "信息公开", "Home")


def host(url: Column) -> Column:
    """The lower-case host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.", "")


def registrable(url: Column) -> Column:
    """The last two labels of the host."""
    labels = F.split(host(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")


def official_domain(url: Column) -> Column:
    """The host without www., but three labels only under .edu.cn and .ac.cn."""
    labels = F.split(host(url), r"\.")
    three = host(url).rlike(r"\.(edu|ac)\.cn$") & (F.size(labels) >= 3)
    return F.when(three, F.array_join(F.slice(labels, F.size(labels) - 2, 3), ".")).otherwise(host(url))


def same_school(url: Column, school_url: Column) -> Column:
    """Whether an address is of a school's domain or under it."""
    base, mine = official_domain(school_url), F.lower(F.regexp_extract(url, _HOST, 1))
    return (base != "") & ((mine == base) | F.endswith(mine, F.concat(F.lit("."), base)))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def canonical_ascii(url: Column) -> Column:
    """Addresses of ASCII hosts without a port and with plain parameters: lower-case host, no tracking parameters, sorted pairs, no plain fragment."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.transform(F.split(query, "&"), lambda p: F.when(F.contains(p, F.lit("=")) | (p == ""), p).otherwise(F.concat(p, F.lit("="))))
    plain = F.filter(pairs, lambda p: (p != "") & ~p.rlike(r"(?i)^(utm_[^=]*|" + "|".join(TRACKING) + ")=") & (p != "="))
    ordered = F.transform(F.array_sort(F.transform(plain, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))), lambda s: F.concat(s["k"], F.lit("="), s["v"]))
    base = F.concat(F.lower(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)), F.when(path(url) == "", "/").otherwise(path(url)))
    found = F.concat(base, F.when(F.size(ordered) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise(""))
    return F.when(~url.rlike(r"^https?://[^/?#@]+([/?#]|$)"), "").otherwise(found)


def fragment_route(url: Column) -> Column:
    return F.regexp_extract(url, "#(.*)$", 1).rlike("^!?/")


def scope_path(value: Column) -> Column:
    """A path without its default document and last slashes."""
    return F.regexp_replace(F.regexp_replace(value, r"(?i)/(index|main|default)\.(s?html?|aspx?|php)$", "/"), "/+$", "")


def same_page_key(url: Column) -> Column:
    """Host, port, path without last slash, query and route: equal for addresses of one page, whatever the scheme."""
    bare = F.regexp_replace(url, r"^https?://", "")
    at = F.regexp_extract(bare, r"^([^/?#]*)([^?#]*)(.*)$", 1)
    return F.concat(F.lower(at), F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)([^?#]*)(.*)$", 2), "/+$", ""), F.regexp_extract(bare, r"^([^/?#]*)([^?#]*)(.*)$", 3))


def public_url(url: Column) -> Column:
    """Whether an address may be fetched: http or https, no account, port 80 or 443, no white space or backslash, no local or private host."""
    name = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1)), r"\.$", "")
    bare, port = F.regexp_extract(name, r"^(\[[^\]]*\]|[^:]*)(:(\d*))?$", 1), F.regexp_extract(name, r":(\d+)$", 1)
    numbers = F.transform(F.split(F.regexp_extract(bare, r"^\d{1,3}(\.\d{1,3}){3}$", 0), r"\."), lambda n: n.try_cast("int"))
    a, b = F.get(numbers, 0), F.get(numbers, 1)
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 198) & b.isin(18, 19)) | ((a == 192) & (b == 0)) | (a > 255)
    )
    local = (bare == "localhost") | bare.rlike(r"\.(localhost|local|internal)$") | bare.rlike(r"^\[(::1?|f[cd].*|fe[89ab].*)\]$")
    fine = url.rlike(r"^https?://[^/?#@\s]+([/?#]|$)") & (F.char_length(url) <= 2000) & ~url.rlike(r"[\s\\]") & port.isin("", "80", "443") & (bare != "")
    return F.coalesce(fine & ~local & ~F.coalesce(private, F.lit(False)), F.lit(False))


def sign_in_route(url: Column) -> Column:
    """Whether an address is a sign-in page: its last path segment says so and a parameter names the address to return to."""
    segment = F.regexp_replace(F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), r"([^/]*)$", 1), r"\.[^.]*$", "")
    named = segment.rlike(r"(?i)^(cas|sso|passport|shibboleth|oauth2?|openid|adfs|signin|sign-?in|auth|authorize|[a-z0-9_-]*login|login[a-z0-9_-]*)$")
    handed = url.rlike(r"(?i)[?&](service|redirect_uri|returnurl|return_url|returl|rurl|backurl|back_url)=(https?(:|%3a)|/|%2f)")
    return named & handed


def article_address(url: Column) -> Column:
    """Whether an address has the form of an article's."""
    return url.rlike(ARTICLE)


def file_address(url: Column, label: Column) -> Column:
    """Whether an address or its label is of a document to load, not of a page."""
    return F.regexp_extract(url, "^[^?#]*", 0).rlike(r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z)$") | url.rlike(r"(?i)/download(\.jsp|/|\?|$)") | label.rlike(r"(?i)\.(pdf|docx?|xlsx?)$")


def page_address(url: Column, style: str, number: Column) -> Column:
    """The address of a list's page by how its pages are counted; the first is the list itself, an unknown style gives null."""
    base, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    n, before = number.cast("string"), (number - 1).cast("string")
    folder = F.regexp_replace(base, r"/[^/]*$", "")
    ending = {"default": "shtml", "catalog": "shtml", "index_htm": "htm", "index_html": "html"}
    if style in ending:
        named = base.rlike(r"\.(shtml|html?|jsp|aspx?|php)$")
        made = (
            F.when(base.rlike(r"/index_\d+\.\w+$"), F.regexp_replace(base, F.lit(r"/index_\d+"), F.concat(F.lit("/index_"), n)))
            .when(named, F.concat(folder, F.lit("/index_"), n, F.lit("."), F.regexp_extract(base, r"\.(\w+)$", 1)))
            .otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/index_"), n, F.lit("." + ending[style])))
        )
    elif style == "index_htm_offset":
        made = F.when(F.contains(base, F.lit("/index")), F.regexp_replace(base, F.lit(r"/index\d*\.htm$"), F.concat(F.lit("/index"), before, F.lit(".htm"))))
    elif style in ("query_page", "query_page_index", "query_page_zero"):
        value = before if style == "query_page_zero" else n
        query = F.regexp_extract(url, r"\?([^#]*)", 1)
        others = F.filter(F.split(query, "&"), lambda p: (p != "") & F.contains(p, F.lit("=")) & ~p.rlike("^page=") & ~p.rlike("=$"))
        return F.when(number == 1, url).otherwise(F.concat(base, F.lit("?"), F.array_join(F.concat(others, F.array(F.concat(F.lit("page="), value))), "&")))
    elif style == "list_htm":
        made = F.when(base.rlike(r"/list\d*\.htm$"), F.regexp_replace(base, F.lit(r"/list\d*\.htm$"), F.concat(F.lit("/list"), n, F.lit(".htm")))).otherwise(
            F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/list"), n, F.lit(".htm"))
        )
    elif style == "page_path":
        bare = F.regexp_replace(base, "/+$", "")
        made = F.concat(F.regexp_replace(bare, r"/\d+$", ""), F.lit("/"), n)
    elif style == "default_htm":
        made = F.concat(folder, F.lit("/"), n, F.lit(".htm"))
    else:
        return F.lit(None).cast("string")
    return F.when(number == 1, url).otherwise(F.concat(made, tail))


def site_key(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 20)


def url_key(canonical: Column) -> Column:
    return F.sha2(F.nullif(canonical, F.lit("")), 256)


def content_hash(title: Column, body: Column, attachments: Column) -> Column:
    """md5 of the title, the body's first 500 characters and the sorted different attachments."""
    names = F.array_join(F.array_sort(F.array_distinct(attachments)), "|")
    return F.md5(F.concat(F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 500), F.lit("|"), names))


def input_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.to_json(F.array(title, body)), 256)


def history_digest(title: Column, text: Column, html: Column) -> Column:
    return F.sha2(F.to_json(F.array(title, text, html)), 256)


def source_signature(*selectors: Column) -> Column:
    """One digest of a list's selectors; none and empty ones are alike."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(c, F.lit("")) for c in selectors))), 256)


def node_key(kind: Column, label: Column, url: Column) -> Column:
    """The key of a node: 24 digits of a digest of kind, label and address; units are the same under http and https."""
    place = F.when((kind == "unit") & url.rlike("^https?://"), F.regexp_replace(url, "^https?:", "")).otherwise(F.coalesce(url, F.lit("")))
    return F.substring(F.sha2(F.concat_ws("\u0000", kind, label, place), 256), 1, 24)


def shape_digest(shapes: Column) -> Column:
    """A digest of an array of shapes (links, tags, columns) with digits masked, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.transform(shapes, lambda x: F.regexp_replace(x, r"\d+", "#")))), "\n"), 256)


def title_key(title: Column) -> Column:
    """Letters, digits and underscores of a title, in lower case."""
    return F.replace(F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}_]+", "")), F.lit("ß"), F.lit("ss"))


def bare(text: Column) -> Column:
    """A name without spaces, dashes, dots and colons."""
    return F.regexp_replace(text, r"[\s\-—–_.·•:：]+", "")


def clean(text: Column) -> Column:
    """One space for any white space, none at the ends and none between Han characters."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(plain, r"(?<=[\u3400-\u9fff])\s+(?=[\u3400-\u9fff])", "")


def junk_title(title: Column, url: Column | None = None) -> Column:
    """Whether a text can't be a notice's title: empty, too short, a date, or the label of navigation. url: the article's address, which saves short ones."""
    t = F.trim(F.coalesce(title, F.lit("")))
    article = F.lit(False) if url is None else article_address(F.coalesce(url, F.lit("")))
    han = F.regexp_replace(t, r"\s+", "").rlike("^[\u3400-\u9fff]{2,3}$")
    dated = F.lit(False)
    for p in DATE_ONLY:
        dated = dated | t.rlike(p)
    strong = F.lit(False)
    for w in STRONG:
        strong = strong | F.contains(t, F.lit(w))
    n = F.char_length(t)
    return (
        (n == 0) | ((n < 4) & ~(han & article)) | F.lower(t).isin(*JUNK) | t.rlike(r"(?iU)^(english\s+(version|website)|网站地图|版权所有)\b") | dated | ((n <= 8) & ~strong & ~article)
    )


def title_score(title: Column) -> Column:
    """10 for 8 to 80 characters, 2 for each Han character, and 6 for a word of notices."""
    han = F.char_length(F.regexp_replace(title, "[^\u4e00-\u9fff]", ""))
    word = F.lit(False)
    for w in NOTICE_WORDS:
        word = word | F.contains(title, F.lit(w))
    return F.when(F.char_length(title).between(8, 80), 10).otherwise(0) + 2 * han + F.when(word, 6).otherwise(0)


def title_identity(title: Column, column_label: Column, school: Column) -> Column:
    """The only part of a page's title that is neither the column's label, a common one nor the school; '' if there are several or none fits."""
    parts = F.filter(F.transform(F.split(title, r"\s*[|｜_—–-]\s*"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin(*GENERIC) & ~p.eqNullSafe(column_label))
    chosen = F.when(F.size(parts) > 1, F.filter(parts, lambda p: ~p.eqNullSafe(school))).otherwise(parts)
    one = F.get(chosen, 0)
    return F.coalesce(F.when((F.size(chosen) == 1) & F.char_length(one).between(2, 100) & ~one.rlike("关于|通知|公告|来访|访问|调研|召开|举行"), one), F.lit(""))


def escaped(text: Column) -> Column:
    """HTML of a text."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def highlight(text: Column, query: str) -> Column:
    """HTML with each term marked in turn, whatever its case; signs in terms are literal."""
    out = escaped(F.coalesce(text, F.lit("")))
    for term in query.split():
        out = F.regexp_replace(out, r"(?iu)\Q" + html.escape(term).replace("\\E", "\\E\\\\E\\Q") + r"\E", "<mark>$0</mark>")
    return out


def _first_place(text: Column, terms: list[str]) -> tuple[Column, Column]:
    """Where (from 1) the earliest of terms stands, or 0, and its length; of terms at one place the first."""
    at, size = F.lit(0), F.lit(0)
    for t in terms:
        here = F.locate(t.lower(), F.lower(text))
        better = (here > 0) & ((at == 0) | (here < at))
        at, size = F.when(better, here).otherwise(at), F.when(better, len(t)).otherwise(size)
    return at, size


def snippet(text: Column, query: str, before: int = 40, after: int = 80) -> Column:
    """The surroundings of the earliest term, with dots where something is left out and terms marked; '' without any term."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    at, size = _first_place(plain, query.split())
    start = F.greatest(F.lit(0), at - 1 - before)
    end = F.least(F.char_length(plain), at - 1 + size + after)
    part = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(plain, start + 1, end - start), F.when(end < F.char_length(plain), "…").otherwise(""))
    return F.when(at > 0, highlight(part, query)).otherwise("")


def excerpt_of(texts: list[Column], query: str, before: int = 28, span: int = 160) -> Column:
    """A stretch of the first text that has a term."""
    found = []
    for text in texts:
        plain = F.trim(F.coalesce(text, F.lit("")))
        at, _ = _first_place(plain, query.lower().split()[:10])
        start = F.greatest(F.lit(0), at - 1 - before)
        end = F.least(F.char_length(plain), start + span)
        part = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(plain, start + 1, end - start), F.when(end < F.char_length(plain), "…").otherwise(""))
        found.append(F.when(at > 0, part))
    return F.coalesce(*found, F.lit(""))


def ranked_label(label: Column, rules: tuple[tuple[str, int], ...], otherwise: int) -> Column:
    """The number of the first rule (pattern, number) that a label meets."""
    out = F.lit(otherwise)
    for pattern, number in reversed(rules):
        out = F.when(F.coalesce(label, F.lit("")).rlike(pattern), number).otherwise(out)
    return out


def classified(label: Column, rules: tuple[tuple[str, int, str], ...]) -> Column:
    """The kind of the first rule (kind, most characters, pattern) that a label meets, or null."""
    plain = F.regexp_replace(F.coalesce(label, F.lit("")), r"^[ *·]+|[ *·]+$", "")
    out = F.lit(None).cast("string")
    for kind, most, pattern in reversed(rules):
        out = F.when((F.char_length(plain) <= most) & plain.rlike(pattern), kind).otherwise(out)
    return out


def paragraphs(text: Column, size: int = 8000) -> Column:
    """The paragraphs of a text in pieces of up to size characters, none of them blank."""
    parts = F.filter(F.split(text, r"\n\s*\n|\r?\n"), lambda p: F.trim(p) != "")
    cut = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.char_length(p) - 1, F.lit(size)), lambda i: F.trim(F.substring(p, i + 1, F.lit(size))))))
    return F.filter(cut, lambda p: p != "")


def packed(pieces: Column, size: int = 8000) -> Column:
    """pieces put together in order: a number of the chunk for each, a new one where size would be passed."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).alias("held"))

    def step(s: Column, p: Column) -> Column:
        n = F.char_length(p)
        new = (F.size(s["out"]) > 0) & (s["held"] + n > size)
        chunk = s["chunk"] + new.cast("int")
        return F.struct(F.array_append(s["out"], chunk).alias("out"), chunk.alias("chunk"), F.when(new, n).otherwise(s["held"] + n).alias("held"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def windows_of(text: Column, size: int = 1800, stride: int = 1600) -> Column:
    """Overlapping pieces of a text."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length(text) - 1), F.lit(stride))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def url_date(url: Column) -> Column:
    """A date in an address: /yyyy-mm-dd/ before /yyyymmdd/; null if there is none or no such day."""
    dashed = F.try_to_date(F.nullif(F.regexp_extract(url, r"/(\d{4}-\d{2}-\d{2})/", 1), F.lit("")), "yyyy-MM-dd")
    return F.coalesce(dashed, F.try_to_date(F.nullif(F.regexp_extract(url, r"/(\d{8})/", 1), F.lit("")), "yyyyMMdd"))


def text_dates(text: Column) -> Column:
    """All valid dates yyyy-mm-dd in a text, each once, newest first."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), 1), lambda s: F.try_to_date(s, "yyyy-MM-dd"))
    return F.sort_array(F.array_distinct(F.filter(found, lambda d: d.isNotNull())), asc=False)


def utc_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def not_future(at: Column, as_of: dt.datetime) -> Column:
    """Null for dates after the day."""
    return F.when(F.to_date(at) <= F.lit(as_of.date()), at)


def jitter(key: Column, period: int) -> Column:
    """A number below period that depends on the key only."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % period


def backoff(failures: Column, steps: tuple[int, ...] = (60, 300, 1800, 7200)) -> Column:
    return F.element_at(F.array(*map(F.lit, steps)), F.greatest(F.lit(1), F.least(failures, F.lit(len(steps))))).cast("long")


def local_day(at: Column, offset_minutes: int) -> Column:
    return F.to_date(at + F.make_dt_interval(mins=F.lit(offset_minutes)))


def name_without(name: Column, endings: tuple[str, ...]) -> Column:
    """A name in one form: cleaned, without what stands in brackets at its end and without common endings."""
    plain = F.regexp_replace(clean(name), r"\s*[(（\[【][^)）\]】]*[)）\]】]$", "")
    for e in endings:
        plain = F.when(F.endswith(plain, F.lit(e)) & (F.char_length(plain) > len(e)), F.trim(F.substring(plain, 1, F.char_length(plain) - len(e)))).otherwise(plain)
    return plain


def column_label(label: Column) -> Column:
    """A list's label without signs around it and words for more."""
    return F.regexp_replace(F.regexp_replace(clean(label), r"(?i)\s*(more|更多)\s*(>>|»|>)?$", ""), r"^[\s·•|>»:：]+|[\s·•|>»:：]+$", "")


def source_label(unit: Column, label: Column) -> Column:
    """How a source is shown: its unit and its label, the label alone if it begins with the unit or there is none."""
    u, c = F.coalesce(clean(unit), F.lit("")), F.coalesce(column_label(label), F.lit(""))
    return F.when((u == "") | F.startswith(c, u), c).when(c == "", u).otherwise(F.concat(u, F.lit(" · "), c))


def plain_title(title: Column) -> Column:
    """A title without a date at its beginning or end, marks of new ones and dots of shortened ones."""
    t = F.regexp_replace(clean(title), r"(?i)^\[?(new|置顶|热)\]?\s+", "")
    t = F.regexp_replace(t, r"^\s*[\[(（]?20\d{2}[-./年]\d{1,2}[-./月]\d{1,2}日?[\])）]?\s*|\s*[\[(（]?20\d{2}[-./年]\d{1,2}[-./月]\d{1,2}日?[\])）]?\s*$", "")
    return F.trim(F.regexp_replace(t, r"(\.{3}|…)+$", ""))


def provenance(line: Column) -> Column:
    """The different sources that a line of fields names, in order: what follows source, from or 来源 up to the next field."""
    found = F.regexp_extract_all(line, F.lit(r"(?i)(?:来源|source|from)\s*[:：]\s*(.*?)\s*(?=(?:来源|作者|编辑|时间|浏览|source|author|editor|date|views)\s*[:：]|$)"), 1)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def in_json_array(array: Column, value: Column) -> Column:
    """Whether a JSON array of strings has a value, exactly."""
    return F.coalesce(F.array_contains(F.from_json(array, "array<string>"), value), F.lit(False))


def json_hashes(value: Column) -> Column:
    """All 64-digit hashes anywhere in a JSON text, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(value, F.lit('(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])'), 1)))


def feed_items(feed: Column) -> Column:
    """The items of a feed's JSON as an array: those of all its lists, or its own samples."""
    parsed = F.from_json(feed, "lists array<struct<column:string,samples:array<struct<url:string,date:string>>>>, samples array<struct<url:string,date:string>>")
    inner = F.flatten(F.transform(F.filter(parsed["lists"], lambda x: x["samples"].isNotNull()), lambda x: x["samples"]))
    return F.coalesce(inner, parsed["samples"], F.array().cast("array<struct<url:string,date:string>>"))


def json_faults(text: Column, schema: dict, path: str = "$") -> Column:
    """An array of what in a JSON text doesn't fit a schema: type, required, properties, enum, minimum, maximum, minLength, maxLength, items' type."""
    return F.filter(F.array(*_faults(text, schema, path)), lambda f: f.isNotNull()) if _faults(text, schema, path) else F.array().cast("array<string>")


# Names of types in schemas and how Spark calls those of a variant.
_TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID"}


def _faults(text: Column, schema: dict, path: str) -> list[Column]:
    whole = F.try_parse_json(text)
    value = F.try_variant_get(whole, path, "variant")
    kind = F.schema_of_variant(value)
    out = []
    if "type" in schema:
        wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = kind.rlike("|".join(_TYPES[t] for t in wanted))
        out.append(F.when(whole.isNull() if path == "$" else F.lit(False), F.lit(f"{path}: no JSON")).when(value.isNotNull() & ~fits, F.lit(f"{path}: no {'/'.join(wanted)}")))
    if "enum" in schema:
        out.append(F.when(value.isNotNull() & ~F.try_variant_get(whole, path, "string").isin(*map(str, schema["enum"])), F.lit(f"{path}: not listed")))
    number = F.when(kind.rlike(_TYPES["number"]), F.try_variant_get(whole, path, "double"))
    string = F.when(kind.rlike(_TYPES["string"]), F.try_variant_get(whole, path, "string"))
    for name, bad in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n), ("minLength", lambda n: F.char_length(string) < n), ("maxLength", lambda n: F.char_length(string) > n)):
        if name in schema:
            out.append(F.when(bad(schema[name]), F.lit(f"{path}: {name}")))
    for name in schema.get("required", ()):
        out.append(F.when(value.isNotNull() & F.try_variant_get(whole, f"{path}.{name}", "variant").isNull(), F.lit(f"{path}.{name}: missing")))
    for name, inner in schema.get("properties", {}).items():
        out += _faults(text, inner, f"{path}.{name}")
    return out


def register_priorities(spark: SparkSession, name: str, rules: tuple[tuple[str, int], ...], otherwise: int) -> None:
    """A SQL function of a label: the number of the first rule that it meets. It is an expression, not a Python function."""
    cases = " ".join(f"WHEN rlike(label, r'{p}') THEN {n}" for p, n in rules)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(label STRING) RETURNS INT RETURN CASE WHEN label IS NULL THEN {otherwise} {cases} ELSE {otherwise} END")


def _byte_pieces(text: str | None, limit: int) -> list[str]:
    data, out, at = (text or "").encode("utf-8"), [], 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data) and data[end] & 0xC0 == 0x80:  # not inside a character
            end -= 1
        out.append(data[at:end].decode("utf-8"))
        at = end
    return out or [""]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces_of(texts: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([_byte_pieces(t, int(n)) for t, n in zip(texts, limits, strict=True)], dtype=object)


def byte_pieces(text: Column, limit: int = 8192) -> Column:
    """A text in pieces of up to limit (4 at least) bytes of UTF-8, none of which splits a character; one empty piece for none."""
    return _pieces_of(text, F.lit(limit))
