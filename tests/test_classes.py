"""What fetched pages are, by marks, walls and content."""

import pytest

from noticeweave.functions import elements as E
from noticeweave.operators import classes as C

LONG = "word " * 300
CASES = [
    (dict(html="<article>Some real text</article>", purpose="article"), ("usable", "", "article_region")),
    (dict(html="<article></article><p>x", purpose="article"), ("needs_adapter", "content_not_recognized", "")),
    (dict(html="<div id=VSB_CONTENT><img src=a></div>", purpose="article"), ("usable", "", "article_region")),
    (dict(html=f"<p>{LONG}请输入验证码"), ("needs_adapter", "content_not_recognized", "")),  # a long page that only mentions it
    (dict(html=f"<p>{LONG}请输入验证码", status=403), ("needs_manual", "human_verification", "manual_challenge")),
    (dict(html="<p>x</p>", challenged=True), ("requires_render", "access_challenge", "automatic_challenge")),
    (dict(html="<script>$_ts=1</script>", transport="browser"), ("needs_manual", "access_challenge", "automatic_challenge")),
    (dict(html="x", status=429), ("denied", "http_429", "")),
    (dict(html="x", status=500), ("network_error", "http_500", "")),
    (dict(html="x", status=None), ("network_error", "no_response", "")),
    (dict(html=None), ("needs_adapter", "empty_response", "")),
    (dict(html="<title>SSO</title><p>hi", final_url="https://a.cn/login?service=https://b"), ("denied", "source_login_required", "")),
    (dict(html="<title>SSO</title><p>hi", final_url="https://a.cn/news/login.html"), ("needs_adapter", "content_not_recognized", "")),
    (dict(html="<title>SSO</title><article>A notice that all can read</article>", purpose="article", final_url="https://a.cn/login?service=https://b"), ("usable", "", "article_region")),
    (dict(html="<p style='display: none'>暂无通知</p><p>x</p>"), ("needs_adapter", "content_not_recognized", "")),
    (dict(html="<p>No results found.</p>"), ("empty", "", "explicit_empty_message")),
    (dict(html="<p>No results found.</p>", purpose="article"), ("needs_adapter", "content_not_recognized", "")),
    (dict(html="<ul><li><a href=/info/1>Title</a></li></ul>"), ("usable", "", "publication_link")),
    (dict(html="<ul><li><a href=/x>Title</a></li></ul>"), ("needs_adapter", "content_not_recognized", "")),
    (dict(html="<ul><li><a href=/x>Title</a></li></ul>", purpose="directory"), ("usable", "", "visible_directory_content")),
    (dict(html="<p>x</p>", url="https://a.cn/#!/b"), ("requires_render", "fragment_route", "fragment_route_requires_browser")),
    (dict(html=f"<div id='root'>{LONG}</div><script>1</script>"), ("requires_render", "javascript_shell", "javascript_shell")),
]


def test_rules_in_order(spark):
    base = dict(url="https://a.cn/", final_url="https://a.cn/", html="", status=200, transport="http", purpose="list", challenged=None)
    kind = "k int, url string, final_url string, html string, status int, transport string, purpose string, challenged boolean"
    pages = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(CASES)], kind)
    texts = E.page_texts(pages, "k", "html").cache()
    got = {r.k: (r.outcome, r.code, r.evidence) for r in C.classified(pages, texts, E.elements(texts, "k"), "k").collect()}
    for i, (case, want) in enumerate(CASES):
        assert got[i] == want, case
    none = pages.limit(0)
    assert C.classified(none, texts.limit(0), E.elements(texts, "k").limit(0), "k").count() == 0


@pytest.mark.parametrize("text", ["$_TS", "x Checking Your Browser y", "cf-chl-1"])
def test_marks(spark, text):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.size(C.marks(F.lit(text))).alias("n")).first().n == 1
