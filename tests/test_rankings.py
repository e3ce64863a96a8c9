"""Numbers and words that rank links, dates in fields, and confidence in articles."""

from pyspark.sql import functions as F

from noticeweave.functions import dates
from noticeweave.functions import elements as E
from noticeweave.operators import pages as P
from noticeweave.operators import ranking as R


def test_routes(spark):
    rows = [("root", None), ("directory", "low"), ("major", "relevant"), ("channel", "potential"), ("navigation", "mixed"), ("other", "unknown"), (None, "x")]
    got = spark.createDataFrame(rows, "k string, v string").select(R.route_priority(F.col("k"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [0, 3, 0, 2, 4, 4, 4]


def test_links_to_lists_of_notices(spark):
    links = [(1, 1, "/tzgg/", "x"), (1, 2, "/about", "y"), (1, 3, "/tzgg/", "again"), (1, 4, "/info/2024/1234.htm", "Notice"), (1, 5, "#news", "news"), (1, 6, "/a", "NEWS list"), (2, 1, None, None)]
    df = spark.createDataFrame(links, "k int, node int, href string, label string")
    got = [(r.node, r.score) for r in R.notice_links(df, "k").orderBy("place").collect()]
    # 3 + 3 (tzgg, tzg) + 5 - 0.12; 2 + 2 - 0.04; 3 + 2 - 0.38 - 3
    assert got == [(1, 109), (6, 40), (4, 16)]
    assert R.notice_links(df.limit(0), "k").count() == 0


def test_days_in_fields_of_publication(spark):
    rows = {"发布时间：20240305": "2024-03-05", "发布于 20240305 编号 20240101": "2024-03-05", "发布时间：2024-03-05 编号 20240101": None, "编号 20240101": None,
            "发布时间：20249999": None, "发布时间：20240305 发布时间：20240306": None, "见 发布时间：20240305": None, "发布时间：202403051": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in rows], "t string").select("t", dates.compact_date(F.col("t")).cast("string").alias("d"))
    assert {r.t: r.d for r in df.collect()} == rows


def test_confidence_in_articles(spark):
    body = "x" * 120
    pages = [(1, f"<article>{body}</article>"), (2, f"<article>{body}首页 末页 登录 注册</article>"), (3, f"<article>{body}首页末页登录</article>"), (4, f"<article>{'a ' * 100}</article>"), (5, "<body>short</body>"), (6, "")]
    rows = E.elements(E.page_texts(spark.createDataFrame(pages, "k int, html string"), "k", "html"), "k")
    assert {r.k: r.confidence for r in P.article_content(rows, "k").collect()} == {1: 65, 2: 45, 3: 65, 4: 55, 5: 10}
