"""The table of elements, sanitising, and what is read from pages, on small pages written here."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeweave.functions import elements as E
from noticeweave.functions.html import page_text, parse, resolve
from noticeweave.functions.scalars import _byte_pieces
from noticeweave.operators import pages as P


def test_tree():
    text, rows = E.tree("<ul><li>a<li>b <b>c</b></ul><p>one<p>two<div>x</div><br/><td>no row</td><script>if (a<b) '</p>'</script>&lt;z")
    assert text == "abconetwoxno row<z"
    by = {(r["tag"], r["place"]): r for r in rows}
    lis = [r for r in rows if r["tag"] == "li"]
    assert [text[r["begin"] : r["end"]] for r in lis] == ["a", "bc"] and lis[0]["parent"] == lis[1]["parent"] == 0
    ps = [r for r in rows if r["tag"] == "p"]
    assert [text[r["begin"] : r["end"]] for r in ps] == ["one", "two"] and all(r["depth"] == 0 for r in ps)
    assert by["script", 6]["begin"] == by["script", 6]["end"]
    assert E.tree(None) == ("", []) and E.tree("</p></div>x")[0] == "x"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "<a href='x'>", "</a>", "<br>", "text", " ", "<!-- c -->", "<script>", "</script>", "<td>", "<", "&amp;"]), max_size=40))
def test_trees_are_nested(parts):
    text, rows = E.tree("".join(parts))
    for i, r in enumerate(rows):
        assert r["node"] == i and r["parent"] < i <= r["last"] < len(rows) and 0 <= r["begin"] <= r["end"] <= len(text)
        if r["parent"] >= 0:
            above = rows[r["parent"]]
            assert r["last"] <= above["last"] and above["begin"] <= r["begin"] and r["end"] <= above["end"] and r["depth"] == above["depth"] + 1
    clean = E.sanitise("".join(parts))
    assert "<script" not in clean and E.sanitise(clean) == clean


@given(st.text(max_size=60), st.integers(4, 12))
def test_byte_pieces(text, limit):
    text = text.encode("utf-8", "replace").decode()
    pieces = _byte_pieces(text, limit)
    assert "".join(pieces) == text and all(len(p.encode()) <= limit for p in pieces)


def test_sanitise():
    assert E.sanitise('<a href="HTTPS://x" onclick="y">t') == '<a href="HTTPS://x" rel="noopener noreferrer" target="_blank">t</a>'
    assert "href" not in E.sanitise('<a href=" jAvascript:x">t</a>') and "style" not in E.sanitise('<p style="position:fixed">x</p>')
    assert E.sanitise('<p style="text-align: left; color: red">x<iframe>y</iframe></p>') == '<p style="text-align: left">x</p>'
    assert E.sanitise(None) == "" and E.sanitise("a<object><p>b</p></object>c") == "ac"


def test_resolve():
    assert resolve("https://a.example/x/y", "http:a.example/z") == "http://a.example/z" and resolve("https://a.example/x", "http:/a.example/z") == "http://a.example/z"
    assert resolve("https://a.example/x", "http:b.example/z") == "" and resolve("https://a.example/x/y", "https:z") == "https://a.example/x/z"
    assert resolve("https://a.example/x", "#/r") == "https://a.example/x#/r" and resolve("https://a.example/x", "#top") == ""


def pages(spark, *html):
    df = spark.createDataFrame(list(enumerate(html)), "k long, html string")
    return E.elements(E.page_texts(df, "k", "html"), "k")


def test_articles_by_each_method(spark):
    words = "Some words of an article that go on. " * 8
    rows = pages(
        spark, f"<body><div id=x>{words}</div><div class=content>{words}more</div></body>", f"<body><nav>{words}</nav><section><div>{words}<i>1</i></div></section></body>",
        "<body>short</body>", f"<body><div class=sidebar>{words}</div><div>{'<a href=x>link link</a>' * 40}</div></body>", "",
    )
    got = {r.k: (r.method, r.text, r.confidence) for r in P.article_content(rows, "k", "#x, .none").collect()}
    assert got[0][0] == "configured_selector" and got[0][1] == words.strip() and got[0][2] == 60
    assert got[1][0] == "text_density" and got[1][1].startswith("Some words") and "1" in got[1][1]
    assert got[2] == ("body_fallback", "short", 10) and got[3][0] == "body_fallback" and 4 not in got
    plain = {r.k: r.method for r in P.article_content(rows, "k").collect()}
    assert plain[0] == "semantic_match"


def test_navigation_levels_and_other_next_pages(spark):
    menu = "<div role=navigation><ul><li><a href=/a>A</a><ul><li><a href=/b>B</a></li><li><a href=/c>C</a></li></ul></li><li><a href=/d>D</a></li></ul></div>"
    rows = pages(spark, menu + "<link rel=next href=/p2><a href=/p3>next</a>", "<nav><a href=/x>X</a></nav><a href=q>Next page</a>")
    assert {(r.k, r.label, r.level) for r in P.navigation(rows, "k").collect()} == {(0, "A", 1), (0, "B", 2), (0, "C", 2), (0, "D", 1)}
    assert {r.k: r.href for r in P.next_page(rows, "k").collect()} == {0: "/p2", 1: "q"}
    assert P.select_nodes(rows, "k", "ul ul a").count() == 2 and P.select_nodes(rows, "k", "[role=navigation]").count() == 1


def test_only_navigation(spark):
    rows = pages(spark, "<body><nav>Menu of all things <a href=x>Link</a></nav><p>x</p></body>", "<body><nav>Menu</nav><p>A text that is longer</p></body>", "<body></body>")
    assert {r.k: r.only for r in P.only_navigation(rows, "k").collect()} == {0: True, 1: False, 2: True}


def test_dates_of_static_notices(spark):
    two = "<li><a href=/1>A title of a notice</a> 2024-03-05</li><li><a href=/2>Another title of one</a></li>"
    rows = pages(spark, f"<ul>{two}</ul>", "<div>2024-01-01 <p><a href=/3>Title with its own 2024-02-02</a></p></div><nav><a href=/4>Navigation title 2024-02-02</a></nav>")
    got = {(r.k, r.href): str(r.date) for r in P.static_notices(rows, "k").collect()}
    assert got == {(0, "/1"): "2024-03-05", (1, "/3"): "2024-02-02"}
    assert rows.where(F.col("text").isNull()).count() == 0


def test_only_ended_references_are_any(spark):
    # titles cut within a reference, as landed pages have them
    assert E.tree("<p>a &amp; b &amp</p>")[0] == "a & b &amp" and E.tree("<p>&notit; &#65;&#65 &x &lt")[0] == "&notit; A&#65 &x &lt"
    assert E.tree("<a href='?a=1&copy=2&amp;b'>x</a>")[1][0]["href"] == "?a=1&copy=2&b"
    assert parse("<h1>x &&&amp</h1>").heading == "x &&&amp"
    found = spark.createDataFrame([("<h1>R&amp;D &amp</h1>",)], "h string").select(page_text("h").alias("p")).first().p
    assert (found.heading, found.body) == ("R&D &amp", "R&D &amp")


def test_pages_are_parsed_in_portions(spark):
    sizes = [0, 5, E.CHARS, E.CHARS - 1, 3, 1, 2]
    found = list(E._portions(pa.array([None, *("x" * n for n in sizes)])))
    assert found == [(0, 3), (3, 1), (4, 1), (5, 3)] and not list(E._portions(pa.array([], pa.string())))
    page = "<p class='b a' id=i>x &amp; y<br><a href=/z title=t>z</a></p>"
    got = E.page_texts(spark.createDataFrame([(1, page * 3), (2, None)], "k long, html string").coalesce(1), "k", "html").collect()
    text, rows = E.tree(page * 3)
    assert [(r.k, r.text, [e.asDict() for e in r.elements]) for r in got] == [(1, text, rows), (2, "", [])]
