"""Pages as tables: a parser in Arrow batches gives each page's text once and a row for each element, with its place in that text.

Everything else about pages is an operation on these rows. The text of a page is all its strings, each without outer
white space, one after the other; an element's text is a stretch of it. Scripts, styles and comments are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from noticeweave.functions.html import strict

# Elements without an end, elements that aren't shown, and which open elements a start tag ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "svg", "iframe"}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

#: Characters of pages that are parsed at once.
CHARS = 1 << 19

_INT, _TEXT = T.IntegerType(), T.StringType()
ELEMENT = T.StructType()
for _name, _type in (
    ("node", _INT), ("parent", _INT), ("place", _INT), ("depth", _INT), ("last", _INT), ("tag", _TEXT), ("classes", T.ArrayType(_TEXT)), ("ident", _TEXT),
    ("href", _TEXT), ("attrs", T.MapType(_TEXT, _TEXT)), ("begin", _INT), ("end", _INT),
):
    ELEMENT.add(_name, _type)
PAGE = T.StructType().add("text", _TEXT).add("elements", T.ArrayType(ELEMENT))


class _Tree(HTMLParser):
    """Elements in order of their start tags; a stack of open ones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.parts: list[str] = []
        self.size = 0
        self.open: list[int] = []
        self.children: dict[int, int] = {}
        self.silent = 0

    def _close(self, to: int) -> None:
        while len(self.open) > to:
            row = self.rows[self.open.pop()]
            row["end"], row["last"] = self.size, len(self.rows) - 1
            self.silent -= row["tag"] in SILENT

    def _implied(self, tag: str) -> None:
        if tag in _BLOCKS:
            for i in range(len(self.open) - 1, -1, -1):
                if self.rows[self.open[i]]["tag"] == "p":
                    self._close(i)
                    break
                if self.rows[self.open[i]]["tag"] in _BLOCKS:
                    break
        for i in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[i]]["tag"]
            if name in _SCOPES.get(tag, ()):
                break
            if name in _ENDS.get(tag, ()):
                self._close(i)
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._implied(tag)
        parent = self.open[-1] if self.open else -1
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        node = len(self.rows)
        place = self.children[parent] = self.children.get(parent, -1) + 1
        self.rows.append({
            "node": node, "parent": parent, "place": place, "depth": len(self.open), "last": node, "tag": tag, "classes": sorted(set(known.get("class", "").split())),
            "ident": known.get("id", ""), "href": known.get("href", "").strip(), "attrs": known, "begin": self.size, "end": self.size,
        })
        if tag not in VOID:
            self.open.append(node)
            self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]]["tag"] == tag:
                self._close(i)
                break

    def handle_data(self, data: str) -> None:
        if not self.silent and (data := data.strip()):
            self.parts.append(data)
            self.size += len(data)


def tree(html: str | None) -> tuple[str, list[dict]]:
    """The text and the elements of a page."""
    page = _Tree()
    page.feed(strict(html))
    page.close()
    page._close(0)
    return "".join(page.parts), page.rows


def _portions(pages: pa.Array) -> Iterator[tuple[int, int]]:
    """Starts and sizes of runs of pages with about CHARS characters in all: parsed elements are Python objects of many times a page's size."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(pages), 0).to_pylist()):
        if i > at and size + n > CHARS:
            yield at, i - at
            at, size = i, 0
        size += n
    if len(pages) > at:
        yield at, len(pages) - at


def page_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, text, elements (an array) of each page: the table that others read from, best written once."""
    page = pages.select(key, F.col(html).cast("string").alias("__html"))
    schema = T.StructType([page.schema[key], *PAGE.fields])
    kind = to_arrow_schema(PAGE).field("elements").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _portions(batch.column(1)):
                some = batch.slice(at, n)
                found = [tree(h) for h in some.column(1).to_pylist()]
                made = pa.array([[e | {"attrs": list(e["attrs"].items())} for e in es] for _, es in found], kind)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([t for t, _ in found], pa.string()), made], names=[key, "text", "elements"])
                pa.default_memory_pool().release_unused()

    return page.mapInArrow(run, schema)


def elements(texts: DataFrame, key: str) -> DataFrame:
    """A row for each element, with its text, cut out before the rows are made so that none carries its page."""

    def cut(e: Column) -> Column:
        return F.struct(*(e[f.name].alias(f.name) for f in ELEMENT.fields), F.substring(F.col("text"), e["begin"] + 1, e["end"] - e["begin"]).alias("text"))

    return texts.select(key, F.explode(F.transform("elements", cut)).alias("e")).select(key, "e.*")


# What sanitised pages may have.
TAGS = {
    "a", "abbr", "b", "blockquote", "br", "caption", "code", "col", "colgroup", "dd", "del", "div", "dl", "dt", "em", "figcaption", "figure", "h1", "h2", "h3", "h4",
    "h5", "h6", "hr", "i", "img", "li", "ol", "p", "pre", "s", "small", "span", "strong", "sub", "sup", "table", "tbody", "td", "th", "thead", "tfoot", "tr", "u", "ul",
}
DROPPED = {"script", "style", "iframe", "object", "embed", "form", "svg", "math", "template", "noscript"}
ANY_ATTRIBUTES = {"title", "lang", "dir", "style"}
ATTRIBUTES = {
    "a": {"href"}, "img": {"src", "alt", "width", "height", "data-article-image-src"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan", "scope"},
    "col": {"span"}, "colgroup": {"span"}, "ol": {"start", "reversed"}, "li": {"value"},
}
SCHEMES = {"http", "https", "mailto", "tel"}
STYLES = {
    "text-align", "vertical-align", "font-weight", "font-style", "text-decoration", "white-space", "border-collapse", "border-spacing", "border-style", "border-width",
    "padding", "padding-left", "padding-right", "padding-top", "padding-bottom",
}


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.dropped = 0

    def _attribute(self, tag: str, name: str, value: str) -> str | None:
        if name not in ANY_ATTRIBUTES | ATTRIBUTES.get(tag, set()):
            return None
        if name in ("href", "src"):
            bare = "".join(c for c in value if c > " ").lower()
            scheme = bare.split(":", 1)[0] if ":" in bare.split("/", 1)[0].split("?", 1)[0].split("#", 1)[0] else ""
            return None if scheme and scheme not in SCHEMES else value
        if name == "style":
            rules = [r.strip() for r in value.split(";") if r.split(":", 1)[0].strip().lower() in STYLES and ":" in r]
            return ";".join(rules) or None
        return value

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.dropped += tag not in VOID
        if self.dropped or tag not in TAGS:
            return
        kept = {n: v for n, raw in reversed(attrs) if (v := self._attribute(tag, n, raw or "")) is not None}
        if tag == "a":
            kept |= {"target": "_blank", "rel": "noopener noreferrer"}
        self.out.append(f"<{tag}" + "".join(f' {n}="{escape(v)}"' for n, v in sorted(kept.items())) + ">")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED and self.dropped:
            self.dropped -= 1
        elif not self.dropped and tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.out.append(escape(data, quote=False))


def sanitise(html: str | None) -> str:
    """HTML with listed elements, attributes, styles and schemes only; every kept element is closed, links open apart."""
    page = _Cleaner()
    page.feed(html or "")
    page.close()
    return "".join([*page.out, *(f"</{t}>" for t in reversed(page.open))])


@F.pandas_udf(_TEXT)
def sanitised(pages: pd.Series) -> pd.Series:
    return pages.map(sanitise)
