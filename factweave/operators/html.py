"""Web page to text. A small tolerant tree builder runs per page inside an Arrow batch."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import text as tx

_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def walk(self):
        """Elements below this one in document order, without recursion."""
        stack = [iter(self.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
            elif isinstance(kid, _Node):
                yield kid
                stack.append(iter(kid.kids))

    def strings(self):
        stack = [iter(self.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
            elif isinstance(kid, _Node):
                stack.append(iter(kid.kids))
            elif kid.strip():
                yield kid.strip()

    def first(self, test):
        return next((n for n in self.walk() if test(n)), None)

    def classes(self):
        return (self.attrs.get("class") or "").split()

    def text(self, sep=""):
        return sep.join(self.strings())


class _Tree(HTMLParser):
    def __init__(self, mark=None):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.mark = mark  # stands for an ampersand that is text

    def plain(self, text):
        return text.replace(self.mark, "&") if self.mark and text else text

    def handle_starttag(self, tag, attrs):
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen[k] = self.plain(v) or ""
        node = _Node(tag, seen, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.up

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        data = self.plain(data)
        kids = self.at.kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def _parse(html: str, open_references: bool) -> _Node:
    html, mark = html or "", None
    if not open_references:
        # every ampersand that begins no closed reference is hidden from the parser behind a sign the page does not hold
        mark = next(c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in html)
        html = _REFERENCE.sub(lambda m: m[0] if m[1] in html5 else mark + (m[1] or ""), html)
    tree = _Tree(mark)
    tree.feed(html)
    tree.close()
    return tree.root


def _unwanted(node: _Node) -> bool:
    if node.tag in fixed.DROPPED_TAGS:
        return True
    marks = (" ".join(node.classes()).lower(), node.attrs.get("id", "").lower())
    return any(part in mark for mark in marks for part in fixed.DROPPED_ATTR_PARTS)


def _prune(root: _Node) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or not _unwanted(k)]
        stack.extend(k for k in node.kids if isinstance(k, _Node))


_SELECTORS = [
    lambda n: n.tag == "article",
    lambda n: n.tag == "main",
    lambda n: n.attrs.get("role") == "main",
    lambda n: "content" in n.classes(),
    lambda n: n.attrs.get("id") == "content",
]


def _content_root(root: _Node) -> _Node:
    """First selector whose text is long enough; failing that, what the last selector found, else body."""
    found = None
    for test in _SELECTORS:
        found = root.first(test)
        if found is not None and len(found.text()) > fixed.MIN_CONTENT_TEXT:
            return found
    return found or root.first(lambda n: n.tag == "body") or root


def _string_of(node: _Node | None) -> str | None:
    """Text of an element that holds a single text node."""
    while node is not None and len(node.kids) == 1:
        if isinstance(node.kids[0], str):
            return node.kids[0]
        node = node.kids[0]
    return None


def _page_parts(html: str, open_references: bool = True) -> tuple:
    root = _parse(html, open_references)
    meta = lambda key, val: root.first(lambda n: n.tag == "meta" and n.attrs.get(key) == val)
    content = lambda n: (n.attrs.get("content") or None) if n is not None else None
    og_title, author_meta = content(meta("property", "og:title")), content(meta("name", "author"))
    published, description = content(meta("property", "article:published_time")), content(meta("name", "description"))
    raw_title = _string_of(root.first(lambda n: n.tag == "title"))
    author_node = root.first(lambda n: {"author", "byline"} & set(n.classes()) or "author" in (n.attrs.get("rel") or "").split())
    date_node = root.first(lambda n: (n.tag == "time" and "datetime" in n.attrs) or {"date", "published"} & set(n.classes()))
    author = author_meta.strip() if author_meta else (author_node.text() if author_node else None)
    date = published or ((date_node.attrs.get("datetime") or date_node.text()) if date_node else None)
    _prune(root)
    kept_title = _string_of(root.first(lambda n: n.tag == "title"))
    text = _content_root(root).text("\n")
    strip = lambda v: v.strip() if v else v
    return text, kept_title, strip(og_title), strip(raw_title), author or None, date or None, strip(description)


_PARTS = ["body", "page_title", "og_title", "raw_title", "author", "published", "description"]


_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in _PARTS])


@F.pandas_udf(_SCHEMA)
def page_parts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_page_parts(h) for h in html], columns=_PARTS)


@F.pandas_udf(_SCHEMA)
def closed_page_parts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_page_parts(h, False) for h in html], columns=_PARTS)


def extract_pages(df: DataFrame, html: str = "html", open_references: bool = True) -> DataFrame:
    """Adds title, text and article metadata (meta_title, author, published_date, description).

    Character references count without their semicolon (`&amp`), as HTML has it, unless open_references is False: then only
    closed ones (`&amp;`) do and any other ampersand is text.
    """
    p = F.col("__p")
    out = df.withColumn("__p", (page_parts if open_references else closed_page_parts)(F.col(html)))
    title = tx.clean_title(F.when(F.coalesce(p["page_title"], F.lit("")) != "", p["page_title"]))
    return out.withColumns({
        "title": title,
        "text": tx.clean_whitespace(p["body"]),
        "meta_title": F.coalesce(tx.blank_to_null(p["og_title"]), tx.blank_to_null(p["raw_title"]), tx.blank_to_null(title)),
        "author": p["author"],
        "published_date": p["published"],
        "description": tx.blank_to_null(p["description"]),
    }).drop("__p")


def meaningful(text: Column) -> Column:
    return F.length(tx.strip(F.coalesce(text, F.lit("")))) >= fixed.MIN_PAGE_TEXT
