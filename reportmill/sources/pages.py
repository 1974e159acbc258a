"""Landed article pages → articles.

HTML is read by a small standard-library parser inside an Arrow-batched column function; everything after the
raw fields (precedence, dates, boilerplate, rejection) is Column work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from reportmill.functions.patterns import trimmed
from reportmill.functions.text import keyword_list
from reportmill.functions.times import parse_feed_date

# Which JSON-LD nodes count as an article, and where boilerplate begins.
ARTICLE_TYPES = ("NewsArticle", "Article", "ReportageNewsArticle", "BlogPosting")
BOILERPLATE = "You Can Also Check:"

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a b big code em font i nobr s small span strike strong tt u".split())
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_BLOCKS = frozenset("p li h1 h2 h3 h4".split())


class _Page(HTMLParser):
    """Collects what the article rules look at: meta values, titles, JSON-LD scripts and text blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # [tag, text buffer or None]
        self.meta: list[dict[str, str]] = []
        self.titles: list[list[str]] = []
        self.ld: list[list[str]] = []
        self.paragraphs: list[list[str]] = []
        self.blocks: list[list[str]] = []
        self.everything: list[str] = []

    def _close(self, tag: str, barriers: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in barriers:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in attrs}
        if tag in _ENDS_PARAGRAPH:
            self._close("p", frozenset(("table", "button", "td", "th")))
        if tag == "li":
            self._close("li", frozenset(("ul", "ol")))
        if tag == "meta":
            self.meta.append(values)
        if tag in _VOID:
            return
        buffers: list[list[str]] = []
        if tag == "title":
            self.titles.append([])
            buffers.append(self.titles[-1])
        if tag == "script" and values.get("type") == "application/ld+json":
            self.ld.append([])
            buffers.append(self.ld[-1])
        if tag in _BLOCKS:
            self.blocks.append([])
            buffers.append(self.blocks[-1])
        if tag == "p" and any(t == "article" for t, _ in self.open):
            self.paragraphs.append([])
            buffers.append(self.paragraphs[-1])
        self.open.append([tag, buffers])

    def handle_endtag(self, tag: str) -> None:
        if tag in _INLINE:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i]
                    return
        else:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.everything.append(data)
        for _, buffers in self.open:
            for buffer in buffers:
                buffer.append(data)


def _read(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    return page


def _lines(buffers: list[list[str]]) -> list[str]:
    return [t for t in ("".join(b).strip() for b in buffers) if t]


def _plain(value: object) -> str | None:
    """Entities decoded and tags dropped."""
    return None if value is None else "".join(_read(str(value)).everything).strip()


def _nodes(data: object) -> Iterator[dict]:
    if isinstance(data, list):
        for item in data:
            yield from _nodes(item)
    elif isinstance(data, dict):
        yield data
        if data.get("@graph"):
            yield from _nodes(data["@graph"])


def _keywords(value: object) -> list[str]:
    parts = [str(v) for v in value] if isinstance(value, list) else value.split(",") if isinstance(value, str) else []
    return [p.strip() for p in parts if p.strip()]


def _json_ld(page: _Page) -> dict | None:
    for script in page.ld:
        try:
            data = json.loads("".join(script))
        except ValueError:
            continue
        for node in _nodes(data):
            kinds = node.get("@type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if any(str(k) in ARTICLE_TYPES for k in kinds):
                return node
    return None


def _fields(html: str | None) -> dict:
    page = _read(html or "")
    node = _json_ld(page) or {}

    def meta(attribute: str, name: str) -> str | None:
        for values in page.meta:
            if values.get(attribute) == name:
                return values.get("content", "").strip() or None
        return None

    def first(*values):
        return next((v for v in values if v is not None), None)

    paragraphs = _lines(page.paragraphs)
    published = node.get("datePublished")
    return {
        "headline": first(_plain(node.get("headline")), meta("property", "og:title"), "".join("".join(t) for t in page.titles).strip() or None),
        "published": None if published is None else str(published),
        "meta_published": meta("property", "article:published_time"),
        "description": first(_plain(node.get("description")), meta("property", "og:description"), meta("name", "description")),
        "keywords": _keywords(node.get("keywords")) or _keywords(first(meta("name", "keywords"), meta("name", "news_keywords"))),
        "body": first(_plain(node.get("articleBody")), "\n".join(paragraphs) if paragraphs else None),
    }


_FIELDS = StructType(
    [StructField(n, StringType()) for n in ("headline", "published", "meta_published", "description", "body")]
    + [StructField("keywords", ArrayType(StringType()))]
)


@F.pandas_udf(_FIELDS)
def html_fields(html: pd.Series) -> pd.DataFrame:
    """Raw article fields of HTML pages: JSON-LD before meta tags before page elements."""
    rows = [_fields(h) for h in html]
    return pd.DataFrame(rows, columns=[f.name for f in _FIELDS])


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Text of paragraphs, list items and headings, one per line; else all text."""

    def text(h: str | None) -> str | None:
        if h is None:
            return None
        page = _read(h)
        lines = _lines(page.blocks)
        return "\n".join(lines) if lines else "".join(page.everything).strip()

    return html.map(text)


def strip_boilerplate(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, f"(?is){BOILERPLATE}.*\\z", ""))


def markdown_fields(markdown: Column) -> Column:
    """struct(title, description): the first '# ' line; the first paragraph of 80+ characters that is no heading or image."""

    def good(p: Column) -> Column:
        return (F.length(p) >= 80) & ~p.startswith("#") & ~p.startswith("![")

    paragraphs = F.transform(F.split(markdown, r"\n\s*\n"), trimmed)
    title = F.regexp_extract(markdown, r"(?m)^#\s+(.+)$", 1)
    return F.struct(
        F.when(markdown.rlike(r"(?m)^#\s+(.+)$"), trimmed(title)).alias("title"),
        F.try_element_at(F.filter(paragraphs, good), F.lit(1)).alias("description"),
    )


def parse_pages(landed: DataFrame) -> DataFrame:
    """Articles of landed pages: url, city, source_name, status, format, body, fallback_title, fallback_published_at.

    Pages without a title or a date, and failed or empty responses, give no article.
    """
    usable = landed.filter((F.col("status") == 200) & (F.col("body") != ""))
    kept = ["url", "city", "source_name", "fallback_title", "fallback_published_at"]
    passing = [c for c in landed.columns if c not in (*kept, "status", "format", "body")]
    markdown = usable.filter(F.col("format") == "markdown").withColumn("m", markdown_fields(F.col("body")))
    from_markdown = markdown.select(
        *kept, *passing,
        F.coalesce("m.title", "fallback_title").alias("title"),
        F.col("fallback_published_at").alias("published_at"),
        F.col("m.description").alias("description"),
        F.col("body").alias("text"),
        F.array().cast("array<string>").alias("keywords"),
    )
    html = usable.filter(F.col("format") != "markdown").withColumn("h", html_fields(F.col("body")))
    from_html = html.select(
        *kept, *passing,
        F.coalesce("h.headline", "fallback_title").alias("title"),
        F.coalesce(parse_feed_date(F.col("h.published")), parse_feed_date(F.col("h.meta_published")), "fallback_published_at").alias("published_at"),
        F.col("h.description").alias("description"),
        strip_boilerplate(F.coalesce("h.body", "h.description", F.lit(""))).alias("text"),
        F.col("h.keywords").alias("keywords"),
    )
    articles = from_html.unionByName(from_markdown).filter((F.col("title") != "") & F.col("published_at").isNotNull())
    return articles.select("url", "title", "published_at", "description", "text", keyword_list(F.col("keywords")).alias("keywords"), "city", "source_name", *passing)
