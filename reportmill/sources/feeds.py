"""Landed feeds, sitemaps and API pages → candidates.

A landed payload is one row: source, url, city, status, format, body, seq. Bodies are parsed by
Spark's XML and JSON functions, so one row is one fetched document and rows spread freely.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions.patterns import trimmed
from reportmill.functions.times import LONG_MONTHS, day_number, instant, parse_feed_date
from reportmill.functions.urls import slug_title
from reportmill.operators.hotkeys import first_by
from reportmill.sources.pages import html_to_text

_ARTICLE = "struct<url:string,title:string,published_at:timestamp,description:string,text:string,keywords:array<string>,city:string,source_name:string>"
# Items of one payload keep their order in ``seq``: payload number times this, plus position. No array has more items.
_PER_PAYLOAD = 1 << 31

RSS = "channel struct<item array<struct<title string, link string, pubDate string>>>"
SITEMAP_INDEX = "sitemap array<struct<loc string>>"
SITEMAP = "url array<struct<loc string, lastmod string>>"
SECTION_PAGE = "total bigint, items array<struct<headline string, slug string, url string, `published-at` bigint>>"
WORDPRESS = (
    "array<struct<id bigint, date_gmt string, link string, title struct<rendered string>, "
    "excerpt struct<rendered string>, content struct<rendered string>>>"
)


_CHUNK_NAME = r"(\d{4})-([A-Za-z]+)-\d+\.xml\z"
_ANY_MONTH = "any"


def _chunk_month(url: Column) -> tuple[Column, Column]:
    """(year, number of the month) in the name of a sitemap chunk, '…YYYY-Month-n.xml'; month 0 where there is none."""
    year = F.regexp_extract(url, _CHUNK_NAME, 1).try_cast("int")
    return year, F.array_position(F.array(*map(F.lit, LONG_MONTHS)), F.lower(F.regexp_extract(url, _CHUNK_NAME, 2))).cast("int")


def land(payloads: DataFrame, folder: str) -> None:
    """Adds payloads to a folder laid out by source, format and month of their sitemap chunk, as JSON lines.

    ``discover`` over that folder opens only the files of the formats its mode reads and, in a backfill, of months in its range.
    """
    year, month = _chunk_month(F.col("url"))
    named = F.when(month > 0, F.format_string("%04d-%02d", year, month)).otherwise(F.lit(_ANY_MONTH))
    payloads.withColumn("month", named).write.mode("append").partitionBy("source", "format", "month").json(folder)


def _in_months(landed: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """Payloads of a landed folder whose month overlaps the range; others have no ``month`` and all stay."""
    if "month" not in landed.columns:
        return landed
    month = F.col("month")
    return landed.filter((month == _ANY_MONTH) | month.between(f"{since:%Y-%m}", f"{until:%Y-%m}"))


def _ok(landed: DataFrame, source: str, kind: str) -> DataFrame:
    return landed.filter((F.col("source") == source) & (F.col("format") == kind) & (F.col("status") == 200))


def _xml(body: Column, schema: str) -> Column:
    # Namespace prefixes and attributes carry nothing the sources use.
    plain = F.regexp_replace(body, r"<(/?)[A-Za-z0-9_.-]+:([A-Za-z])", "<$1$2")
    return F.from_xml(plain, schema, {"ignoreSurroundingSpaces": "true", "mode": "PERMISSIVE", "excludeAttribute": "true"})


def _items(landed: DataFrame, items: Column) -> DataFrame:
    spread = landed.withColumn("_items", items).select("source", F.col("city").alias("_city"), "seq", F.posexplode("_items").alias("_at", "item"))
    return spread.withColumn("seq", F.col("seq") * _PER_PAYLOAD + F.col("_at")).drop("_at")


def _candidates(rows: DataFrame, url: Column, title: Column, published: Column, city: Column, article: Column | None = None) -> DataFrame:
    return rows.select(
        "seq", "source",
        F.coalesce(url, F.lit("")).alias("url"),
        F.coalesce(title, F.lit("")).alias("title"),
        published.alias("published_at"),
        city.alias("city"),
        (article if article is not None else F.lit(None).cast(_ARTICLE)).alias("article"),
    )


def _within(since: datetime, until: datetime) -> Column:
    return F.col("published_at").between(instant(since), instant(until))


@dataclass(frozen=True)
class Source:
    """A news site: how its landed payloads become candidates, and how its links are told apart."""

    id: str
    name: str
    cities: tuple[str, ...]
    discover: Callable[[DataFrame, "Source", str, datetime, datetime], DataFrame]
    base: str = ""
    # Pattern whose first group is the city, or a path all wanted links contain.
    city_pattern: str = ""
    path: str = ""
    article_mark: str = ""
    # Pages of one list overlap: of several items with one address the first counts.
    repeats: bool = False

    def city_of(self, url: Column, landed_city: Column) -> Column:
        if self.city_pattern:
            return F.nullif(F.regexp_extract(url, self.city_pattern, 1), F.lit(""))
        return F.lit(self.cities[0])

    def wanted(self, url: Column) -> Column:
        keep = F.lit(True)
        for part in (self.path, self.article_mark):
            if part:
                keep = keep & url.contains(part)
        return keep


def rss_items(landed: DataFrame, source: Source, since: datetime, until: datetime) -> DataFrame:
    """Items of RSS feeds; a feed of one city keeps only that city's links."""
    rows = _items(_ok(landed, source.id, "rss"), _xml(F.col("body"), RSS)["channel"]["item"])
    url = F.col("item.link")
    city = source.city_of(url, F.col("_city"))
    rows = rows.filter(city == F.coalesce("_city", city))
    if source.path:
        rows = rows.filter(url.contains(source.path))
    return _candidates(rows, url, F.col("item.title"), parse_feed_date(F.col("item.pubDate")), city).filter(_within(since, until))


def sitemap_chunks(landed: DataFrame, source: Source, since: datetime, until: datetime) -> DataFrame:
    """(source, loc) of sitemap chunks whose month in '…YYYY-Month-n.xml' overlaps the range: prunes what is read."""
    rows = _items(_ok(landed, source.id, "sitemap_index"), _xml(F.col("body"), SITEMAP_INDEX)["sitemap"])
    loc = trimmed(F.col("item.loc"))
    year, month = _chunk_month(loc)
    months = rows.select("source", "seq", loc.alias("loc"), year.alias("y"), month.alias("m")).filter("m > 0")
    start = F.timestamp_seconds(day_number(F.col("y"), F.col("m"), F.lit(1)) * 86_400)
    next_y, next_m = F.when(F.col("m") == 12, F.col("y") + 1).otherwise(F.col("y")), F.when(F.col("m") == 12, 1).otherwise(F.col("m") + 1)
    end = F.timestamp_seconds(day_number(next_y, next_m, F.lit(1)) * 86_400)
    return months.filter((start < instant(until)) & (end > instant(since))).select("source", "seq", "loc")


def sitemap_links(landed: DataFrame, source: Source, since: datetime, until: datetime) -> DataFrame:
    """Links of sitemap chunks; the headline comes from the address."""
    rows = _items(_ok(_in_months(landed, since, until), source.id, "sitemap"), _xml(F.col("body"), SITEMAP)["url"])
    url = trimmed(F.col("item.loc"))
    city = source.city_of(url, F.col("_city"))
    kept = rows.filter(city.isNotNull() & source.wanted(url))
    return _candidates(kept, url, slug_title(url), parse_feed_date(F.col("item.lastmod")), city).filter(_within(since, until))


def month_names(since: Column, until: Column) -> Column:
    """Array of struct(year, month): every month from that of ``since`` that begins by ``until``."""
    months = F.sequence(F.trunc(since, "MM"), F.to_date(until), F.expr("interval 1 month"))
    name = lambda m: F.element_at(F.array(*map(F.lit, LONG_MONTHS)), F.month(m))
    return F.transform(months, lambda m: F.struct(F.year(m).alias("year"), name(m).alias("month")))


def month_list(spark: SparkSession, since: datetime, until: datetime) -> DataFrame:
    """(year, month name) of the monthly sitemaps to read."""
    return spark.range(1).select(F.inline(month_names(instant(since), instant(until))))


def section_items(landed: DataFrame, source: Source) -> DataFrame:
    """Items of paged section JSON."""
    rows = _items(_ok(landed, source.id, "section"), F.from_json("body", SECTION_PAGE)["items"])
    slug = F.col("item.slug")
    from_slug = F.when(F.coalesce(slug, F.lit("")) != "", F.concat(F.lit(source.base + "/"), F.regexp_replace(slug, "^/", "")))
    url = F.coalesce(F.col("item.url"), from_slug, F.lit(""))
    millis = F.col("item")["published-at"]
    published = F.when(millis != 0, F.timestamp_millis(millis))
    return _candidates(rows, url, F.col("item.headline"), published, F.lit(source.cities[0])).filter("url != ''")


def wordpress_posts(landed: DataFrame, source: Source) -> DataFrame:
    """Posts of the WordPress API; they bring their full article."""
    rows = _items(_ok(landed, source.id, "wordpress"), F.from_json("body", WORDPRESS))
    city = F.lit(source.cities[0])
    staged = rows.select(
        "seq", "source",
        F.col("item.link").alias("url"),
        html_to_text(F.col("item.title.rendered")).alias("title"),
        parse_feed_date(F.concat("item.date_gmt", F.lit("Z"))).alias("published_at"),
        F.nullif(html_to_text(F.col("item.excerpt.rendered")), F.lit("")).alias("description"),
        html_to_text(F.col("item.content.rendered")).alias("text"),
    )
    article = F.struct(
        "url", "title", "published_at", "description", "text", F.array().cast("array<string>").alias("keywords"),
        city.alias("city"), F.lit(source.name).alias("source_name"),
    )
    return _candidates(staged, F.col("url"), F.col("title"), F.col("published_at"), city, article)


def _by_feed_or_sitemap(landed: DataFrame, source: Source, mode: str, since: datetime, until: datetime) -> DataFrame:
    return rss_items(landed, source, since, until) if mode == "live" else sitemap_links(landed, source, since, until)


def _by_section(landed: DataFrame, source: Source, mode: str, since: datetime, until: datetime) -> DataFrame:
    return section_items(landed, source)


def _by_wordpress(landed: DataFrame, source: Source, mode: str, since: datetime, until: datetime) -> DataFrame:
    return wordpress_posts(landed, source)


# The sites, their link shapes and cities. Other sources can be passed to ``discover``.
SOURCES = (
    Source("toi", "Times of India", ("delhi", "bengaluru", "goa"), _by_feed_or_sitemap,
           city_pattern=r"/city/(delhi|bengaluru|goa)/", article_mark="/articleshow/"),
    Source("ht", "Hindustan Times", ("delhi",), _by_feed_or_sitemap, path="/cities/delhi-news/"),
    Source("dh", "Deccan Herald", ("bengaluru",), _by_section, base="https://www.deccanherald.com", repeats=True),
    Source("goemkarponn", "Goemkarponn", ("goa",), _by_wordpress),
)


def items_of(landed: DataFrame, mode: str, since: datetime, until: datetime, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """Candidates of all sources, row by row, so ``landed`` may be a stream. ``mode`` is 'live' (feeds) or 'backfill' (sitemaps)."""
    parts = [s.discover(landed, s, mode, since, until) for s in sources]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_items(found: DataFrame, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """Of the items with one address the first by ``seq``, for sources that repeat theirs."""
    repeating = F.col("source").isin(*[s.id for s in sources if s.repeats])
    firsts = first_by(found.filter(repeating), ["source", "url"], [F.col("seq")]).select(*found.columns)
    return found.filter(~repeating).unionByName(firsts)


def discover(landed: DataFrame, mode: str, since: datetime, until: datetime, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """Candidates of all sources together."""
    return first_items(items_of(landed, mode, since, until, sources), sources)
