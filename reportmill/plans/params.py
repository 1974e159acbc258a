"""Validated query parameters that become Column predicates."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportmill.config import CATEGORY_IDS, CITY_IDS, PAGE_DEFAULT, PAGE_MAX, SOURCE_KINDS, WINDOW_DAYS
from reportmill.functions import hexgrid
from reportmill.functions.times import instant

IST = timezone(timedelta(hours=5, minutes=30))


def _day(text: str, name: str) -> date:
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text, re.ASCII):
        try:
            return date.fromisoformat(text)
        except ValueError:
            pass
    raise ValueError(f"{name} must be a valid YYYY-MM-DD date")


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.split(",") if w.strip()]


def source_kind(source_type: Column) -> Column:
    return F.when(source_type.startswith("police_"), F.lit("police")).otherwise(F.lit("news"))


@dataclass(frozen=True)
class ReportFilter:
    """City, days in India (inclusive), categories and source kinds shared by the read queries."""

    city: str
    from_day: date
    to_day: date
    categories: tuple[str, ...] = CATEGORY_IDS
    sources: tuple[str, ...] = SOURCE_KINDS

    @property
    def start(self) -> datetime:
        return datetime.combine(self.from_day, datetime.min.time(), IST)

    @property
    def end(self) -> datetime:
        return datetime.combine(self.to_day, datetime.min.time(), IST) + timedelta(days=1)

    def predicate(self) -> Column:
        """Plain comparisons on stored columns, so all of them reach the Parquet scan."""
        wanted = (
            (F.col("city") == self.city)
            & (F.col("effective_at") >= instant(self.start))
            & (F.col("effective_at") < instant(self.end))
            & F.col("category").isin(*self.categories)
        )
        if self.sources == ("police",):
            return wanted & F.col("source_type").startswith("police_")
        if self.sources == ("news",):
            return wanted & ~F.col("source_type").startswith("police_")
        return wanted


def parse_filter(query: dict[str, str], now: datetime) -> ReportFilter:
    """Reads city, from, to, categories and sources; ValueError says what is wrong."""
    city = query.get("city")
    if city not in CITY_IDS:
        raise ValueError(f"city must be one of {', '.join(CITY_IDS)}")
    today = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)).astimezone(IST).date()
    to_day = _day(query["to"], "to") if "to" in query else today
    from_day = _day(query["from"], "from") if "from" in query else to_day - timedelta(days=WINDOW_DAYS)
    if from_day > to_day:
        raise ValueError("from must be on or before to")
    named = [c for c in _words(query.get("categories", "")) if c in CATEGORY_IDS]
    categories = tuple(dict.fromkeys(named)) or CATEGORY_IDS
    sources = SOURCE_KINDS
    if "sources" in query:
        listed = _words(query["sources"])
        if not listed or any(s not in SOURCE_KINDS for s in listed):
            raise ValueError("sources must be a comma list of news, police")
        sources = tuple(s for s in SOURCE_KINDS if s in listed)
    return ReportFilter(city, from_day, to_day, categories, sources)


def parse_resolution(query: dict[str, str]) -> int:
    text = query.get("res")
    if text is None:
        return hexgrid.DEFAULT_RESOLUTION
    try:
        value = float(text)
    except ValueError:
        value = math.nan
    if not (hexgrid.MIN_RESOLUTION <= value <= hexgrid.MAX_RESOLUTION) or value != int(value):
        raise ValueError(f"res must be an integer between {hexgrid.MIN_RESOLUTION} and {hexgrid.MAX_RESOLUTION}")
    return int(value)


@dataclass(frozen=True)
class Page:
    limit: int = PAGE_DEFAULT
    offset: int = 0


def parse_page(query: dict[str, str]) -> Page:
    """Limit (clamped to 1..200) and offset; only plain digits are accepted."""
    numbers = {}
    for name, default in (("limit", PAGE_DEFAULT), ("offset", 0)):
        text = query.get(name)
        if text is not None and not re.fullmatch(r"\d+", text, re.ASCII):
            raise ValueError(f"{name} must be a non-negative integer")
        numbers[name] = default if text is None else int(text)
    return Page(min(max(numbers["limit"], 1), PAGE_MAX), numbers["offset"])


def parse_area(query: dict[str, str]) -> Column | None:
    """Predicate of ``cell`` (wins) or ``bbox``; null when neither is given."""
    if "cell" in query:
        _, resolution = hexgrid.parse_cell(query["cell"])
        return hexgrid.cell_id(F.col("city"), F.col("lat"), F.col("lng"), resolution) == query["cell"]
    if "bbox" in query:
        try:
            box = [float(x) for x in query["bbox"].split(",")]
        except ValueError:
            box = []
        if len(box) != 4 or not all(map(math.isfinite, box)):
            raise ValueError("bbox must be minLng,minLat,maxLng,maxLat")
        return F.col("lng").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    return None
