"""Checked ingest of report rows, weighted summaries and the run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.config import CITY_IDS, SOURCE_TYPES
from reportmill.functions.times import instant, window_start
from reportmill.functions.urls import is_http_url

# Map layer and weight of the weighted categories; any other weighs 1 on the safety layer.
CATEGORY_LAYERS = {
    "sexual_crime": ("safety", 5),
    "road_accident": ("safety", 2),
    "murder": ("safety", 5),
    "kidnapping": ("safety", 4),
    "cyber_fraud": ("fraud", 3),
    "robbery": ("safety", 4),
    "assault": ("safety", 3),
    "fraud": ("fraud", 2),
    "drugs": ("safety", 2),
    "burglary_theft": ("safety", 2),
}


def validated(rows: DataFrame, now: datetime) -> DataFrame:
    """Adds ``error``: the first problem of a report row, null when it is acceptable."""
    bad_text = lambda c, n: F.coalesce(F.col(c), F.lit("")) == "" if n is None else F.length(c) > n
    outside = lambda c, r: F.coalesce(~F.col(c).between(-r, r), F.lit(False))
    link = F.coalesce("source_link", F.lit(""))
    return rows.withColumn(
        "error",
        F.when(~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)), "unknown source_type")
        .when(bad_text("source_name", None) | bad_text("source_name", 200), "bad source_name")
        .when(~is_http_url(link) | (F.length(link) > 2000), "bad source_link")
        .when(bad_text("title", None), "title is required")
        .when(bad_text("title", 500), "title is too long")
        .when(bad_text("description", 5000), "description is too long")
        .when(F.col("published_datetime").isNull(), "published_datetime is required")
        .when(~F.coalesce(F.col("city").isin(*CITY_IDS), F.lit(False)), "unknown city")
        .when(bad_text("location_text", 300), "location_text is too long")
        .when(outside("lat", 90) | outside("lng", 180), "bad position")
        .when(F.col("published_datetime") < instant(window_start(now)), "published_datetime outside the window"),
    )


def ingest_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy(F.coalesce("error", F.lit("accepted")).alias("result")).agg(F.count("*").alias("n"))


def run_log_entry(stats: DataFrame, mode: str, started: datetime, finished: datetime) -> DataFrame:
    """One log row per source and city of a collect run; append it to the log table."""
    counters = F.to_json(F.struct(*[c for c in stats.columns if c not in ("source", "city")]))
    return stats.select(
        "source", "city", F.lit(mode).alias("mode"), instant(started).alias("started_at"), instant(finished).alias("finished_at"), counters.alias("stats")
    )


def _weight(category: Column) -> Column:
    pairs = [F.lit(x) for k, (_, w) in CATEGORY_LAYERS.items() for x in (k, w)]
    return F.coalesce(F.element_at(F.create_map(*pairs), category), F.lit(1))


def _layer(category: Column) -> Column:
    pairs = [F.lit(x) for k, (v, _) in CATEGORY_LAYERS.items() for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), category), F.lit("safety"))


def square_bins(reports: DataFrame, size: float) -> DataFrame:
    """Weighted counts on a square grid of ``size`` degrees, placed at the middle of each square."""
    bins = reports.groupBy(F.floor(F.col("lat") / size).alias("i"), F.floor(F.col("lng") / size).alias("j")).agg(
        F.count("*").alias("count"), F.sum(_weight(F.col("category"))).alias("weight")
    )
    middle = lambda c: F.round((F.col(c) + 0.5) * size, 6)
    return bins.select(middle("i").alias("lat"), middle("j").alias("lng"), "count", "weight")


def layer_totals(reports: DataFrame) -> DataFrame:
    """Reports and weight per map layer."""
    return reports.groupBy(_layer(F.col("category")).alias("layer")).agg(
        F.count("*").alias("count"), F.sum(_weight(F.col("category"))).alias("weight")
    )
