"""Articles → reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.config import TAXONOMY, Taxonomy
from reportmill.functions.text import classified, clean_description, clean_text, clean_title, likely_incident
from reportmill.functions.times import incident_time, instant
from reportmill.functions.urls import canonical_url, report_id
from reportmill.operators.places import resolve_locations
from reportmill.operators.stages import compute_once


def still_wanted(articles: DataFrame, cutoff: datetime) -> DataFrame:
    """Drops articles that turn out too old or not to be incidents once their page is read."""
    return articles.filter((F.col("published_at") >= instant(cutoff)) & likely_incident(F.col("title"), F.col("url")))


def project_articles(located: DataFrame, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """Report columns of located articles; the article text ends here. Category and date read the raw text."""
    staged = located.withColumns(
        {
            "_link": canonical_url(F.col("url")),
            "_about": F.concat("title", F.lit(" "), F.coalesce("description", F.lit(""))),
            "_when": incident_time(F.col("text"), F.col("published_at")),
        }
    ).withColumn("_at", F.col("_when.incident_at"))
    staged = compute_once(staged, {"_class": classified(F.col("_about"), taxonomy)})
    return staged.select(
        *[c for c in ("seq", "source", "unresolved") if c in located.columns],
        report_id(F.col("_link")).alias("id"),
        report_id(F.col("_link")).alias("event_id"),
        "city",
        clean_title(F.col("title")).alias("title"),
        F.col("_class.category").alias("category"),
        F.col("_class.phrase").alias("category_raw"),
        "source_name",
        F.lit("news").alias("source_type"),
        F.col("_link").alias("source_link"),
        F.col("_at").alias("incident_datetime"),
        F.when(F.col("_at").isNotNull(), F.col("_when.precision")).otherwise(F.lit("unknown")).alias("incident_datetime_precision"),
        F.col("published_at").alias("published_datetime"),
        clean_text(F.col("location.location_text")).alias("location_text"),
        F.col("location.police_station").alias("police_station"),
        F.col("location.lat").alias("lat"),
        F.col("location.lng").alias("lng"),
        F.col("location.geo_precision").alias("geo_precision"),
        clean_description(F.col("description")).alias("description"),
        F.coalesce("_at", "published_at").alias("effective_at"),
        F.col("location.in_area").alias("in_area"),
    )


def enrich_articles(
    articles: DataFrame, gazetteer: DataFrame, geocodes: DataFrame, key: str = "url", taxonomy: Taxonomy = TAXONOMY, resolve: Callable[..., DataFrame] = resolve_locations
) -> DataFrame:
    """Located, classified, dated and scrubbed reports with ``in_area``; rows outside their city carry false there.

    ``resolve`` (rows, gazetteer, geocodes, key) adds ``location`` and ``unresolved``; another resolver may be given.
    """
    none = F.lit(None)
    inputs = articles.withColumns({"location_text": none.cast("string"), "lat": none.cast("double"), "lng": none.cast("double")})
    return project_articles(resolve(inputs, gazetteer, geocodes, key), taxonomy)
