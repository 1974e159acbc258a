"""Which discovered links are worth fetching."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.functions.text import likely_incident
from reportmill.functions.times import instant
from reportmill.functions.urls import canonical_url
from reportmill.operators.hotkeys import first_by
from reportmill.operators.stages import compute_once


def screened(found: DataFrame, cutoff: datetime, until: datetime | None = None) -> DataFrame:
    """Adds ``link`` (canonical url) and ``reason``: undated, out_of_window, prefiltered or null."""
    outside = F.col("published_at") < instant(cutoff)
    if until is not None:
        outside = outside | (F.col("published_at") > instant(until))
    with_link = compute_once(found, {"link": canonical_url(F.col("url"))})
    reason = (
        F.when(F.col("published_at").isNull(), F.lit("undated"))
        .when(outside, F.lit("out_of_window"))
        .when(F.col("link").isNull(), F.lit("prefiltered"))
        .when(~likely_incident(F.col("title"), F.col("link")), F.lit("prefiltered"))
    )
    return compute_once(with_link, {"reason": reason})


def not_stored(rows: DataFrame, existing: DataFrame, link: str = "link") -> DataFrame:
    """Rows whose link is not among the stored reports."""
    return rows.join(existing.select(F.col("source_link").alias(link)), link, "left_anti")


def eligible(found: DataFrame, existing: DataFrame, cutoff: datetime, until: datetime | None = None) -> DataFrame:
    """Candidates to fetch: in the window, likely incidents, first of their link (by ``seq``) and not stored."""
    passing = screened(found, cutoff, until).filter(F.col("reason").isNull()).drop("reason")
    unique = first_by(passing, ["source", "link"], [F.col("seq")])
    fresh = not_stored(unique, existing)
    return fresh.withColumn("url", F.col("link")).select(*found.columns)


def eligibility_stats(found: DataFrame, existing: DataFrame, cutoff: datetime, until: datetime | None = None) -> DataFrame:
    """One row per source: discovered, undated, out_of_window, prefiltered, duplicates, existing, eligible."""
    checked = screened(found, cutoff, until)
    links = checked.groupBy("source", "reason", F.when(F.col("reason").isNull(), F.col("link")).alias("link")).agg(
        F.count("*").alias("n")
    )
    stored = existing.select(F.col("source_link").alias("link"), F.lit(True).alias("is_stored")).distinct()
    marked = links.join(stored, "link", "left")
    passed, known = F.col("reason").isNull(), F.coalesce("is_stored", F.lit(False))
    dropped = lambda r: F.sum(F.when(F.col("reason") == r, F.col("n")).otherwise(0)).alias(r)
    return marked.groupBy("source").agg(
        F.sum("n").alias("discovered"),
        dropped("undated"),
        dropped("out_of_window"),
        dropped("prefiltered"),
        F.sum(F.when(passed, F.col("n") - 1).otherwise(0)).alias("duplicates"),
        F.count_if(passed & known).alias("existing"),
        F.count_if(passed & ~known).alias("eligible"),
    )
