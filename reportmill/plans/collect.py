"""Ingest of landed news: candidates → eligible → sampled → articles → reports → merged table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.functions.times import window_start
from reportmill.functions.urls import canonical_url
from reportmill.operators.eligibility import eligible
from reportmill.operators.enrich import enrich_articles, still_wanted
from reportmill.operators.sampling import sample_with_refill
from reportmill.operators.upsert import merge_reports
from reportmill.schemas import REPORT
from reportmill.sources.pages import parse_pages


@dataclass(frozen=True)
class Collected:
    """``merged`` is the new table; ``tried`` has one row per sampled candidate with its outcome and round."""

    merged: DataFrame
    tried: DataFrame
    stats: DataFrame


def choose_article(picks: DataFrame, landed: DataFrame) -> DataFrame:
    """Attaches each pick's article: the one discovery brought, else the parsed page of its address.

    Only the pages of picks without an article are parsed.
    """
    needed = picks.filter(F.col("article").isNull()).select("url").distinct()
    pages = landed.withColumn("url", canonical_url(F.col("url"))).join(needed, "url", "left_semi")
    parsed = parse_pages(pages)
    article = F.struct("url", "title", "published_at", "description", "text", "keywords", "city", "source_name")
    one_page = parsed.groupBy("url").agg(F.max(article).alias("_page"))
    joined = picks.join(one_page, "url", "left")
    return joined.withColumn("article", F.coalesce("article", "_page")).select(*picks.columns)


def outcomes(picks: DataFrame, landed: DataFrame, gazetteer: DataFrame, geocodes: DataFrame, cutoff: datetime) -> DataFrame:
    """(source, city, seq, outcome, report) of the picks."""
    base = choose_article(picks, landed).checkpoint()
    articles = base.filter(F.col("article").isNotNull()).select("source", "seq", "article.*", F.col("url").alias("_url"), F.col("city").alias("_city"))
    articles = articles.withColumns({"url": F.col("_url"), "city": F.col("_city")}).drop("_url", "_city")
    wanted = still_wanted(articles, cutoff).withColumn("_key", F.concat_ws("|", "source", "seq")).checkpoint()
    rows = enrich_articles(wanted, gazetteer, geocodes, "_key")
    columns = [c.split()[0] for c in REPORT.split(",")]
    rows = rows.select("source", "seq", "in_area", F.struct(*columns).alias("report"))
    joined = base.select("source", "city", "seq", F.col("article").isNotNull().alias("_fetched")).join(rows, ["source", "seq"], "left")
    outcome = (
        F.when(~F.col("_fetched"), F.lit("failed"))
        .when(F.col("in_area").isNull(), F.lit("rejected"))
        .when(~F.col("in_area"), F.lit("out_of_area"))
        .otherwise(F.lit("stored"))
    )
    return joined.select("source", "city", "seq", outcome.alias("outcome"), "report")


def collection_stats(found: DataFrame, pool: DataFrame, tried: DataFrame) -> DataFrame:
    """Per source and city: discovered, candidates, fetched, stored, out_of_area, rejected, failed."""
    tally = lambda df, name: df.groupBy("source", "city").agg(F.count("*").alias(name))
    named = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    results = tried.groupBy("source", "city").agg(
        F.count_if(F.col("outcome") != "failed").alias("fetched"), *[named(o) for o in ("stored", "out_of_area", "rejected", "failed")]
    )
    joined = tally(found, "discovered").join(tally(pool, "candidates"), ["source", "city"], "left").join(results, ["source", "city"], "left")
    return joined.fillna(0)


def collect(
    found: DataFrame, landed: DataFrame, existing: DataFrame, gazetteer: DataFrame, geocodes: DataFrame, now: datetime, per_city: int = 55
) -> Collected:
    """The whole ingest over landed data. ``found`` are candidates of all sources, ``landed`` the fetched pages (see sources.pages)."""
    cutoff = window_start(now)
    pool = eligible(found, existing, cutoff, now).checkpoint()
    tried = sample_with_refill(
        pool, ["source", "city"], per_city, "published_at", "seq",
        lambda picks: outcomes(picks, landed, gazetteer, geocodes, cutoff),
    )
    fresh = tried.filter(F.col("outcome") == "stored").select("seq", "report.*")
    return Collected(merge_reports(existing, fresh), tried, collection_stats(found, pool, tried))
