"""Re-derives stored reports after a change of rules, without fetching anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.config import TAXONOMY, Taxonomy
from reportmill.functions.text import classified, clean_text, scrub_pii
from reportmill.operators.events import assign_events
from reportmill.operators.places import generic_office, resolve_locations
from reportmill.operators.stages import compute_once, written


def _cleaned(reports: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Texts scrubbed again, and news classified again."""
    news = F.col("source_type") == "news"
    clean = reports.withColumns(
        {
            "title": scrub_pii(F.col("title")),
            "description": clean_text(F.col("description")),
            "location_text": F.when(F.coalesce("location_text", F.lit("")) != "", scrub_pii(F.col("location_text"))),
        }
    ).withColumn("_about", F.concat("title", F.lit(" "), F.coalesce("description", F.lit(""))))
    clean = compute_once(clean, {"_class": F.when(news, classified(F.col("_about"), taxonomy))})
    return clean.withColumns(
        {
            "category": F.when(news, F.col("_class.category")).otherwise(F.col("category")),
            "category_raw": F.when(news, F.col("_class.phrase")).otherwise(F.col("category_raw")),
        }
    ).drop("_about", "_class")


def rederive(reports: DataFrame, gazetteer: DataFrame, geocodes: DataFrame, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """Scrubs texts again, reclassifies news and relocates rows whose station is a generic office."""
    # Rows are told apart before the text rules, which would else run over all rows for every use of either part.
    generic = (F.coalesce("police_station", F.lit("")) != "") & generic_office(F.col("police_station"))
    offices, others = _cleaned(reports.filter(generic), taxonomy), _cleaned(reports.filter(~generic), taxonomy)
    none = F.lit(None)
    inputs = offices.select(
        "id", "city", "title", F.array().cast("array<string>").alias("keywords"), F.coalesce("description", F.lit("")).alias("text"),
        none.cast("string").alias("location_text"), none.cast("double").alias("lat"), none.cast("double").alias("lng"),
    )
    where = resolve_locations(inputs, gazetteer, geocodes, "id").select("id", F.col("location").alias("_w"))
    moved = offices.join(where, "id")
    inside = F.col("_w.in_area")
    moved = moved.withColumns(
        {
            "location_text": F.when(inside, F.col("_w.location_text")),
            "police_station": F.when(inside, F.col("_w.police_station")),
            "lat": F.when(inside, F.col("_w.lat")).otherwise(F.col("lat")),
            "lng": F.when(inside, F.col("_w.lng")).otherwise(F.col("lng")),
            "geo_precision": F.when(inside, F.col("_w.geo_precision")).otherwise(F.lit("city")),
        }
    )
    return moved.select(*reports.columns).unionByName(others)


def reprocess(reports: DataFrame, gazetteer: DataFrame, geocodes: DataFrame, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    # Grouping reads the reports several times; the text rules run once.
    return assign_events(written(rederive(reports, gazetteer, geocodes, taxonomy)))
