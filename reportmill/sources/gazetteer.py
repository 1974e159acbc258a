"""Gazetteer from raw map elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.functions.names import normalize_name
from reportmill.operators.hotkeys import first_by

OSM_ELEMENT = "city string, position int, lat double, lon double, center struct<lat double, lon double>, tags map<string, string>"


def build_gazetteer(elements: DataFrame) -> DataFrame:
    """Named police stations and places of OSM elements: English name first, plain ASCII only, five decimals.

    The first element of each (city, kind, normal name) is kept.
    """
    tags = lambda k: F.try_element_at("tags", F.lit(k))
    half_up = lambda v: F.floor(v * 100_000 + 0.5) / 100_000
    named = elements.select(
        "position", "city",
        F.coalesce(tags("name:en"), tags("name")).alias("name"),
        F.when(tags("amenity") == "police", "police_station").otherwise("locality").alias("kind"),
        F.coalesce("lat", "center.lat").alias("lat"),
        F.coalesce("lon", "center.lon").alias("lng"),
    )
    usable = named.filter(F.col("name").rlike(r"^[\x20-\x7E]+\z") & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    rounded = usable.withColumns({"lat": half_up(F.col("lat")), "lng": half_up(F.col("lng")), "_norm": normalize_name(F.col("name"))})
    return first_by(rounded, ["city", "kind", "_norm"], [F.col("position")]).select("position", "city", "name", "kind", "lat", "lng")
