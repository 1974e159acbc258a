"""What the table holds: sources, covered dates and the configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.config import CATEGORIES, CITIES, GROUPS
from reportmill.functions.times import utc_iso


def source_catalogue(reports: DataFrame) -> DataFrame:
    """Counts per city, source and type in language order (small letters before capitals)."""
    counts = reports.groupBy("city", "source_name", "source_type").agg(F.count("*").alias("count"))
    return counts.orderBy(*[F.collate(F.col(c), "UNICODE") for c in ("city", "source_name", "source_type")])


def date_range(reports: DataFrame) -> DataFrame:
    """Earliest and latest effective time; rows without one do not count."""
    return reports.agg(utc_iso(F.min("effective_at")).alias("min"), utc_iso(F.max("effective_at")).alias("max"))


def source_spans(reports: DataFrame) -> DataFrame:
    """First and last published time per source."""
    return reports.groupBy("source_name").agg(
        F.min("published_datetime").alias("first_published"), F.max("published_datetime").alias("last_published"), F.count("*").alias("count")
    )


def city_table(spark: SparkSession) -> DataFrame:
    rows = [(c.id, c.name, c.lat, c.lng, c.min_lat, c.max_lat, c.min_lng, c.max_lng) for c in CITIES]
    return spark.createDataFrame(
        rows, "id string, name string, lat double, lng double, min_lat double, max_lat double, min_lng double, max_lng double"
    )


def category_table(spark: SparkSession) -> DataFrame:
    rows = [(i, c.id, c.label, c.group) for i, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "position int, id string, label string, base_group string")


def group_table(spark: SparkSession) -> DataFrame:
    rows = [(i, g.id, g.label, g.color, g.disabled) for i, g in enumerate(GROUPS)]
    return spark.createDataFrame(rows, "position int, id string, label string, color string, disabled boolean")


def merge_group_labels(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote labels and colours win; order and the disabled flag stay local."""
    theirs = remote.select("id", F.col("label").alias("_label"), F.col("color").alias("_color"))
    return local.join(theirs, "id", "left").select(
        "position", "id", F.coalesce("_label", "label").alias("label"), F.coalesce("_color", "color").alias("color"), "disabled"
    )
