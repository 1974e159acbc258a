"""GeoJSON features, one per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.config import GROUPS, NO_GROUP_COLOR
from reportmill.plans.heatmap import with_level, with_ring


def point_features(rows: DataFrame) -> DataFrame:
    """A point per report; rows without an id or a finite position are left out."""
    colors = F.create_map(*[F.lit(x) for g in GROUPS for x in (g.id, g.color)])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    kept = rows.filter(F.col("id").isNotNull() & finite("lat") & finite("lng"))
    properties = F.struct(
        "id", "group", F.coalesce(F.element_at(colors, F.coalesce("group", F.lit(""))), F.lit(NO_GROUP_COLOR)).alias("color"),
        F.coalesce("title", F.lit("")).alias("title"),
    )
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))
    return kept.select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def polygon_features(cells: DataFrame, resolution: int) -> DataFrame:
    """A hexagon per cell with its count, density level and categories."""
    drawn = with_ring(with_level(cells), resolution)
    ring = F.transform("ring", lambda p: F.array(p["lng"], p["lat"]))
    properties = F.struct("cell", "count", "level", "categories")
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))
    return drawn.select("cell", F.to_json(feature).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    features.select("feature").write.text(path)
