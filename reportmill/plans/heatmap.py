"""Map cells: how many events lie in each hexagon, and of which categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.config import CATEGORY_IDS, PRECISION_ORDER
from reportmill.functions import hexgrid
from reportmill.operators.hotkeys import ascending, first_by
from reportmill.plans.params import ReportFilter


def mappable() -> Column:
    """City-level points are never plotted."""
    return F.col("geo_precision") != "city"


def precision_rank(precision: Column) -> Column:
    """0 for the best precision; unknown values come last."""
    at = F.array_position(F.array(*map(F.lit, PRECISION_ORDER)), precision)
    return F.when(at > 0, at - 1).otherwise(len(PRECISION_ORDER))


def representatives(reports: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One report per event: police first, then the most precise point, then the earliest, then the smallest id."""
    police = F.when(F.col("source_type").startswith("police_"), 0).otherwise(1)
    order = [police, precision_rank(F.col("geo_precision")), ascending(F.col("published_datetime")), F.col("id")]
    return first_by(reports, ["event_id"], order, columns)


def count_cells(points: DataFrame, resolution: int) -> DataFrame:
    """(cell, count, categories): counted per category first, so the map side combines and a hot cell is few rows."""
    cell = hexgrid.cell_id(F.col("city"), F.col("lat"), F.col("lng"), resolution)
    per_category = points.select(cell.alias("cell"), "category").groupBy("cell", "category").agg(F.count("*").alias("n"))
    return per_category.groupBy("cell").agg(
        F.sum("n").alias("count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"),
    )


def heatmap(reports: DataFrame, filter: ReportFilter, resolution: int = hexgrid.DEFAULT_RESOLUTION) -> DataFrame:
    """Cells of the filtered reports, fullest first. Representatives are chosen after all filters."""
    points = representatives(reports.filter(filter.predicate() & mappable()), ["city", "lat", "lng", "category"])
    cells = count_cells(points, resolution)
    center = hexgrid.cell_center(F.col("cell"), resolution)
    located = cells.withColumn("at", center).select("cell", F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"), "count", "categories")
    return located.orderBy(F.desc("count"), "cell")


def heatmap_totals(cells: DataFrame) -> DataFrame:
    return cells.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.coalesce(F.max("count"), F.lit(0)).alias("max_count"))


def with_level(cells: DataFrame) -> DataFrame:
    """Density level 1-5 relative to the fullest cell; the maximum is a scalar subquery, not a global window."""
    top = cells.agg(F.max("count").alias("m")).scalar()
    level = F.greatest(F.lit(1), F.ceil(F.col("count") * 5 / top)).cast("int")
    return cells.withColumn("level", F.when((top > 0) & (F.col("count") > 0), level).otherwise(1))


def with_ring(cells: DataFrame, resolution: int) -> DataFrame:
    return cells.withColumn("ring", hexgrid.cell_ring(F.col("cell"), resolution))


def cells_bounds(cells: DataFrame, resolution: int) -> DataFrame:
    """Bounding box of all cell rings; nulls when there are no cells."""
    ring = hexgrid.cell_ring(F.col("cell"), resolution)
    lngs, lats = F.transform("ring", lambda p: p["lng"]), F.transform("ring", lambda p: p["lat"])
    boxes = cells.select(ring.alias("ring")).select(
        F.array_min(lngs).alias("a"), F.array_min(lats).alias("b"), F.array_max(lngs).alias("c"), F.array_max(lats).alias("d")
    )
    return boxes.agg(F.min("a").alias("min_lng"), F.min("b").alias("min_lat"), F.max("c").alias("max_lng"), F.max("d").alias("max_lat"))


def top_categories(cells: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` largest categories of each cell (cell, rank, category, count); ties go by taxonomy order.

    A cell has at most as many entries as there are categories, so the sort stays inside the row.
    """
    order = F.array(*map(F.lit, CATEGORY_IDS))
    ranked = F.sort_array(
        F.transform(
            F.map_entries("categories"),
            lambda e: F.struct((-e["value"]).alias("k"), F.array_position(order, e["key"]).alias("o"), e["key"].alias("category"), e["value"].alias("n")),
        )
    )
    top = cells.select("cell", F.posexplode(F.slice(ranked, 1, n)).alias("rank", "t"))
    return top.select("cell", (F.col("rank") + 1).alias("rank"), "t.category", F.col("t.n").alias("count"))
