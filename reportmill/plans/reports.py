"""Report lists: filtered pages, keyset pages and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions import hexgrid
from reportmill.plans.heatmap import mappable
from reportmill.plans.params import Page, ReportFilter


def matching(reports: DataFrame, filter: ReportFilter, area: Column | None = None) -> DataFrame:
    rows = reports.filter(filter.predicate())
    return rows if area is None else rows.filter(area)


def report_page(reports: DataFrame, filter: ReportFilter, page: Page = Page(), area: Column | None = None) -> DataFrame:
    """One page, newest effective time first, then id. Sort, offset and limit become one distributed top-k."""
    rows = matching(reports, filter, area)
    return rows.orderBy(F.desc("effective_at"), "id").offset(page.offset).limit(page.limit)


def report_total(reports: DataFrame, filter: ReportFilter, area: Column | None = None) -> DataFrame:
    """Number of matching rows before paging."""
    return matching(reports, filter, area).agg(F.count("*").alias("total"))


def keyset_page(rows: DataFrame, key: str, before: object | None, limit: int) -> DataFrame:
    """The page after ``before`` in descending key order: deep pages cost no more than the first."""
    later = rows if before is None else rows.filter(F.col(key) < F.lit(before))
    return later.orderBy(F.desc(key)).limit(limit)


def area_counts(reports: DataFrame, limit: int | None = 300) -> DataFrame:
    """Areas (location texts of mappable reports) with their counts, most reports first."""
    named = reports.filter(mappable() & (F.coalesce("location_text", F.lit("")) != ""))
    counts = named.groupBy(F.col("location_text").alias("name")).agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), "name")
    return ordered if limit is None else ordered.limit(limit)


def search_areas(areas: DataFrame, text: str) -> DataFrame:
    """Areas whose name contains the text, ignoring case."""
    return areas.filter(F.lower("name").contains(text.strip().lower()))


def in_area(reports: DataFrame, area: str) -> DataFrame:
    return reports.filter(mappable() & (F.col("location_text") == area))


def area_cells(reports: DataFrame, area: str, resolution: int) -> DataFrame:
    """Distinct cells of an area's reports."""
    cell = hexgrid.cell_id(F.col("city"), F.col("lat"), F.col("lng"), resolution)
    return in_area(reports, area).select(cell.alias("cell")).distinct()


def cell_summary(reports: DataFrame, resolution: int) -> DataFrame:
    """Per cell: how many mappable reports it holds and the place name of the newest one."""
    cell = hexgrid.cell_id(F.col("city"), F.col("lat"), F.col("lng"), resolution)
    newest = F.struct(-F.unix_micros("effective_at"), "id")
    return reports.filter(mappable()).groupBy(cell.alias("cell")).agg(
        F.count("*").alias("count"), F.min_by(F.struct("location_text"), newest).alias("first")
    ).select("cell", "count", F.col("first.location_text").alias("around"))


def selected(rows: DataFrame, ids: DataFrame, group: str | None = None) -> DataFrame:
    """Rows whose id is selected and that the group filter still shows."""
    kept = rows.join(ids.select("id").distinct(), "id", "left_semi")
    return kept if group is None else kept.filter(F.col("group") == group)
