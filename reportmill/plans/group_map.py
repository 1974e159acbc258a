"""The group map: one report per event, group counts, latest reports and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.config import CATEGORIES, GROUPS, Taxonomy, TAXONOMY
from reportmill.functions.text import group_of, label_of
from reportmill.functions.times import to_ist
from reportmill.operators.hotkeys import descending, first_by
from reportmill.operators.stages import compute_once
from reportmill.plans.heatmap import mappable


def with_group(reports: DataFrame, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """Adds the derived display group (null for none)."""
    return compute_once(reports, {"group": group_of(F.col("category"), F.col("title"), F.col("description"), taxonomy)})


def derive(reports: DataFrame) -> DataFrame:
    """Grouped rows, one per event, with ``on_map``: mapped events, and city-level ones that are not on the map.

    One pass picks both: a mapped row of an event comes before its city-level ones, then the highest score wins (police 10,
    precision 3-2-1-0), then the newest, then the smallest id.
    """
    event = F.coalesce(F.nullif("event_id", F.lit("")), F.col("id"))
    police = F.when(F.col("source_type").startswith("police_"), 10).otherwise(0)
    points = {"address": 3, "police_station": 2, "locality": 1}
    precision = F.coalesce(*[F.when(F.col("geo_precision") == k, v) for k, v in points.items()], F.lit(0))
    order = [~mappable(), -(police + precision), descending(F.col("effective_at")), F.col("id")]
    grouped = with_group(reports.filter(mappable().isNotNull())).filter(F.col("group").isNotNull()).withColumn("_event", event)
    return first_by(grouped, ["_event"], order).withColumn("on_map", mappable()).select(*reports.columns, "group", "on_map")


def in_group(rows: DataFrame, group: str | None) -> DataFrame:
    return rows if group is None else rows.filter(F.col("group") == group)


def group_counts(derived: DataFrame) -> DataFrame:
    """Mapped events per group, zero-filled in display order, and the total as 'all'.

    Conditional counts over the fixed group list: one pass, one row, no join with a dimension.
    """
    on_map = derived.filter("on_map")
    counts = on_map.agg(*[F.count_if(F.col("group") == g.id).alias(g.id) for g in GROUPS], F.count("*").alias("all"))
    names = ["all", *[g.id for g in GROUPS]]
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("group"), F.col(n).alias("count")) for i, n in enumerate(names)])
    return counts.select(F.explode(pairs).alias("c")).select("c.*")


def city_level_count(derived: DataFrame, group: str | None = None) -> DataFrame:
    return in_group(derived.filter("not on_map"), group).agg(F.count("*").alias("count"))


def latest(derived: DataFrame, n: int = 12) -> DataFrame:
    """Newest mapped reports; rows without a usable time last."""
    return derived.filter("on_map").orderBy(F.desc_nulls_last("effective_at"), "id").limit(n)


def visible(derived: DataFrame, group: str | None = None) -> DataFrame:
    """Mapped and city-level rows of the group, newest first."""
    return in_group(derived, group).orderBy(F.desc_nulls_last("effective_at"), "id")


def display(rows: DataFrame) -> DataFrame:
    """Text columns of a report card: dates as precise as known, notes, badge, labels, place."""
    day = lambda c: F.date_format(to_ist(F.col(c)), "d MMM yyyy")
    clock = F.date_format(to_ist(F.col("incident_datetime")), "d MMM yyyy, h:mm a")
    precision = F.col("incident_datetime_precision")
    category_labels = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c.id, c.label)])
    place = F.coalesce(F.nullif("location_text", F.lit("")), F.lit("Unknown location"))
    other_station = (F.coalesce("police_station", F.lit("")) != "") & ~F.col("police_station").eqNullSafe(F.col("location_text"))
    return rows.select(
        "id",
        F.coalesce(
            F.when(precision == "exact", clock)
            .when(precision == "date", day("incident_datetime"))
            .when(precision == "date_range", F.concat(day("incident_datetime"), F.lit(" (night of)"))),
            F.lit(""),
        ).alias("incident"),
        day("published_datetime").alias("published"),
        F.coalesce(day("effective_at"), F.lit("")).alias("shown_date"),
        F.when(F.col("geo_precision") == "address", "exact address")
        .when(F.col("geo_precision") == "police_station", "police station area")
        .when(F.col("geo_precision") == "locality", "approximate: locality centre")
        .otherwise("")
        .alias("precision_note"),
        F.when(F.col("source_type") == "news", "News").otherwise("Police").alias("badge"),
        F.coalesce(F.element_at(category_labels, F.col("category")), label_of(F.coalesce("category", "category_raw"))).alias("category_label"),
        F.when(other_station, F.concat(place, F.lit(" · "), F.col("police_station"))).otherwise(place).alias("place"),
    )
