"""Read queries over the report table, with their SQL forms."""

from __future__ import annotations

import math


from pyspark.sql import functions as F

from reportmill.catalog import bindings as B
from reportmill.config import CATEGORIES, CATEGORY_IDS, CITIES, GROUPS, PRECISION_ORDER, STAY_WORDS, TRANSPORT_WORDS
from reportmill.functions import hexgrid
from reportmill.functions.names import haversine_km
from reportmill.functions.text import group_of, label_of
from reportmill.operators.places import in_city
from reportmill.plans import group_map, heatmap, meta, reports
from reportmill.plans.ingest_rows import CATEGORY_LAYERS, ingest_counts, square_bins, validated
from reportmill.plans.params import Page, ReportFilter, parse_area, parse_filter, parse_page
from reportmill.sources.geojson import point_features, polygon_features
from reportmill.sources.tables import export_reports_json, in_window, load_reports_json, read_reports, write_reports
from reportmill.session import scratch_dir

RES = 8
_FILTER = {"city": "delhi", "from": "2024-01-03", "to": "2024-01-27"}
_NEWS_FILTER = {"city": "goa", "from": "2024-01-05", "to": "2024-01-20", "sources": "news", "categories": "fraud,robbery,assault,nonsense"}
_BBOX = "77.0,28.45,77.3,28.8"


def _filter(query: dict[str, str] = _FILTER) -> ReportFilter:
    return parse_filter(query, B.NOW)


def _d(value: float) -> str:
    """A double literal."""
    return f"{value:.17e}"


def _when_city(value) -> str:
    return "CASE city " + " ".join(f"WHEN '{c.id}' THEN {_d(value(c))}" for c in CITIES) + " END"


def _filter_sql(f: ReportFilter) -> str:
    start, end = (f"TIMESTAMP '{d.isoformat()}' - INTERVAL 330 MINUTE" for d in (f.from_day, f.to_day))
    kinds = {"news": "source_type NOT LIKE 'police_%'", "police": "source_type LIKE 'police_%'"}
    kind = " OR ".join(kinds[s] for s in f.sources)
    cats = ", ".join(B.quote(c) for c in f.categories)
    return f"city = '{f.city}' AND effective_at >= {start} AND effective_at < {end} + INTERVAL 1 DAY AND category IN ({cats}) AND ({kind})"


def _axial_sql(source: str, resolution: int) -> str:
    """CTEs that end in ``celled``: the source rows with their cell id."""
    a = hexgrid.edge_km(resolution)
    kx = _when_city(lambda c: hexgrid.km_per_degree_lng(c.id))
    return f"""
    plane AS (SELECT *, (lng - {_when_city(lambda c: c.lng)}) * {kx} AS x_, (lat - {_when_city(lambda c: c.lat)}) * {_d(hexgrid.km_per_degree_lat())} AS y_ FROM {source}),
    frac AS (SELECT *, (x_ * {_d(math.sqrt(3) / 3)} - y_ / 3.0e0) / {_d(a)} AS fq, (y_ * {_d(2 / 3)}) / {_d(a)} AS fr FROM plane),
    cube AS (SELECT *, -fq - fr AS fs, floor(fq + 0.5e0) AS rq, floor(fr + 0.5e0) AS rr, floor(-fq - fr + 0.5e0) AS rs FROM frac),
    celled AS (SELECT *, city || ':{resolution}:'
      || CAST(CAST(CASE WHEN abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rs - fs) THEN -rr - rs ELSE rq END AS BIGINT) AS VARCHAR) || ':'
      || CAST(CAST(CASE WHEN NOT (abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rs - fs)) AND abs(rr - fr) > abs(rs - fs) THEN -rq - rs ELSE rr END AS BIGINT) AS VARCHAR) AS cell
      FROM cube)"""


def _center_sql(resolution: int) -> str:
    """x_, y_ of a cell's centre and its lat/lng, from columns city and cell."""
    a = hexgrid.edge_km(resolution)
    q, r = (f"CAST(split_part(cell, ':', {i}) AS BIGINT)" for i in (3, 4))
    return f"({q} + {r} / 2.0e0) * {_d(math.sqrt(3) * a)} AS cx, {r} * {_d(1.5 * a)} AS cy"


def _lat_sql(y: str) -> str:
    return f"CAST(round({y} / {_d(hexgrid.km_per_degree_lat())} + {_when_city(lambda c: c.lat)}, 6) AS DOUBLE)"


def _lng_sql(x: str) -> str:
    return f"CAST(round({x} / {_when_city(lambda c: hexgrid.km_per_degree_lng(c.id))} + {_when_city(lambda c: c.lng)}, 6) AS DOUBLE)"


_RANK_SQL = "CASE geo_precision " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRECISION_ORDER)) + " ELSE 9 END"
_REPS_SQL = f"""row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN source_type LIKE 'police_%' THEN 0 ELSE 1 END,
  {_RANK_SQL}, published_datetime, id) = 1"""


def _cells_sql(query: dict[str, str] = _FILTER, resolution: int = RES) -> str:
    """CTEs that end in ``cells`` (city, cell, count) and ``cell_categories``."""
    return f"""{B.REPORTS_SQL},
    kept AS (SELECT * FROM reports WHERE {_filter_sql(_filter(query))} AND geo_precision <> 'city'),
    points AS (SELECT * FROM kept QUALIFY {_REPS_SQL}),
    {_axial_sql('points', resolution)},
    cell_categories AS (SELECT city, cell, category, count(*) AS n FROM celled GROUP BY ALL),
    cells AS (SELECT city, cell, sum(n)::BIGINT AS count, string_agg(category || ':' || n, ',' ORDER BY category) AS categories FROM cell_categories GROUP BY ALL)"""


def _cells(spark, folder, query=None, resolution=RES):
    return heatmap.heatmap(B.reports(spark, folder), _filter(query or _FILTER), resolution)


def _listed(cells):
    """Category map as text in key order."""
    entries = F.transform(F.map_entries("categories"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return cells.withColumn("categories", F.array_join(F.array_sort(entries), ","))


def heatmap_cells(spark, folder):
    return _listed(_cells(spark, folder))


def heatmap_from_table(spark, folder):
    """The same query over a stored, partitioned table."""
    import uuid

    root = f"{scratch_dir(spark)}/reports-{uuid.uuid4().hex}"
    write_reports(B.reports(spark, folder), root)
    stored = read_reports(spark, root, B.NOW)
    return _listed(heatmap.heatmap(stored, _filter(), RES))


def reports_from_json(spark, folder):
    """All reports exported as JSON lines and loaded again."""
    import uuid

    path = f"{scratch_dir(spark)}/reports-json-{uuid.uuid4().hex}"
    export_reports_json(B.reports(spark, folder), path)
    back = load_reports_json(spark, path, None)
    return back.select(
        "id", "event_id", "city", "title", "category", "source_type", "source_link", B.iso("published_datetime").alias("published"), B.iso("incident_datetime").alias("incident"),
        F.md5("description").alias("description"), "police_station", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "geo_precision",
    )


_JSON_SQL = f"""WITH {B.REPORTS_SQL} SELECT id, event_id, city, title, category, source_type, source_link, {B.iso_sql('published_datetime')} AS published, {B.iso_sql('incident_datetime')} AS incident,
  md5(description) AS description, police_station, round(lat, 6) AS lat, round(lng, 6) AS lng, geo_precision FROM reports"""


HEATMAP_SQL = f"""WITH {_cells_sql()}, centered AS (SELECT *, {_center_sql(RES)} FROM cells)
SELECT cell, {_lat_sql('cy')} AS lat, {_lng_sql('cx')} AS lng, count, categories FROM centered"""


def heatmap_news_fine(spark, folder):
    return _cells(spark, folder, _NEWS_FILTER, 10).select("cell", "count")


def heatmap_totals(spark, folder):
    return heatmap.heatmap_totals(_cells(spark, folder))


def heatmap_levels(spark, folder):
    return heatmap.with_level(_cells(spark, folder)).select("cell", "count", "level")


def heatmap_top_categories(spark, folder):
    return heatmap.top_categories(_cells(spark, folder))


_CATEGORY_AT = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORY_IDS)) + " END"


def heatmap_rings(spark, folder):
    ringed = heatmap.with_ring(_cells(spark, folder), RES)
    return ringed.select("cell", F.posexplode("ring").alias("corner", "p")).select("cell", "corner", "p.lng", "p.lat")


_ANGLES = [math.pi / 180 * (60 * (i % 6) - 30) for i in range(7)]
_CORNERS = ", ".join(
    f"({i}, {_d(hexgrid.edge_km(RES) * math.cos(t))}, {_d(hexgrid.edge_km(RES) * math.sin(t))})" for i, t in enumerate(_ANGLES)
)
_RINGS_SQL = f"""{_cells_sql()}, centered AS (SELECT *, {_center_sql(RES)} FROM cells),
  rings AS (SELECT cell, corner, {_lng_sql('(cx + dx)')} AS lng, {_lat_sql('(cy + dy)')} AS lat
            FROM centered, (VALUES {_CORNERS}) AS c(corner, dx, dy))"""


def cells_bounds(spark, folder):
    return heatmap.cells_bounds(_cells(spark, folder), RES)


def representatives(spark, folder):
    return heatmap.representatives(B.reports(spark, folder), ["id", "geo_precision"])


_PAGE_COLUMNS = ["id", "title", "category", "source_type", "shown"]


def _page_rows(df):
    return df.withColumn("shown", B.iso("effective_at")).select(*_PAGE_COLUMNS)


def report_page(spark, folder):
    query = {"limit": "120", "offset": "30", "bbox": _BBOX}
    return _page_rows(reports.report_page(B.reports(spark, folder), _filter(), parse_page(query), parse_area(query)))


_BBOX_SQL = "lng BETWEEN 77.0e0 AND 77.3e0 AND lat BETWEEN 28.45e0 AND 28.8e0"
_CELL = "delhi:6:0:1"


def report_page_by_cell(spark, folder):
    query = {"cell": _CELL, "bbox": "1,1,1,1"}
    return _page_rows(reports.report_page(B.reports(spark, folder), _filter(), Page(200, 0), parse_area(query)))


def report_total(spark, folder):
    return reports.report_total(B.reports(spark, folder), _filter(_NEWS_FILTER))


def report_keyset_page(spark, folder):
    rows = B.table(spark, folder, "events").select(F.col("event_id").alias("key"), "event_type")
    return reports.keyset_page(rows, "key", 700, 100)


def source_catalogue(spark, folder):
    return meta.source_catalogue(B.reports(spark, folder))


def covered_dates(spark, folder):
    return meta.date_range(B.reports(spark, folder))


def source_spans(spark, folder):
    spans = meta.source_spans(B.reports(spark, folder))
    return spans.select("source_name", B.iso("first_published").alias("first"), B.iso("last_published").alias("last"), "count")


def window_by_group(spark, folder):
    recent = group_map.with_group(in_window(B.reports(spark, folder), B.NOW))
    return recent.groupBy("city", "group").agg(F.count("*").alias("n"))


_BASE_GROUP = "CASE category " + " ".join(f"WHEN '{c.id}' THEN '{c.group}'" for c in CATEGORIES if c.group) + " END"


def group_sql(text: str) -> str:
    return f"""CASE WHEN {_BASE_GROUP} IN ('scam', 'harassment') AND regexp_matches({text}, '(?i)\\b({STAY_WORDS})\\b') THEN 'stay'
    WHEN {_BASE_GROUP} IN ('scam', 'harassment') AND regexp_matches({text}, '(?i)\\b({TRANSPORT_WORDS})\\b') THEN 'transport' ELSE {_BASE_GROUP} END"""


GROUP_SQL = group_sql("(title || ' ' || coalesce(description, ''))")
_SCORE = "(CASE WHEN source_type LIKE 'police_%' THEN 10 ELSE 0 END + CASE geo_precision WHEN 'address' THEN 3 WHEN 'police_station' THEN 2 WHEN 'locality' THEN 1 ELSE 0 END)"
_DERIVED_SQL = f"""{B.REPORTS_SQL},
  grouped AS (SELECT *, {GROUP_SQL} AS "group" FROM reports),
  mapped AS (SELECT * FROM grouped WHERE "group" IS NOT NULL AND geo_precision <> 'city'
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {_SCORE} DESC, effective_at DESC, id) = 1),
  city_level AS (SELECT * FROM grouped WHERE "group" IS NOT NULL AND geo_precision = 'city' AND event_id NOT IN (SELECT event_id FROM mapped)
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {_SCORE} DESC, effective_at DESC, id) = 1),
  derived AS (SELECT *, true AS on_map FROM mapped UNION ALL SELECT *, false FROM city_level)"""


def group_map_events(spark, folder):
    return group_map.derive(B.reports(spark, folder)).select("id", "group", "on_map")


def group_counts(spark, folder):
    return group_map.group_counts(group_map.derive(B.reports(spark, folder)))


def group_counts_labelled(spark, folder):
    """Counts with labels: remote labels (from the region table) win over local ones."""
    region = B.table(spark, folder, "region")
    remote = region.select(B.pick([g.id for g in GROUPS], F.col("r_regionkey") * 2).alias("id"), F.col("r_name").alias("label"), F.lit("#000000").alias("color"))
    remote = remote.groupBy("id").agg(F.min("label").alias("label"), F.min("color").alias("color"))
    groups = meta.merge_group_labels(meta.group_table(spark), remote)
    counts = group_map.group_counts(group_map.derive(B.reports(spark, folder)))
    return groups.join(counts.select(F.col("group").alias("id"), "count"), "id").select("id", "label", "color", "disabled", "count")


_LOCAL_GROUPS = ", ".join(f"('{g.id}', '{g.label}', '{g.color}', {str(g.disabled).lower()})" for g in GROUPS)


def city_level_count(spark, folder):
    return group_map.city_level_count(group_map.derive(B.reports(spark, folder)), "harassment")


def latest_reports(spark, folder):
    return group_map.latest(group_map.derive(B.reports(spark, folder))).select("id", B.iso("effective_at").alias("shown"))


def visible_reports(spark, folder):
    return group_map.visible(group_map.derive(B.reports(spark, folder)), "scam").select("id", "group", "on_map")


def selected_reports(spark, folder):
    ids = B.table(spark, folder, "customer").select(F.concat(F.lit("r"), (F.col("c_custkey") * 3).cast("string")).alias("id"))
    return reports.selected(group_map.derive(B.reports(spark, folder)), ids, "scam").select("id", "category")


def report_cards(spark, folder):
    return group_map.display(B.reports(spark, folder))


def _day_sql(column: str) -> str:
    t = f"({column} + INTERVAL 330 MINUTE)"
    return f"day({t}) || ' ' || strftime({t}, '%b %Y')"


_CLOCK_SQL = "strftime((incident_datetime + INTERVAL 330 MINUTE), '%-I:%M %p')"
_LABELS = "CASE category " + " ".join(f"WHEN '{c.id}' THEN {B.quote(c.label)}" for c in CATEGORIES) + " END"
CARDS_SQL = f"""WITH {B.REPORTS_SQL} SELECT id,
  coalesce(CASE incident_datetime_precision WHEN 'exact' THEN {_day_sql('incident_datetime')} || ', ' || {_CLOCK_SQL}
    WHEN 'date' THEN {_day_sql('incident_datetime')} WHEN 'date_range' THEN {_day_sql('incident_datetime')} || ' (night of)' END, '') AS incident,
  {_day_sql('published_datetime')} AS published, {_day_sql('effective_at')} AS shown_date,
  CASE geo_precision WHEN 'address' THEN 'exact address' WHEN 'police_station' THEN 'police station area'
    WHEN 'locality' THEN 'approximate: locality centre' ELSE '' END AS precision_note,
  CASE source_type WHEN 'news' THEN 'News' ELSE 'Police' END AS badge, {_LABELS} AS category_label,
  coalesce(location_text, 'Unknown location') || CASE WHEN police_station IS NOT NULL AND police_station IS DISTINCT FROM location_text
    THEN ' · ' || police_station ELSE '' END AS place
FROM reports"""


def type_labels(spark, folder):
    """Labels of ids that have no entry in a label table."""
    return B.table(spark, folder, "part").select("p_partkey", label_of(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"))


def area_counts(spark, folder):
    return reports.area_counts(B.reports(spark, folder))


def area_search(spark, folder):
    return reports.search_areas(reports.area_counts(B.reports(spark, folder), None), " PARK")


def area_reports(spark, folder):
    return reports.in_area(B.reports(spark, folder), "Old Fort").select("id", "city")


def area_cells(spark, folder):
    return reports.area_cells(B.reports(spark, folder), "Old Fort", 7)


def cell_summary(spark, folder):
    return reports.cell_summary(B.reports(spark, folder), 7)


def geojson_points(spark, folder):
    return point_features(group_map.derive(B.reports(spark, folder)).filter("on_map"))


_COLORS = 'CASE "group" ' + " ".join(f"WHEN '{g.id}' THEN '{g.color}'" for g in GROUPS) + " ELSE '#9aa0a6' END"


def geojson_polygons(spark, folder):
    features = polygon_features(_cells(spark, folder), RES)
    read = F.from_json("feature", "type string, properties struct<cell string, count bigint, level int, categories map<string,bigint>>, geometry struct<type string, coordinates array<array<array<double>>>>")
    parts = features.select(read.alias("f"))
    ring = F.element_at("f.geometry.coordinates", 1)
    return parts.select(
        "f.properties.cell", "f.properties.count", "f.properties.level", F.size("f.properties.categories").alias("kinds"),
        F.size(ring).alias("corners"), (F.element_at(ring, 1) == F.element_at(ring, -1)).alias("closed"),
        F.element_at(F.element_at(ring, 1), 1).alias("first_lng"), F.concat_ws("/", "f.type", "f.geometry.type").alias("types"),
    )


def square_grid(spark, folder):
    return square_bins(B.reports(spark, folder), 0.01)


_WEIGHTS = "CASE category " + " ".join(f"WHEN '{k}' THEN {w}" for k, (_, w) in CATEGORY_LAYERS.items()) + " ELSE 1 END"


def layer_weights(spark, folder):
    from reportmill.plans.ingest_rows import layer_totals

    return layer_totals(B.reports(spark, folder))


_LAYERS = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, (v, _) in CATEGORY_LAYERS.items()) + " ELSE 'safety' END"


def _odd_rows(spark, folder):
    """Report rows with every kind of defect."""
    i = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    rows = B.reports(spark, folder)
    return rows.withColumns(
        {
            "title": F.when(i % 31 != 0, F.col("title")),
            "city": F.when(i % 37 == 0, "mumbai").otherwise(F.col("city")),
            "source_type": F.when(i % 41 == 0, "blog").otherwise(F.col("source_type")),
            "source_link": F.when(i % 43 == 0, "nowhere").otherwise(F.col("source_link")),
            "published_datetime": F.when(i % 47 != 0, F.col("published_datetime")),
            "lat": F.when(i % 53 == 0, 91.0).otherwise(F.col("lat")),
        }
    )


def ingest_check(spark, folder):
    return ingest_counts(validated(_odd_rows(spark, folder), B.NOW))


INGEST_SQL = f"""WITH {B.REPORTS_SQL}, n AS (SELECT CAST(substr(id, 2) AS BIGINT) AS i FROM reports)
SELECT CASE WHEN i % 41 = 0 THEN 'unknown source_type' WHEN i % 43 = 0 THEN 'bad source_link' WHEN i % 31 = 0 THEN 'title is required'
  WHEN i % 47 = 0 THEN 'published_datetime is required' WHEN i % 37 = 0 THEN 'unknown city' WHEN i % 53 = 0 THEN 'bad position' ELSE 'accepted' END AS result, count(*) AS n
FROM n GROUP BY ALL"""


def city_membership(spark, folder):
    return B.gazetteer(spark, folder).select("position", in_city(F.col("city"), F.col("lat"), F.col("lng")).alias("inside"))


def center_distance(spark, folder):
    center = lambda a: B.pick([getattr(c, a) for c in CITIES], F.col("position"))
    d = haversine_km(F.col("lat"), F.col("lng"), center("lat"), center("lng"))
    return B.gazetteer(spark, folder).select("position", F.round(d, 6).alias("km"))


_INSIDE = " OR ".join(f"(city = '{c.id}' AND lat BETWEEN {_d(c.min_lat)} AND {_d(c.max_lat)} AND lng BETWEEN {_d(c.min_lng)} AND {_d(c.max_lng)})" for c in CITIES)
_HAV = "(pow(sin(radians(b - lat) / 2), 2) + cos(radians(lat)) * cos(radians(b)) * pow(sin(radians(l - lng) / 2), 2))"

R = f"WITH {B.REPORTS_SQL}"
QUERIES = {
    "reports_from_json": (reports_from_json, _JSON_SQL),
    "heatmap_cells": (heatmap_cells, HEATMAP_SQL),
    "heatmap_from_table": (heatmap_from_table, HEATMAP_SQL),
    "heatmap_news_fine": (heatmap_news_fine, f"WITH {_cells_sql(_NEWS_FILTER, 10)} SELECT cell, count FROM cells"),
    "heatmap_totals": (heatmap_totals, f"WITH {_cells_sql()} SELECT coalesce(sum(count), 0)::BIGINT AS total, coalesce(max(count), 0)::BIGINT AS max_count FROM cells"),
    "heatmap_levels": (heatmap_levels, f"WITH {_cells_sql()} SELECT cell, count, greatest(1, CAST(ceil(count * 5.0e0 / (SELECT max(count) FROM cells)) AS INTEGER)) AS level FROM cells"),
    "heatmap_top_categories": (heatmap_top_categories, f"""WITH {_cells_sql()} SELECT cell, CAST(row_number() OVER (PARTITION BY cell ORDER BY n DESC, {_CATEGORY_AT}) AS INTEGER) AS rank, category, n AS count
      FROM cell_categories QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, {_CATEGORY_AT}) <= 2"""),
    "heatmap_rings": (heatmap_rings, f"WITH {_RINGS_SQL} SELECT cell, corner, lng, lat FROM rings"),
    "cells_bounds": (cells_bounds, f"WITH {_RINGS_SQL} SELECT min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat FROM rings"),
    "representatives": (representatives, f"{R} SELECT event_id, id, geo_precision FROM reports QUALIFY {_REPS_SQL}"),
    "report_page": (report_page, f"{R} SELECT id, title, category, source_type, {B.iso_sql('effective_at')} AS shown FROM reports WHERE {_filter_sql(_filter())} AND {_BBOX_SQL} ORDER BY effective_at DESC, id LIMIT 120 OFFSET 30"),
    "report_page_by_cell": (report_page_by_cell, f"WITH {B.REPORTS_SQL}, {_axial_sql('reports', 6)} SELECT id, title, category, source_type, {B.iso_sql('effective_at')} AS shown FROM celled WHERE {_filter_sql(_filter())} AND cell = '{_CELL}' ORDER BY effective_at DESC, id LIMIT 200"),
    "report_total": (report_total, f"{R} SELECT count(*) AS total FROM reports WHERE {_filter_sql(_filter(_NEWS_FILTER))}"),
    "report_keyset_page": (report_keyset_page, "SELECT event_id AS key, event_type FROM events WHERE event_id < 700 ORDER BY event_id DESC LIMIT 100"),
    "source_catalogue": (source_catalogue, f"{R} SELECT city, source_name, source_type, count(*) AS count FROM reports GROUP BY ALL"),
    "covered_dates": (covered_dates, f"{R} SELECT strftime(min(effective_at), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS min, strftime(max(effective_at), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS max FROM reports"),
    "source_spans": (source_spans, f"{R} SELECT source_name, {B.iso_sql('min(published_datetime)')} AS first, {B.iso_sql('max(published_datetime)')} AS last, count(*) AS count FROM reports GROUP BY 1"),
    "window_by_group": (window_by_group, f"""{R} SELECT city, {GROUP_SQL} AS "group", count(*) AS n FROM reports WHERE published_datetime >= TIMESTAMP '2024-01-31' - INTERVAL 184 DAY GROUP BY ALL"""),
    "group_map_events": (group_map_events, f"""WITH {_DERIVED_SQL} SELECT id, "group", on_map FROM derived"""),
    "group_counts": (group_counts, f"""WITH {_DERIVED_SQL}, names(position, g) AS (VALUES (0, 'all'), {', '.join(f"({i + 1}, '{g.id}')" for i, g in enumerate(GROUPS))})
      SELECT position, g AS "group", (SELECT count(*) FROM mapped m WHERE g = 'all' OR m."group" = g) AS count FROM names"""),
    "group_counts_labelled": (group_counts_labelled, f"""WITH {_DERIVED_SQL}, local(id, label, color, disabled) AS (VALUES {_LOCAL_GROUPS}),
      remote AS (SELECT {B.pick_sql([g.id for g in GROUPS], 'r_regionkey * 2')} AS id, min(r_name) AS label FROM region GROUP BY 1)
      SELECT l.id, coalesce(r.label, l.label) AS label, CASE WHEN r.id IS NULL THEN l.color ELSE '#000000' END AS color, disabled,
        (SELECT count(*) FROM mapped m WHERE m."group" = l.id) AS count FROM local l LEFT JOIN remote r ON r.id = l.id"""),
    "city_level_count": (city_level_count, f"""WITH {_DERIVED_SQL} SELECT count(*) AS count FROM city_level WHERE "group" = 'harassment'"""),
    "latest_reports": (latest_reports, f"WITH {_DERIVED_SQL} SELECT id, {B.iso_sql('effective_at')} AS shown FROM mapped ORDER BY effective_at DESC, id LIMIT 12"),
    "visible_reports": (visible_reports, f"""WITH {_DERIVED_SQL} SELECT id, "group", on_map FROM derived WHERE "group" = 'scam'"""),
    "selected_reports": (selected_reports, f"""WITH {_DERIVED_SQL} SELECT id, category FROM derived WHERE "group" = 'scam' AND id IN (SELECT 'r' || (c_custkey * 3) FROM customer)"""),
    "report_cards": (report_cards, CARDS_SQL),
    "type_labels": (type_labels, "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM part"),
    "area_counts": (area_counts, f"{R} SELECT location_text AS name, count(*) AS count FROM reports WHERE geo_precision <> 'city' AND location_text <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 300"),
    "area_search": (area_search, f"{R} SELECT location_text AS name, count(*) AS count FROM reports WHERE geo_precision <> 'city' AND lower(location_text) LIKE '%park%' GROUP BY 1"),
    "area_reports": (area_reports, f"{R} SELECT id, city FROM reports WHERE geo_precision <> 'city' AND location_text = 'Old Fort'"),
    "area_cells": (area_cells, f"WITH {B.REPORTS_SQL}, {_axial_sql('reports', 7)} SELECT DISTINCT cell FROM celled WHERE geo_precision <> 'city' AND location_text = 'Old Fort'"),
    "cell_summary": (cell_summary, f"""WITH {B.REPORTS_SQL}, {_axial_sql('reports', 7)}, kept AS (SELECT * FROM celled WHERE geo_precision <> 'city')
      SELECT cell, count(*) AS count, first(location_text ORDER BY effective_at DESC, id) AS around FROM kept GROUP BY 1"""),
    "geojson_points": (geojson_points, f"""WITH {_DERIVED_SQL} SELECT id, '{{"type":"Feature","properties":{{"id":"' || id || '","group":"' || "group" || '","color":"' || {_COLORS} || '","title":"' || title
      || '"}},"geometry":{{"type":"Point","coordinates":[' || lng || ',' || lat || ']}}}}' AS feature FROM mapped"""),
    "geojson_polygons": (geojson_polygons, f"""WITH {_RINGS_SQL} SELECT c.cell, c.count, greatest(1, CAST(ceil(c.count * 5.0e0 / (SELECT max(count) FROM cells)) AS INTEGER)) AS level,
      (SELECT CAST(count(*) AS INTEGER) FROM cell_categories k WHERE k.cell = c.cell) AS kinds, 7 AS corners, true AS closed, r.lng AS first_lng, 'Feature/Polygon' AS types
      FROM cells c JOIN rings r ON r.cell = c.cell AND r.corner = 0"""),
    "square_grid": (square_grid, f"""{R}, binned AS (SELECT *, CAST(floor(lat / 1e-2) AS BIGINT) AS i, CAST(floor(lng / 1e-2) AS BIGINT) AS j FROM reports)
      SELECT CAST(round((i + 0.5e0) * 1e-2, 6) AS DOUBLE) AS lat, CAST(round((j + 0.5e0) * 1e-2, 6) AS DOUBLE) AS lng, count(*) AS count, CAST(sum({_WEIGHTS}) AS BIGINT) AS weight FROM binned GROUP BY i, j"""),
    "layer_weights": (layer_weights, f"{R} SELECT {_LAYERS} AS layer, count(*) AS count, CAST(sum({_WEIGHTS}) AS BIGINT) AS weight FROM reports GROUP BY 1"),
    "ingest_check": (ingest_check, INGEST_SQL),
    "city_membership": (city_membership, f"WITH {B.GAZETTEER_SQL} SELECT position, ({_INSIDE}) AS inside FROM gazetteer"),
    "center_distance": (center_distance, f"""WITH {B.GAZETTEER_SQL}, c AS (SELECT *, {B.pick_sql([c.lat for c in CITIES], 'position')} AS b, {B.pick_sql([c.lng for c in CITIES], 'position')} AS l FROM gazetteer)
      SELECT position, CAST(round(asin(sqrt({_HAV})) * 12742, 6) AS DOUBLE) AS km FROM c"""),
}
