"""Hexagonal cells by Column arithmetic.

Each city has its own flat grid of pointy-top hexagons around its centre. A cell id reads
``city:resolution:q:r``. One step finer divides the area by seven; resolution 7 is about 5 km².
Ids and borders are this grid's own.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportmill.config import CITIES, CITY_BY_ID, EARTH_RADIUS_KM
from reportmill.functions.patterns import let

MIN_RESOLUTION, MAX_RESOLUTION, DEFAULT_RESOLUTION = 5, 10, 8
_EDGE_KM_AT_7 = 1.41
ID_PATTERN = re.compile(r"^(" + "|".join(CITY_BY_ID) + r"):(\d{1,2}):(-?\d+):(-?\d+)$")


def edge_km(resolution: int) -> float:
    return _EDGE_KM_AT_7 * 7 ** ((7 - resolution) / 2)


def km_per_degree_lat() -> float:
    return EARTH_RADIUS_KM * math.pi / 180


def km_per_degree_lng(city: str) -> float:
    return km_per_degree_lat() * math.cos(math.radians(CITY_BY_ID[city].lat))


def _frame(city: Column) -> Column:
    """struct(lat, lng, kx) of a city's grid origin and its km per degree of longitude."""
    out = None
    for c in CITIES:
        origin = F.struct(F.lit(c.lat).alias("lat"), F.lit(c.lng).alias("lng"), F.lit(km_per_degree_lng(c.id)).alias("kx"))
        out = F.when(city == c.id, origin) if out is None else out.when(city == c.id, origin)
    return out


def axial(city: Column, lat: Column, lng: Column, resolution: int) -> Column:
    """struct(q, r) of the cell that holds a point."""
    a = edge_km(resolution)

    def plane(f: Column) -> Column:
        x, y = (lng - f["lng"]) * f["kx"], (lat - f["lat"]) * km_per_degree_lat()
        return F.struct(((x * (math.sqrt(3) / 3) - y / 3) / a).alias("q"), ((y * (2 / 3)) / a).alias("r"))

    def rounded(p: Column) -> Column:
        s = -p["q"] - p["r"]
        near = [F.floor(v + 0.5) for v in (p["q"], p["r"], s)]
        off = [F.abs(n - v) for n, v in zip(near, (p["q"], p["r"], s))]
        names = ("q", "r", "s", "dq", "dr", "ds")
        return F.struct(*[v.alias(n) for n, v in zip(names, near + off)])

    def settled(n: Column) -> Column:
        q_worst = (n["dq"] > n["dr"]) & (n["dq"] > n["ds"])
        r_worst = ~q_worst & (n["dr"] > n["ds"])
        return F.struct(
            F.when(q_worst, -n["r"] - n["s"]).otherwise(n["q"]).alias("q"),
            F.when(r_worst, -n["q"] - n["s"]).otherwise(n["r"]).alias("r"),
        )

    return let(_frame(city), lambda f: let(plane(f), lambda p: let(rounded(p), settled)))


def cell_id(city: Column, lat: Column, lng: Column, resolution: int) -> Column:
    return let(
        axial(city, lat, lng, resolution),
        lambda at: F.concat_ws(":", city, F.lit(str(resolution)), at["q"].cast("string"), at["r"].cast("string")),
    )


def parse_cell(cell: str) -> tuple[str, int]:
    """(city, resolution) of a cell id; ValueError when it is not one."""
    found = ID_PATTERN.match(cell)
    if not found or not MIN_RESOLUTION <= int(found[2]) <= MAX_RESOLUTION:
        raise ValueError("cell must be a valid cell id")
    return found[1], int(found[2])


def _with_center(cell: Column, resolution: int, body) -> Column:
    """``body`` of a struct holding the grid frame and the centre's plane position in km."""
    a = edge_km(resolution)

    def place(parts: Column) -> Column:
        q, r = F.element_at(parts, 3).cast("long"), F.element_at(parts, 4).cast("long")
        return F.struct(
            _frame(F.element_at(parts, 1)).alias("f"),
            ((q + r / 2) * (math.sqrt(3) * a)).alias("x"),
            (r * (1.5 * a)).alias("y"),
        )

    return let(F.split(cell, ":"), lambda parts: let(place(parts), body))


def _lat(c: Column, dy: float = 0.0) -> Column:
    return F.round((c["y"] + dy) / km_per_degree_lat() + c["f"]["lat"], 6)


def _lng(c: Column, dx: float = 0.0) -> Column:
    return F.round((c["x"] + dx) / c["f"]["kx"] + c["f"]["lng"], 6)


def cell_center(cell: Column, resolution: int) -> Column:
    """struct(lat, lng) of a cell's centre, six decimals."""
    return _with_center(cell, resolution, lambda c: F.struct(_lat(c).alias("lat"), _lng(c).alias("lng")))


def cell_ring(cell: Column, resolution: int) -> Column:
    """Closed ring of seven struct(lng, lat) corners."""
    a = edge_km(resolution)
    angles = [math.pi / 180 * (60 * (i % 6) - 30) for i in range(7)]
    return _with_center(
        cell,
        resolution,
        lambda c: F.array(
            *[F.struct(_lng(c, a * math.cos(t)).alias("lng"), _lat(c, a * math.sin(t)).alias("lat")) for t in angles]
        ),
    )
