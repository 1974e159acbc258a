"""Locating a report: gazetteer matches, geocode lookups and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.config import CITIES, GENERIC_OFFICE_WORDS, STATION_LOCALITY_MAX_KM, STOP_NAMES
from reportmill.functions.names import haversine_km, normalize_ascii, normalize_name, place_phrase, station_phrases
from reportmill.functions.patterns import let, trimmed, whole_words
from reportmill.operators.hotkeys import broadcast_if_small

# Characters of a text in which ``resolve_locations`` looks for stations and for names.
STATION_TEXT, NAME_TEXT = 3000, 1500


def in_city(city: Column, lat: Column, lng: Column) -> Column:
    """Whether a point lies in its city's bounding box (edges included)."""
    inside = F.lit(False)
    for c in CITIES:
        box = lat.between(c.min_lat, c.max_lat) & lng.between(c.min_lng, c.max_lng)
        inside = F.when(city == c.id, box).otherwise(inside)
    return F.coalesce(inside, F.lit(False))


def generic_office(station: Column) -> Column:
    """Whether a station name is a headquarters, wing or other office without a beat."""
    return F.coalesce(F.lower(station).rlike(whole_words(GENERIC_OFFICE_WORDS)), F.lit(False))


def _entry() -> Column:
    return F.struct("name", "lat", "lng", "kind")


def name_index(gazetteer: DataFrame) -> DataFrame:
    """Lookup table of the matcher: (city, use, gram) → entry, length, position.

    ``use`` 0 holds station names for "X police station" phrases; ``use`` 1 holds all names, where a
    locality replaces a station of the same name but keeps the place of the first entry seen.
    """
    named = gazetteer.withColumn("gram", normalize_name(F.col("name")))
    alias = F.lit(False)
    for c in CITIES:
        alias = alias | ((F.col("city") == c.id) & F.col("gram").isin(*c.aliases))
    station = F.col("kind") == "police_station"
    usable = named.filter(
        (F.length("gram") >= 4) & ~F.col("gram").isin(*STOP_NAMES) & ~alias & ~(station & generic_office(F.col("name")))
    )
    stations = (
        usable.filter(station).groupBy("city", "gram")
        .agg(F.min_by(_entry(), "position").alias("entry"), F.min("position").alias("position"))
        .withColumn("use", F.lit(0))
    )
    names = (
        usable.groupBy("city", "gram")
        .agg(F.min_by(_entry(), F.struct(station.alias("s"), "position")).alias("entry"), F.min("position").alias("position"))
        .withColumn("use", F.lit(1))
    )
    return stations.unionByName(names).select("city", "use", "gram", "entry", "position", F.length("gram").alias("n"))


def _station_keys(text: Column, hay: int) -> Column:
    """Every word suffix of every phrase before a police word, with its rank."""

    def suffixes(words: Column, at: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: F.struct(
                F.lit(0).alias("use"),
                F.lit(hay).alias("hay"),
                at.alias("at"),
                i.alias("step"),
                F.slice(words, i, F.size(words)).alias("run"),
            ),
        )

    phrases = station_phrases(F.coalesce(text, F.lit("")))
    return F.flatten(F.transform(phrases, lambda p, at: let(F.split(normalize_ascii(p), " "), lambda w: suffixes(w, at))))


def _name_keys(normal: Column, hay: int, longest: int) -> Column:
    """The run of ``longest`` words from every word on, shorter at the end."""

    def runs(words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: F.struct(F.lit(1).alias("use"), F.lit(hay).alias("hay"), F.lit(0).alias("at"), F.lit(0).alias("step"), F.slice(words, i, longest).alias("run")),
        )

    return let(F.split(F.coalesce(normal, F.lit("")), " "), runs)


def _passes(rows: DataFrame, key: str, longest: int, station_text: int | None = None, name_text: int | None = None) -> DataFrame:
    """(key, city, pass, word run…): pass 0 looks at location_text alone, pass 1 at title, keywords and text (whole texts for None)."""
    text = F.coalesce("text", F.lit(""))
    upto = lambda c, most: c if most is None else F.substring(c, 1, most)
    normal = rows.select(
        key, "city", "title", "text", "location_text",
        normalize_name(F.col("location_text")).alias("_location"),
        normalize_name(F.col("title")).alias("_title"),
        normalize_name(F.array_join("keywords", " , ")).alias("_keywords"),
        normalize_name(upto(text, name_text)).alias("_text"),
    )
    first = F.concat(_station_keys(F.col("location_text"), 0), _name_keys(F.col("_location"), 0, longest))
    second = F.concat(
        _station_keys(F.col("title"), 0),
        _station_keys(upto(F.col("text"), station_text), 1),
        _name_keys(F.col("_title"), 0, longest),
        _name_keys(F.col("_keywords"), 1, longest),
        _name_keys(F.col("_text"), 2, longest),
    )
    tag = lambda keys, number: F.transform(keys, lambda k: F.struct(F.lit(number).alias("look"), k.alias("k")))
    spread = normal.select(key, "city", F.explode(F.concat(tag(first, 0), tag(second, 1))).alias("s"))
    return spread.select(key, "city", "s.look", "s.k.*")


def _keys(spread: DataFrame, index: DataFrame) -> DataFrame:
    """Search keys of word runs: for stations the whole run, for names its beginnings. Runs whose first word begins no entry end here."""
    words = F.split("gram", " ")
    heads = index.groupBy("city", "use", words[0].alias("head")).agg(F.max(F.size(words)).alias("most"))
    met = spread.withColumn("head", F.col("run")[0]).join(broadcast_if_small(heads), ["city", "use", "head"])
    beginnings = F.transform(F.sequence(F.lit(1), F.least("most", F.size("run"))), lambda n: F.array_join(F.slice("run", F.lit(1), n), " "))
    gram = F.explode(F.when(F.col("use") == 0, F.array(F.array_join("run", " "))).otherwise(beginnings))
    return met.select(*[c for c in met.columns if c not in ("head", "most", "run")], gram.alias("gram"))


def match_places(rows: DataFrame, gazetteer: DataFrame, key: str, station_text: int | None = None, name_text: int | None = None) -> DataFrame:
    """(key, by_location, by_text): the best gazetteer entry of each look, where one exists.

    Texts are searched whole, or as far as ``station_text`` characters for stations and ``name_text`` for names.
    Station phrases come before names; earlier texts before later ones; longer names before shorter; then gazetteer order.
    Words meet the first words of the index, few as these are; from there keys meet the index in one equi-join. Only hits are shuffled.
    """
    index = name_index(gazetteer).checkpoint()
    longest = index.agg(F.max(F.size(F.split("gram", " ")))).first()[0] or 1
    hits = _keys(_passes(rows, key, longest, station_text, name_text), index).join(broadcast_if_small(index), ["city", "use", "gram"])
    order = F.struct("use", "hay", "at", "step", (-F.col("n")).alias("n"), "position")
    best = lambda look: F.min_by(F.when(F.col("look") == look, F.col("entry")), F.when(F.col("look") == look, order))
    return hits.groupBy(key).agg(best(0).alias("by_location"), best(1).alias("by_text"))


def geocode_key(city: Column, query: Column) -> Column:
    return F.concat(city, F.lit("|"), F.lower(trimmed(query)))


def _lookup(rows: DataFrame, geocodes: DataFrame, query: str, out: str, key: str) -> DataFrame:
    """Joins the geocode table on a query column; ``out`` is the point, ``out``_asked the key when it is unknown there."""
    # Rows without a query get a key of their own, so nulls do not gather in one partition.
    asked = rows.withColumn(
        "_ask", F.coalesce(geocode_key(F.col("city"), F.col(query)), F.concat(F.lit("|"), F.col(key).cast("string")))
    )
    table = geocodes.select(F.col("key").alias("_ask"), F.col("lat").alias("_glat"), F.col("lng").alias("_glng"), F.lit(True).alias("_known"))
    joined = asked.join(broadcast_if_small(table), "_ask", "left")
    found = F.col("_known") & F.col("_glat").isNotNull() & F.col("_glng").isNotNull()
    return (
        joined.withColumn(out, F.when(found, F.struct(F.col(query).alias("name"), F.col("_glat").alias("lat"), F.col("_glng").alias("lng"))))
        .withColumn(f"{out}_asked", F.when(F.col(query).isNotNull() & F.col("_known").isNull(), F.col("_ask")))
        .drop("_ask", "_glat", "_glng", "_known")
    )


def resolve_locations(rows: DataFrame, gazetteer: DataFrame, geocodes: DataFrame, key: str) -> DataFrame:
    """Adds ``location`` (location_text, police_station, lat, lng, geo_precision, in_area) and ``unresolved``.

    ``rows`` needs city, title, keywords, text, location_text, lat, lng and a unique ``key``. A given point wins; otherwise
    places named in location_text, then in title, keywords and text, then geocoded text. A locality counts
    against a station only when it lies within 5 km of it. ``unresolved`` lists geocode keys the table does not know.
    """
    given = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    named = rows.withColumn("location_text", F.nullif("location_text", F.lit("")))
    matches = match_places(named.filter(~given), gazetteer, key, STATION_TEXT, NAME_TEXT)
    joined = named.join(matches, key, "left")
    is_station = lambda m: F.col(m)["kind"] == "police_station"
    point = lambda m: F.struct(F.col(m)["name"].alias("name"), F.col(m)["lat"].alias("lat"), F.col(m)["lng"].alias("lng"))
    joined = joined.withColumn("_q1", F.when(~given & F.col("by_location").isNull(), F.col("location_text")))
    joined = _lookup(joined, geocodes, "_q1", "_g1", key)
    joined = joined.withColumns(
        {
            "_station": F.coalesce(F.when(is_station("by_location"), point("by_location")), F.when(is_station("by_text"), point("by_text"))),
            "_locality": F.coalesce(
                F.when(~is_station("by_location"), point("by_location")), F.col("_g1"), F.when(~is_station("by_text"), point("by_text"))
            ),
        }
    )
    joined = joined.withColumn("_q2", F.when(~given & F.col("_locality").isNull(), place_phrase(F.coalesce("text", F.lit("")))))
    joined = _lookup(joined, geocodes, "_q2", "_g2", key)
    joined = joined.withColumn("_locality", F.coalesce("_locality", "_g2"))
    s, l = F.col("_station"), F.col("_locality")
    near = haversine_km(s["lat"], s["lng"], l["lat"], l["lng"]) <= STATION_LOCALITY_MAX_KM
    use_locality = l.isNotNull() & (s.isNull() | near)
    use_station = s.isNotNull() & ~use_locality
    center = lambda attr: F.coalesce(*[F.when(F.col("city") == c.id, F.lit(getattr(c, attr))) for c in CITIES])
    pick = lambda by_given, by_locality, by_station, by_city: (
        F.when(given, by_given).when(use_locality, by_locality).when(use_station, by_station).otherwise(by_city)
    )
    none = F.lit(None).cast("string")
    joined = joined.withColumn(
        "location",
        F.struct(
            pick(F.col("location_text"), l["name"], s["name"], F.col("location_text")).alias("location_text"),
            pick(none, s["name"], s["name"], none).alias("police_station"),
            pick(F.col("lat"), l["lat"], s["lat"], center("lat")).alias("lat"),
            pick(F.col("lng"), l["lng"], s["lng"], center("lng")).alias("lng"),
            pick(F.lit("address"), F.lit("locality"), F.lit("police_station"), F.lit("city")).alias("geo_precision"),
        ),
    )
    at_center = ~given & ~use_locality & ~use_station
    inside = at_center | in_city(F.col("city"), F.col("location.lat"), F.col("location.lng"))
    joined = joined.withColumn("location", F.col("location").withField("in_area", inside))
    return joined.withColumn("unresolved", F.array_compact(F.array("_g1_asked", "_g2_asked"))).select(
        *rows.columns, "location", "unresolved"
    )


def geocode_misses(resolved: DataFrame) -> DataFrame:
    """Geocode keys asked for but not in the table: the work list of an outside geocoder."""
    return resolved.select(F.explode("unresolved").alias("key")).distinct()
