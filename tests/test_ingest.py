from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from reportmill.config import STOP_NAMES
from reportmill.operators.eligibility import eligibility_stats, eligible
from reportmill.operators.hotkeys import first_by, join_unique
from reportmill.operators import places
from reportmill.operators.places import match_places, name_index, resolve_locations
from reportmill.operators.police import locate_police_reports, map_police_rows, reject_counts
from reportmill.operators.sampling import sample_evenly, sample_with_refill
from reportmill.plans.params import parse_area, parse_filter, parse_page, parse_resolution
from reportmill.schemas import CANDIDATE, GAZETTEER, GEOCODE
from reportmill.sources.tables import parse_police_lines

NOW = datetime(2026, 9, 28, tzinfo=timezone.utc)


def ranks(n, size):
    if size <= n:
        return list(range(size))
    if n <= 0:
        return []
    if n == 1:
        return [(size - 1) // 2]
    return [int(i * ((size - 1) / (n - 1)) + 0.5) for i in range(n)]


@pytest.mark.parametrize("bucket_rows", [1_000_000, 3])
def test_even_sampling(spark, bucket_rows):
    """Same instants, several groups and every size of n; tiny buckets force all levels of counting."""
    rows = [("a", i, datetime(2026, 1, 1) + timedelta(seconds=(i * 7919) % 40 * 900)) for i in range(101)]
    rows += [("b", 1000 + i, datetime(2026, 1, 1)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, seq bigint, t timestamp")
    for n in (0, 1, 5, 7, 200):
        got = sorted(r.seq for r in sample_evenly(df, ["g"], n, "t", "seq", bucket_rows).collect())
        want = []
        for g in "ab":
            ordered = [r[1] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))]
            want += [ordered[k] for k in ranks(n, len(ordered))]
        assert got == sorted(want), n


def test_refill_stops_when_full_or_empty(spark):
    rows = [("a", i, datetime(2026, 1, 1) + timedelta(hours=i)) for i in range(30)] + [("b", 100 + i, datetime(2026, 1, 1)) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, seq bigint, t timestamp")
    tried = sample_with_refill(df, ["g"], 5, "t", "seq", lambda p: p.withColumn("outcome", F.when(F.col("seq") % 2 == 0, "stored").otherwise("failed")))
    out = tried.collect()
    assert len({r.seq for r in out}) == len(out)
    assert sum(r.g == "a" and r.outcome == "stored" for r in out) == 5
    assert sorted(r.seq for r in out if r.g == "b") == [100, 101, 102]


def test_eligibility_order_of_reasons(spark):
    at = datetime(2026, 9, 20)
    rows = [
        (1, "toi", "http://N.in/theft-in-saket/?x=1", "Theft in Saket", at, "delhi", None),
        (2, "toi", "https://n.in/theft-in-saket", "Theft in Saket again", at, "delhi", None),
        (3, "toi", "https://n.in/b", "Theft", datetime(2020, 1, 1), "delhi", None),
        (4, "toi", "https://n.in/c", "Rain floods market", at, "delhi", None),
        (5, "toi", "https://n.in/stored", "Robbery", at, "delhi", None),
        (6, "toi", "https://n.in/d", "Robbery", None, "delhi", None),
        (7, "toi", "nonsense", "Robbery", at, "delhi", None),
        (8, "ht", "https://n.in/theft-in-saket", "Theft in Saket", at, "goa", None),
    ]
    found = spark.createDataFrame(rows, CANDIDATE)
    existing = spark.createDataFrame([("https://n.in/stored",)], "source_link string")
    cutoff = datetime(2026, 3, 28, tzinfo=timezone.utc)
    assert sorted((r.seq, r.url) for r in eligible(found, existing, cutoff, NOW).collect()) == [(1, "https://n.in/theft-in-saket"), (8, "https://n.in/theft-in-saket")]
    stats = {r.source: r.asDict() for r in eligibility_stats(found, existing, cutoff, NOW).collect()}
    assert stats["toi"] == dict(source="toi", discovered=7, undated=1, out_of_window=1, prefiltered=2, duplicates=1, existing=1, eligible=1)


def test_hot_keys_join_and_pick(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("m"))
    plain = sorted(map(tuple, big.join(small.drop("w"), "k").collect()))
    assert sorted(map(tuple, join_unique(big, small, ["k"], "w", None, 50, 2).collect())) == plain
    best = {r.k: r.id for r in first_by(big, ["k"], [-F.col("id")]).collect()}
    assert best[0] == 999 and best[1] == 1


GAZ = [
    (0, "delhi", "Hauz Khas", "locality", 28.55, 77.20), (1, "delhi", "Saket", "police_station", 28.52, 77.21), (2, "delhi", "Saket", "locality", 28.525, 77.213),
    (3, "delhi", "Rohini Sector 7", "locality", 28.71, 77.11), (4, "delhi", "Rohini", "locality", 28.74, 77.10), (5, "delhi", "Far Town", "police_station", 28.85, 77.0),
    (6, "delhi", "Cyber Police Station", "police_station", 28.6, 77.2), (7, "delhi", "Market", "locality", 28.6, 77.2), (8, "goa", "Delhi", "locality", 15.4, 73.9), (9, "delhi", "New Delhi", "locality", 28.6, 77.2),
]
GEO = [("delhi|quiet lane", 28.6, 77.3, "x"), ("delhi|lost place", None, None, None), ("goa|outside", 28.0, 77.0, "far")]


def test_names_in_texts_equal_brute_force(spark):
    """Names of one to three words that share first words, in titles, keywords and texts; only words that begin a name make keys."""
    words = ["rohini", "sector", "green", "park", "lake", "view", "aaaa", "bbbb", "cccc", "dddd"]
    pick = lambda i, k: [words[(i * 7 + k * k * 3 + i * k) % 10] for k in range(k)]
    names = sorted({" ".join(pick(i, 1 + i % 3)) for i in range(40)} - set(STOP_NAMES))
    gaz = spark.createDataFrame([(i, "delhi", n.title(), "locality", 28.5, 77.2) for i, n in enumerate(names)], GAZETTEER)
    rows = [(i, "goa" if i % 9 == 8 else "delhi", " ".join(pick(i, i % 4)), [" ".join(pick(i + 5, 2))], " ".join(pick(i + 3, 30)), None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, city string, title string, keywords array<string>, text string, location_text string")
    want = {}
    for i, city, title, keywords, text, _ in rows:
        hits = [(hay, -len(n), p, n) for hay, h in enumerate((title, keywords[0], text)) for p, n in enumerate(names) if f" {n} " in f" {h} "]
        if hits and city == "delhi":
            want[i] = min(hits)[3].title()
    assert {r.id: r.by_text.name for r in match_places(df, gaz, "id").collect()} == want and want
    far = spark.createDataFrame([(1, "delhi", "", [""], "x y z " * 200 + "rohini sector", None)], df.schema)
    index = name_index(spark.createDataFrame([(1, "delhi", "Rohini Sector Park", "locality", 28.5, 77.2), (2, "delhi", "Rohini", "police_station", 28.5, 77.2)], GAZETTEER))
    assert sorted(r.gram for r in places._keys(places._passes(far, "id", 3), index).collect()) == ["rohini", "rohini sector"]


def test_names_are_found_in_whole_texts(spark):
    """A name and a station's phrase far beyond the first thousands of characters; resolving locations looks only as far as it says."""
    gaz = spark.createDataFrame([(1, "delhi", "Rohini Sector", "locality", 28.5, 77.2), (2, "delhi", "Kala Ghat", "police_station", 28.6, 77.3)], GAZETTEER)
    far = "quiet words " * 1000
    rows = [(1, "delhi", "", [""], far + "in rohini sector", None), (2, "delhi", "", [""], far + "rohini sector. Men of Old Kala Ghat PS came.", None), (3, "delhi", "", [""], far, None)]
    df = spark.createDataFrame(rows, "id int, city string, title string, keywords array<string>, text string, location_text string")
    assert {r.id: r.by_text.name for r in match_places(df, gaz, "id").collect()} == {1: "Rohini Sector", 2: "Kala Ghat"}
    assert match_places(df, gaz, "id", 3000, 1500).isEmpty()


def located(spark, rows):
    schema = "id int, city string, title string, keywords array<string>, text string, location_text string, lat double, lng double"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    out = resolve_locations(df, spark.createDataFrame(GAZ, GAZETTEER), spark.createDataFrame(GEO, GEOCODE), "id").orderBy("id").collect()
    return [(*r.location, r.unresolved) for r in out]


def test_locations(spark):
    got = located(
        spark,
        [
            ("delhi", "x", [], "", "Given", 28.5, 77.1),
            ("delhi", "Theft in Rohini Sector 7 house", [], "", None, None, None),
            ("delhi", "x", ["Hauz Khas"], "A team of Saket police station came", None, None, None),
            ("delhi", "x", [], "near Hauz Khas, said the Far Town PS", "Hauz Khas", None, None),
            ("delhi", "x", [], "he fled from Quiet Lane", None, None, None),
            ("delhi", "x", [], "he fled from Lost Place", None, None, None),
            ("delhi", "x", [], "he fled from Nowhere Known", "Quiet Lane", None, None),
            ("goa", "x", [], "", "Outside", None, None),
            ("goa", "Delhi market news", [], "Cyber police station", None, None, None),
            ("delhi", "x", [], "seen at Odd Corner", "Other Spot", None, None),
        ],
    )
    assert got == [
        ("Given", None, 28.5, 77.1, "address", True, []),
        ("Rohini Sector 7", None, 28.71, 77.11, "locality", True, []),
        ("Saket", "Saket", 28.52, 77.21, "police_station", True, ["delhi|saket"]),
        ("Far Town", "Far Town", 28.85, 77.0, "police_station", True, []),
        ("Quiet Lane", None, 28.6, 77.3, "locality", True, []),
        (None, None, 28.6139, 77.209, "city", True, []),
        ("Quiet Lane", None, 28.6, 77.3, "locality", True, []),
        ("Outside", None, 28.0, 77.0, "locality", False, []),
        ("Delhi", None, 15.4, 73.9, "locality", True, []),
        ("Other Spot", None, 28.6139, 77.209, "city", True, ["delhi|other spot", "delhi|odd corner"]),
    ]


LINES = [
    '{"city":"delhi","title":"Robbery at Saket","source_link":"https://P.in/a?d=1#x","fir_no":"7/26","published_datetime":"2026-09-01","lat":"28.5","lng":77.2,"extra":1}',
    '{"city":"delhi","title":"Two held","mentions":[{"source_name":"Desk","url":"","published_at":"2026-09-03"},{"url":"https://p.in/list","published_at":"2026-09-02T10:00"}],"police_station":"Saket"}',
    "  ",
    "{broken",
    '{"city":"delhi","title":"x","source_link":"https://p.in/1","published_datetime":"2026-09-01","is_crime_incident":false}',
    '{"city":"mumbai","title":"x"}',
    '{"city":"delhi","title":"x","source_type":"blog"}',
    '{"city":"delhi","title":"x","source_link":"","mentions":[{"url":"https://p.in/1"}]}',
    '{"city":"delhi","title":"x","source_link":"nope"}',
    '{"city":"delhi","title":" s/o Ravi ","source_link":"https://p.in/1"}',
    '{"city":"delhi","title":"x","source_link":"https://p.in/1","published_datetime":"soon"}',
    '{"city":"delhi","title":"x","source_link":"https://p.in/1","published_datetime":"2025-09-01"}',
    '{"city":"delhi","title":"x","source_link":"https://p.in/1","published_datetime":"2026-09-01","lat":12.9,"lng":77.5}',
    '{"city":"delhi","title":"x","source_link":"https://p.in/2","published_datetime":"2026-09-01","lat":"NaN","lng":77.5,"location_text":"Hauz Khas"}',
]


def test_police_rows(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "seq bigint, value string")
    mapped = map_police_rows(parse_police_lines(lines), NOW)
    rows = {r.seq: r for r in mapped.collect()}
    assert {k: r.reason for k, r in rows.items()} == {
        0: None, 1: None, 3: "invalid JSON", 4: "not a crime incident", 5: "unknown city mumbai", 6: "unknown source_type blog", 7: "no source_link",
        8: "bad source_link nope", 9: "no title", 10: "no published_datetime", 11: "older than the 6-month window", 12: "out of area", 13: None,
    }
    first, second = rows[0], rows[1]
    assert (first.source_link, first.category, first.geo_precision, first.source_name, first.needs_geo) == ("https://p.in/a?d=1#7%2F26", "robbery", "locality", "Police", False)
    assert (second.source_link, second.source_type, second.published_datetime) == ("https://p.in/list", "police_press_release", datetime(2026, 9, 2, 4, 30))
    placed = locate_police_reports(mapped, spark.createDataFrame(GAZ, GAZETTEER), spark.createDataFrame(GEO, GEOCODE))
    at = {r.seq: (r.location_text, r.police_station, r.lat, r.geo_precision) for r in placed.filter("reason is null").collect()}
    assert at[1] == ("Saket", "Saket", 28.52, "police_station") and at[13] == ("Hauz Khas", None, 28.55, "locality")
    assert {r.reason: r.n for r in reject_counts(placed).collect()}["no title"] == 1


def test_parameters():
    f = parse_filter({"city": "goa", "to": "2026-09-20", "categories": "fraud,??", "sources": "police"}, NOW)
    assert (str(f.from_day), f.categories, f.sources) == ("2026-03-20", ("fraud",), ("police",))
    assert str(parse_filter({"city": "goa"}, datetime(2026, 9, 27, 20, tzinfo=timezone.utc)).to_day) == "2026-09-28"
    assert parse_resolution({}) == 8 and parse_resolution({"res": "10"}) == 10
    assert (parse_page({"limit": "0"}).limit, parse_page({"limit": "999"}).limit, parse_page({}).limit) == (1, 200, 50)
    assert parse_area({}) is None
    for bad in ({}, {"city": "rome"}, {"city": "goa", "to": "2026-02-30"}, {"city": "goa", "from": "x"}, {"city": "goa", "from": "2026-09-02", "to": "2026-09-01"}, {"city": "goa", "sources": ""}, {"city": "goa", "sources": "tv"}):
        with pytest.raises(ValueError):
            parse_filter(bad, NOW)
    for read, bad in ((parse_page, {"limit": "-1"}), (parse_page, {"offset": "a"}), (parse_resolution, {"res": "4"}), (parse_resolution, {"res": "7.5"}), (parse_area, {"bbox": "1,2,3"}), (parse_area, {"bbox": "1,2,3,nan"}), (parse_area, {"cell": "goa:11:0:0"})):
        with pytest.raises(ValueError):
            read(bad)
