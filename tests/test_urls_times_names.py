import hashlib
from datetime import datetime, timezone

from pyspark.sql import functions as F

from reportmill.functions import hexgrid, names, times, tokens, urls


def test_canonical_url(evaluate):
    rows = [
        ("http://WWW.News.in/a/b/?x=1#f", "https://www.news.in/a/b"),
        ("https://news.in", "https://news.in/"),
        ("https://news.in/", "https://news.in/"),
        ("https://news.in/a//", "https://news.in/a/"),
        ("http://news.in:80/a", "https://news.in/a"),
        ("https://news.in:8443/a", "https://news.in:8443/a"),
        ("https://news.in/a b/é", "https://news.in/a%20b/%C3%A9"),
        ("nonsense", None),
        ("", None),
        (None, None),
    ]
    assert evaluate(urls.canonical_url, [r[:1] for r in rows], "u string") == [r[1] for r in rows]


def test_slug_titles(evaluate):
    rows = [
        ("https://t.in/city/goa/two-held-for-theft/articleshow/9876543.cms", "two held for theft", "two held for theft"),
        ("https://h.in/cities/delhi-news/man-robbed-near-metro-101726000000000.html", "man robbed near metro", "man robbed near metro"),
        ("https://h.in/one-two/six-ten", "one two", "one two"),
        ("https://h.in/plain", "", ""),
        ("https://h.in/caf%C3%A9-fire+a", "café fire+a", "café fire+a"),
        ("https://h.in/bad%zz-name", None, "bad%zz name"),
        ("oops", None, ""),
        ("https://h.in/articleshow/1", "", ""),
    ]
    assert evaluate(urls.slug_title, [r[:1] for r in rows], "u string") == [r[1] for r in rows]
    assert evaluate(urls.slug_title_lenient, [r[:1] for r in rows], "u string") == [r[2] for r in rows]


def test_police_links(evaluate):
    rows = [
        ("https://P.gov.in/list.pdf?y=2026#old", "police_fir_list", "12/2026", None, "https://p.gov.in/list.pdf?y=2026#12%2F2026"),
        ("http://p.gov.in", "police_press_release", None, " e (1)~!' ", "http://p.gov.in/#e%20(1)~!'"),
        ("https://p.gov.in/a", "news", "12", "e", "https://p.gov.in/a"),
        ("https://p.gov.in/a", "police_fir_list", None, None, "https://p.gov.in/a"),
        ("bad", "news", None, None, None),
    ]
    assert evaluate(urls.police_link, [r[:4] for r in rows], "u string, s string, f string, e string") == [r[4] for r in rows]


def test_report_id(evaluate):
    assert evaluate(urls.report_id, [("https://n.in/é",)], "u string") == [hashlib.sha1("https://n.in/é".encode()).hexdigest()[:12]]


def _utc(*a):
    return datetime(*a)


def test_dates(evaluate):
    rows = [
        ("2026-09-20", _utc(2026, 9, 19, 18, 30)),
        ("2026-09-20 10:15", _utc(2026, 9, 20, 4, 45)),
        ("2026-09-20T10:15:30.5", _utc(2026, 9, 20, 4, 45, 30, 500000)),
        ("2026-09-20T10:15:30Z", _utc(2026, 9, 20, 10, 15, 30)),
        ("2026-09-20T10:15:30-0100", _utc(2026, 9, 20, 11, 15, 30)),
        ("2026-02-30", _utc(2026, 3, 1, 18, 30)),
        ("2026-13-01", None),
        ("soon", None),
        ("", None),
        (None, None),
    ]
    assert evaluate(times.parse_police_date, [r[:1] for r in rows], "d string") == [r[1] for r in rows]
    feeds = [
        ("Fri, 25 Sep 2026 10:00:00 +0530", _utc(2026, 9, 25, 4, 30)),
        ("25 Sep 2026 10:00:00 GMT", _utc(2026, 9, 25, 10)),
        ("2026-09-25T10:00:00+05:30", _utc(2026, 9, 25, 4, 30)),
        ("yesterday", None),
    ]
    assert evaluate(times.parse_feed_date, [r[:1] for r in feeds], "d string") == [r[1] for r in feeds]


def test_effective_time_does_not_fall_back(evaluate):
    rows = [("2026-09-20T00:00:00Z", "2026-01-01T00:00:00Z"), ("junk", "2026-01-01T00:00:00Z"), (None, "2026-01-01T00:00:00Z")]
    assert evaluate(times.effective_time, rows, "i string, p string") == [_utc(2026, 9, 20), None, _utc(2026, 1, 1)]


def test_incident_times(evaluate):
    # Published Friday 25 September 2026, 11:30 IST.
    pub = datetime(2026, 9, 25, 6, 0, tzinfo=timezone.utc)
    jan = datetime(2026, 1, 2, 6, 0, tzinfo=timezone.utc)
    early = datetime(2026, 9, 24, 19, 0, tzinfo=timezone.utc)  # already Friday in India
    rows = [
        ("It happened on Friday.", pub, "2026-09-25T00:00:00+05:30", "date"),
        ("It happened on Monday around 11.30pm, police said", pub, "2026-09-21T23:30:00+05:30", "exact"),
        ("Seen on friday at 12 am.", early, "2026-09-25T00:00:00+05:30", "exact"),
        ("The theft on 11th September was reported today", pub, "2026-09-11T00:00:00+05:30", "date"),
        ("on November 3 a shop", pub, "2025-11-03T00:00:00+05:30", "date"),
        ("on February 30 a shop", pub, "2026-03-02T00:00:00+05:30", "date"),
        ("on 45 March, then yesterday", pub, "2026-09-24T00:00:00+05:30", "date"),
        ("late last night at 10 p.m. near", pub, "2026-09-24T22:00:00+05:30", "exact"),
        ("this morning at 13 pm", pub, "2026-09-25T00:00:00+05:30", "date"),
        ("No date at all", pub, None, "unknown"),
        ("x" * 1500 + " yesterday", pub, None, "unknown"),
        ("on the intervening night of 20/21 at 2 am", pub, "2026-09-20T00:00:00+05:30", "date_range"),
        ("night of 30-31", jan, "2025-12-30T00:00:00+05:30", "date_range"),
        ("night of 30/1 September", pub, "2025-09-30T00:00:00+05:30", "date_range"),
        ("night of 20th/21st August, 2025", pub, "2025-08-20T00:00:00+05:30", "date_range"),
        ("night of 20/21.09.25", pub, "2025-09-20T00:00:00+05:30", "date_range"),
        ("night of 20/21.11", pub, "2025-11-20T00:00:00+05:30", "date_range"),
        ("night of 20/25 yesterday", pub, "2026-09-24T00:00:00+05:30", "date"),
        ("night of 30/31.02.2026, on Tuesday", pub, "2026-09-22T00:00:00+05:30", "date"),
    ]
    got = evaluate(
        lambda t, p: F.struct(times.ist_iso(times.incident_time(t, p)["incident_at"]), times.incident_time(t, p)["precision"]),
        [(t, p) for t, p, _, _ in rows],
        "t string, p timestamp",
    )
    assert [tuple(g) for g in got] == [(a, b) for _, _, a, b in rows]


def test_title_tokens(evaluate):
    rows = [("Two men held for robbing shops in Saket, gold chains looted",), ("Police in Delhi",), (None,), ("kings bring rings red bed",)]
    got = evaluate(tokens.title_tokens, rows, "t string")
    assert got == [["two", "men", "robb", "shop", "saket", "gold", "chain", "loot"], [], [], ["king", "bring", "ring", "red", "bed"]]


def test_jaccard(evaluate):
    assert evaluate(tokens.jaccard, [(["a", "b"], ["b", "c"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>") == [1 / 3, 0, 1]


def test_normal_names(evaluate):
    rows = [
        ("Saket Police Station", "saket"),
        ("São José P. S.", "sao jose"),
        ("Hauz-Khas  PS", "hauz khas"),
        ("Mapusa Thana", "mapusa"),
        ("Café ﬁrst", "cafe first"),
        (None, None),
    ]
    assert evaluate(names.normalize_name, [r[:1] for r in rows], "t string") == [r[1] for r in rows]


def test_place_phrases(evaluate):
    rows = [
        ("He was found near Green Park Extension, police said", "Green Park Extension"),
        ("of Police in Delhi and at Hauz Khas Police", "Hauz Khas"),
        ("in Goa", None),
        ("from Rex. Then", "Rex. Then"),
        ("at Lodhi.", "Lodhi"),
        ("in the market", None),
    ]
    assert evaluate(names.place_phrase, [r[:1] for r in rows], "t string") == [r[1] for r in rows]


def test_hex_cells_hold_their_points(spark):
    points = spark.range(3000).select(
        F.lit("delhi").alias("city"),
        (F.lit(28.4) + F.rand(1) * 0.49).alias("lat"),
        (F.lit(76.83) + F.rand(2) * 0.52).alias("lng"),
    )
    for res in (5, 7, 10):
        cells = points.withColumn("cell", hexgrid.cell_id(F.col("city"), F.col("lat"), F.col("lng"), res))
        cells = cells.withColumn("c", hexgrid.cell_center(F.col("cell"), res))
        far = names.haversine_km(F.col("lat"), F.col("lng"), F.col("c.lat"), F.col("c.lng")) > hexgrid.edge_km(res) * 1.01
        moved = hexgrid.cell_id(F.col("city"), F.col("c.lat"), F.col("c.lng"), res) != F.col("cell")
        assert cells.filter(far | moved).count() == 0
        ring = cells.select(hexgrid.cell_ring(F.col("cell"), res).alias("r")).first().r
        assert len(ring) == 7 and ring[0] == ring[6]
