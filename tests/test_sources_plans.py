import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from reportmill.operators.upsert import merge_counts, merge_reports
from reportmill.plans import group_map, heatmap, meta, reports
from reportmill.plans.incremental import read_store, report_store
from reportmill.plans.params import Page, ReportFilter
from reportmill.plans.reprocess import rederive
from reportmill.schemas import GAZETTEER, GEOCODE, REPORT
from reportmill.sources.geojson import point_features
from reportmill.sources.pages import parse_pages
from reportmill.sources.tables import (
    add_geocodes, export_reports_json, load_reports_json, read_geocode_cache, read_reports, sequenced, versions, with_place, write_reports,
)
from reportmill.streaming.live import police_to_table

NOW = datetime(2026, 9, 28, tzinfo=timezone.utc)
DAY = datetime(2026, 9, 20, 6)


def report(i, **values):
    base = dict(
        id=i, event_id=i, city="delhi", title=f"Theft {i}", category="burglary_theft", category_raw=None, source_name="S", source_type="news",
        source_link=f"https://n.in/{i}", incident_datetime=None, incident_datetime_precision="unknown", published_datetime=DAY,
        location_text=None, police_station=None, lat=28.6, lng=77.2, geo_precision="locality", description=None,
    )
    base.update(values)
    base["effective_at"] = base["incident_datetime"] or base["published_datetime"]
    return tuple(base.values())


def table(spark, *rows):
    return spark.createDataFrame(list(rows), REPORT)


def test_days_are_indian_days(spark):
    rows = table(
        spark,
        report("a", published_datetime=datetime(2026, 9, 19, 18, 29)),
        report("b", published_datetime=datetime(2026, 9, 19, 18, 30)),
        report("c", published_datetime=datetime(2026, 9, 20, 18, 29)),
        report("d", published_datetime=datetime(2026, 9, 20, 18, 30)),
        report("e", incident_datetime=datetime(2026, 7, 1)),
    )
    f = ReportFilter("delhi", DAY.date(), DAY.date())
    assert [r.id for r in reports.report_page(rows, f).collect()] == ["c", "b"]
    assert [r.id for r in reports.report_page(rows, f, Page(1, 1)).collect()] == ["b"]


def test_two_ways_to_pick_a_representative(spark):
    rows = table(
        spark,
        report("a", event_id="x", geo_precision="address"),
        report("b", event_id="x", source_type="police_fir_list", geo_precision="city"),
        report("c", event_id="x", source_type="police_fir_list", published_datetime=datetime(2026, 9, 21)),
        report("d", event_id="x", source_type="police_fir_list", published_datetime=datetime(2026, 9, 22)),
        report("e", event_id="y", geo_precision="city", category="fraud"),
        report("f", event_id="z", category="fraud"),
        report("g", event_id="z", category="fraud", geo_precision="city"),
    )
    best = {r.event_id: r.id for r in heatmap.representatives(rows).collect()}
    assert best["x"] == "c"
    f = ReportFilter("delhi", DAY.date(), datetime(2026, 9, 25).date())
    cells = heatmap.heatmap(rows, f)
    assert [(r["count"], r.categories) for r in cells.collect()] == [(2, {"burglary_theft": 1, "fraud": 1})]
    derived = group_map.derive(rows.withColumn("category", F.lit("fraud")))
    assert {(r.id, r.on_map) for r in derived.collect()} == {("d", True), ("f", True), ("e", False)}
    assert {r.group: r["count"] for r in group_map.group_counts(derived).collect()}["scam"] == 2


def test_empty_results(spark):
    none = table(spark, report("a")).filter("false")
    f = ReportFilter("delhi", DAY.date(), DAY.date())
    assert tuple(heatmap.heatmap_totals(heatmap.heatmap(none, f)).first()) == (0, 0)
    assert tuple(heatmap.cells_bounds(heatmap.heatmap(none, f), 8).first()) == (None,) * 4
    assert tuple(meta.date_range(none).first()) == (None, None)


def test_filters_reach_the_scan(spark, tmp_path):
    write_reports(table(spark, report("a"), report("b", city="goa")), str(tmp_path))
    f = ReportFilter("delhi", DAY.date(), DAY.date())
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = heatmap.heatmap(read_reports(spark, str(tmp_path), NOW), f)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(effective_at" in plan and "PartitionFilters: [isnotnull(city" in plan
    assert "description" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_table_versions_and_json(spark, tmp_path):
    root = str(tmp_path / "t")
    assert read_reports(spark, root).count() == 0 and versions(spark, root) == []
    write_reports(table(spark, report("a")), root)
    write_reports(read_reports(spark, root).unionByName(table(spark, report("b", published_datetime=datetime(2025, 1, 1)))), root)
    assert versions(spark, root) == [1, 2]
    assert read_reports(spark, root).count() == 2 and read_reports(spark, root, NOW).count() == 1
    out = str(tmp_path / "json")
    export_reports_json(read_reports(spark, root), out)
    back = load_reports_json(spark, out, NOW)
    assert [(r.id, r.published_datetime) for r in back.collect()] == [("a", DAY)] and "group" in back.columns
    assert load_reports_json(spark, str(tmp_path / "no"), NOW).count() == 0
    many = table(spark, *[report(f"m{i:04d}", title=f"t\n{i}") for i in range(1000)])
    export_reports_json(many, str(tmp_path / "many"))
    for again in (load_reports_json(spark, str(tmp_path / "many"), NOW), load_reports_json(spark, str(tmp_path / "many"), None)):
        assert sorted((r.id, r.title) for r in again.collect()) == sorted((r.id, r.title) for r in many.collect())
    lines = [x.value for x in spark.read.text(str(tmp_path / "many")).collect()]
    (tmp_path / "array.json").write_text("[\n" + ",\n".join(lines) + "\n]")
    assert load_reports_json(spark, str(tmp_path / "array.json"), NOW, array=True).count() == 1000


def test_line_order_follows_names_and_lines(spark, tmp_path):
    """The small first file is read after the large one, yet its line comes first."""
    (tmp_path / "a.jsonl").write_text("first\n")
    (tmp_path / "b.jsonl").write_text("".join(f"b{i}\n" for i in range(3000)))
    (tmp_path / "c.jsonl").write_text("".join(f"c{i}\n" for i in range(5)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sequenced(with_place(spark.read.text(str(tmp_path)))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [r.value for r in sorted(rows, key=lambda r: r.seq)]
    assert got == ["first", *[f"b{i}" for i in range(3000)], *[f"c{i}" for i in range(5)]] and len({r.seq for r in rows}) == len(got)


def test_geocode_cache(spark, tmp_path):
    path = tmp_path / "cache.json"
    path.write_text(json.dumps({"goa|a": {"lat": 1.0, "lng": 2.0, "display_name": "A"}, "goa|b": {"lat": None, "lng": None, "display_name": None}}))
    cache = read_geocode_cache(spark, str(path))
    assert cache.count() == 2 and read_geocode_cache(spark, str(tmp_path / "x")).count() == 0
    more = add_geocodes(cache, spark.createDataFrame([("goa|b", 3.0, 4.0, "B")], GEOCODE))
    assert {r.key: r.lat for r in more.collect()} == {"goa|a": 1.0, "goa|b": 3.0}


def test_upsert_and_idempotence(spark):
    old = table(spark, report("a"), report("b", title="Bank fraud in Margao"))
    fresh = table(spark, report("n1", source_link="https://n.in/a", title="Other words entirely"), report("n2", source_link="https://n.in/a", title="Last one wins here")).withColumn(
        "seq", F.when(F.col("id") == "n1", 1).otherwise(2).cast("long")
    )
    merged = merge_reports(old, fresh)
    assert {r.source_link: r.id for r in merged.collect()} == {"https://n.in/a": "n2", "https://n.in/b": "b"}
    assert tuple(merge_counts(old, fresh).first()) == (2, 0, 2)
    again = merge_reports(merged, fresh)
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))


def test_rederive_moves_office_rows(spark):
    rows = table(
        spark,
        report("a", police_station="Crime Branch HQ", title="Theft in Hauz Khas, aged 40", description="x s/o y"),
        report("b", source_type="police_fir_list", category="fraud", title="Murder"),
    )
    gaz = spark.createDataFrame([(0, "delhi", "Hauz Khas", "locality", 28.55, 77.2)], GAZETTEER)
    out = {r.id: r for r in rederive(rows, gaz, spark.createDataFrame([], GEOCODE)).collect()}
    assert (out["a"].location_text, out["a"].police_station, out["a"].lat, out["a"].title, out["a"].description) == ("Hauz Khas", None, 28.55, "Theft in Hauz Khas,", "x")
    assert out["b"].category == "fraud"


def test_points_skip_bad_positions(spark):
    rows = table(spark, report("a"), report("b", lat=float("nan"))).withColumn("group", F.lit("scam"))
    features = point_features(rows).collect()
    assert len(features) == 1 and json.loads(features[0].feature)["properties"]["color"] == "#d95926"


def test_pages(spark):
    ld = '<script type="application/ld+json">[{"@type":"Person"},{"@type":"BlogPosting","headline":"A &amp; B","datePublished":"2026-09-20","articleBody":"Body. You can also check: ads"}]</script>'
    plain = '<title> T </title><meta name="keywords" content="a, ,b"><article><p>One<p>Two <b>bold</b><div>no</div></article><p>out</p>'
    rows = [
        ("u1", "goa", "S", 200, "html", ld, "f", None), ("u2", "goa", "S", 200, "html", plain, "f", DAY), ("u3", "goa", "S", 200, "html", "<p>x</p>", None, DAY),
        ("u4", "goa", "S", 404, "html", plain, "f", DAY), ("u5", "goa", "S", 200, "markdown", "intro\n# Head\n\n" + "w" * 90, "f", DAY), ("u6", "goa", "S", 200, "html", plain, "f", None),
    ]
    df = spark.createDataFrame(rows, "url string, city string, source_name string, status int, format string, body string, fallback_title string, fallback_published_at timestamp")
    got = {r.url: r for r in parse_pages(df).collect()}
    assert set(got) == {"u1", "u2", "u5"}
    assert (got["u1"].title, got["u1"].text) == ("A & B", "Body.")
    assert (got["u2"].title, got["u2"].text, got["u2"].keywords) == ("T", "One\nTwo bold", ["a", "b"])
    assert (got["u5"].title, got["u5"].description) == ("Head", "w" * 90)


def test_stream_merges_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"city": "delhi", "title": "Robbery", "source_link": "https://p.in/a", "fir_no": "1", "published_datetime": "2026-09-01", "lat": "28.5", "lng": "77.2"}
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(line) + "\n{bad\n")
    gaz, geo = spark.createDataFrame([], GAZETTEER), spark.createDataFrame([], GEOCODE)
    for _ in range(2):
        police_to_table(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "state"), gaz, geo, clock=lambda: NOW).awaitTermination()
    assert report_store(spark, str(tmp_path / "t")).numbers() == [1]
    assert [r.source_link for r in read_store(report_store(spark, str(tmp_path / "t"))).collect()] == ["https://p.in/a#1"]


def test_reprocess_runs_the_text_rules_once(spark, monkeypatch):
    """grouping reads the reports several times, and each time the text rules ran; rows of no office went through them once more."""
    from reportmill.plans import reprocess as plan

    row = dict.fromkeys(c.split()[0] for c in REPORT.split(","))
    rows = [row | dict(id=str(i), city="goa", title=t, description="A theft", source_type="news", police_station=s) for i, (t, s) in enumerate([("Chain snatched", None), ("Theft", "Crime Branch HQ"), ("Fraud", "Panaji PS")])]
    df = spark.createDataFrame(rows, REPORT)
    gazetteer, geocodes = spark.createDataFrame([], GAZETTEER), spark.createDataFrame([], GEOCODE)
    want = {r.id: (r.title, r.category, r.police_station) for r in plan.rederive(df, gazetteer, geocodes).collect()}
    monkeypatch.setattr(plan, "assign_events", lambda reports: reports)
    done = plan.reprocess(df, gazetteer, geocodes)
    assert {r.id: (r.title, r.category, r.police_station) for r in done.collect()} == want and len(want) == 3 and want["1"][2] is None
    assert "rlike" not in done._jdf.queryExecution().optimizedPlan().toString().lower() and done.inputFiles()
