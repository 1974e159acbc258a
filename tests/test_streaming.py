"""News streams: restarts, late and repeated rows, and the same code for a batch and a stream."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from reportmill.plans.collect import collect
from reportmill.plans.incremental import read_store, report_store
from reportmill.schemas import GAZETTEER, GEOCODE, LANDED, REPORT
from reportmill.sources import feeds
from reportmill.streaming.news import news_to_table, payloads, recent_links

NOW = datetime(2026, 9, 28, tzinfo=timezone.utc)
SINCE = NOW - timedelta(days=60)
ROWS = "url string, source string, published_at timestamp"
PAGES = "url string, city string, source_name string, status int, format string, body string, fallback_title string, fallback_published_at timestamp"


def feed(number, stories):
    """An RSS payload of (story, day) pairs."""
    items = "".join(
        f"<item><title>Theft case {n}</title><link>https://h.in/cities/delhi-news/theft-{n}.html</link><pubDate>{datetime(2026, 9, d):%d %b %Y} 10:00:00 +0000</pubDate></item>" for n, d in stories
    )
    return ("ht", "u", None, 200, "rss", f"<rss><channel>{items}</channel></rss>", number)


def page(n):
    return (f"https://h.in/cities/delhi-news/theft-{n}.html", "delhi", "H", 200, "markdown", f"# Theft case {n}\n\n" + "Two men broke into the flat and took all that was of any worth to them, and then left by the door. ", None, datetime(2026, 9, 2, 10))


def land(spark, folder, *rows):
    feeds.land(spark.createDataFrame(list(rows), LANDED).coalesce(1), folder)


@pytest.fixture
def world(spark):
    pages = spark.createDataFrame([page(n) for n in range(12)], PAGES)
    return pages, spark.createDataFrame([], GAZETTEER), spark.createDataFrame([], GEOCODE)


def shown(rows):
    return sorted((r.source_link, r.title, r.event_id) for r in rows.collect())


def test_a_stream_that_breaks_off_and_starts_again_equals_one_batch(spark, tmp_path, world):
    pages, gazetteer, geocodes = world
    landed, root, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    land(spark, landed, feed(0, [(0, 1), (1, 2), (2, 3)]))
    land(spark, landed, feed(1, [(2, 3), (3, 4), (4, 5)]))
    calls = []

    def broken():
        calls.append(1)
        if len(calls) == 2:  # the clock of the second batch
            raise RuntimeError("the power went off")
        return NOW

    start = lambda clock: news_to_table(spark, landed, lambda: pages, root, state, gazetteer, geocodes, SINCE, clock, files_per_trigger=1)
    with pytest.raises(Exception, match="the power went off"):
        start(broken).awaitTermination()
    assert len(shown(read_store(report_store(spark, root)))) == 3
    land(spark, landed, feed(2, [(0, 1), (7, 8)]))
    start(lambda: NOW).awaitTermination()
    found = feeds.discover(payloads(spark, landed), "live", SINCE, NOW)
    batch = collect(found, pages, spark.createDataFrame([], REPORT), gazetteer, geocodes, NOW, 1000).merged
    streamed = read_store(report_store(spark, root))
    assert shown(streamed) == shown(batch) and streamed.count() == 6
    number = max(report_store(spark, root).numbers())
    start(lambda: NOW).awaitTermination()  # nothing new has landed
    assert max(report_store(spark, root).numbers()) == number


def test_late_and_repeated_rows_and_a_restart(spark, tmp_path):
    landed, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = lambda d, h=0: datetime(2026, 5, d, h)

    def send(*rows):
        spark.createDataFrame(list(rows), ROWS).coalesce(1).write.mode("append").parquet(landed)

    def run():
        rows = recent_links(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(landed), "2 days", "published_at", ("source", "url"))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.url, r.published_at) for r in spark.read.schema(ROWS).parquet(out).collect())

    send(("a", "s", day(1)), ("a", "s", day(1)), ("b", "s", day(1)), ("a", "other", day(1)), ("x", "s", None), ("y", "s", datetime(2999, 1, 1)))
    send(("a", "s", day(2)), ("c", "s", day(5)))  # a repeat inside the delay, though under a new time
    first = run()
    assert first == [("a", day(1)), ("a", day(1)), ("b", day(1)), ("c", day(5))]
    send(("late", "s", day(2)), ("c", "s", day(5)), ("d", "s", day(6)))  # days behind, and a repeat after a restart
    send(("e", "s", day(20)))
    send(("a", "s", day(21)), ("c", "s", day(5)), ("e", "s", day(20, 5)))  # told again long after: a new story; c is late now
    assert run() == sorted([*first, ("d", day(6)), ("e", day(20)), ("a", day(21))])


def test_the_upper_end_of_a_stream_moves_with_the_clock(spark, tmp_path, world):
    pages, gazetteer, geocodes = world
    landed, root, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    times = [datetime(2026, 9, 3, tzinfo=timezone.utc), NOW]
    for number, clock in enumerate(times):
        land(spark, landed, feed(number, [(5, 2), (6, 20)]))
        news_to_table(spark, landed, lambda: pages, root, state, gazetteer, geocodes, SINCE, lambda c=clock: c).awaitTermination()
        # Story 6 lies in the future of the first run.
        assert len(shown(read_store(report_store(spark, root)))) == number + 1
    assert read_store(report_store(spark, root)).filter(F.col("source_link").contains("theft-6")).count() == 1


def files_opened(frame):
    """Files that the scans of a frame opened."""
    frame.collect()
    return sum(leaf.metrics().apply("numFiles").value() for leaf in (lambda s: [s.apply(i) for i in range(s.length())])(frame._jdf.queryExecution().executedPlan().collectLeaves()))


def test_only_payloads_of_the_mode_and_its_months_are_opened(spark, tmp_path):
    folder = str(tmp_path / "in")
    urls = lambda m: "".join(f"<url><loc>https://t.in/city/goa/theft-{m}-{i}/articleshow/{m}{i}.cms</loc><lastmod>2026-{m:02d}-0{i + 1}T00:00:00Z</lastmod></url>" for i in range(3))
    names = ["january", "march", "may", "july", "september"]
    chunks = [("toi", f"https://t.in/2026-{n}-{i}.xml", None, 200, "sitemap", f"<urlset>{urls(2 * i + 1)}</urlset>", i) for i, n in enumerate(names)]
    land(spark, folder, *chunks, feed(9, [(1, 1)]), ("toi", "https://t.in/news.xml", None, 200, "sitemap", f"<urlset>{urls(5)}</urlset>", 20))
    since, until = datetime(2026, 5, 1, tzinfo=timezone.utc), datetime(2026, 7, 2, tzinfo=timezone.utc)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        toi = feeds.SOURCES[:1]
        back = feeds.items_of(payloads(spark, folder), "backfill", since, until, toi)
        assert files_opened(back) == 3 and back.count() == 3 + 2 + 3  # May, July and the chunk that names no month
        assert files_opened(feeds.items_of(payloads(spark, folder), "live", since, NOW, feeds.SOURCES[1:2])) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
