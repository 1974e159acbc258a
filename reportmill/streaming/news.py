"""News as a stream: landed payloads become reports as they arrive.

Payloads are read by the same function as in a batch, and ``feeds.items_of`` turns them into candidates row by row inside the
stream. A watermark over their published time bounds what arrives late and what is sent again. Each micro-batch then goes the way of
``collect``: eligible links that the store does not hold, their articles, the reports, and a merge that touches only the parts
the batch belongs to. The merge is keyed by link, so a batch that runs again after a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reportmill.functions.times import window_start
from reportmill.operators.eligibility import eligible
from reportmill.plans.collect import outcomes
from reportmill.plans.incremental import merge_into, report_store, stored_links
from reportmill.schemas import LANDED
from reportmill.session import scratch_dir
from reportmill.sources.feeds import first_items, items_of


_EVER = datetime(9999, 1, 1, tzinfo=timezone.utc)


def payloads(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Payloads that ``feeds.land`` put into a folder: what lies there, or what comes in, a bounded number of files at a time."""
    reader = spark.readStream if stream else spark.read
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.schema(LANDED + ", month string").json(path)


def recent_links(rows: DataFrame, delay: str, time: str = "published_at", keys: tuple[str, ...] = ("source", "url")) -> DataFrame:
    """Drops rows later than ``delay`` behind the newest one seen, and repeats of a key within ``delay``.

    State holds a key for about the delay, however long the stream runs. A repeat beyond it passes and is the merge's business. Rows
    without a time cannot be placed and are dropped, and so are those of days to come: one wrong date would make all others late.
    """
    past = F.col(time) <= F.current_timestamp() + F.expr("interval 1 day")
    return rows.filter(past).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def take_batch(
    found: DataFrame, pages: DataFrame, root: str, gazetteer: DataFrame, geocodes: DataFrame, now: datetime
) -> DataFrame | None:
    """Brings a batch of candidates into the store; returns its outcomes (source, city, seq, outcome), or None when no link is new."""
    spark = found.sparkSession
    store, cutoff = report_store(spark, root), window_start(now)
    found = first_items(found).checkpoint()
    pool = eligible(found, stored_links(store, found), cutoff, now).checkpoint()
    if pool.isEmpty():
        return None
    tried = outcomes(pool, pages, gazetteer, geocodes, cutoff).checkpoint()
    merge_into(store, tried.filter(F.col("outcome") == "stored").select("seq", "report.*"))
    return tried.drop("report")


def news_to_table(
    spark: SparkSession,
    path: str,
    pages: Callable[[], DataFrame],
    root: str,
    checkpoint: str,
    gazetteer: DataFrame,
    geocodes: DataFrame,
    since: datetime,
    clock: Callable[[], datetime],
    mode: str = "live",
    delay: str | None = None,
    files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Streams landed payloads into the report store at ``root``.

    ``mode`` picks the form of discovery, feeds ('live') or sitemaps ('backfill'); ``available_now`` works off what has landed and
    stops, otherwise the query keeps listening. ``pages`` gives the fetched pages as they are when a batch runs; ``clock`` is read
    once a batch. With ``delay`` late and repeated candidates are dropped in the stream.
    """
    scratch_dir(spark)
    # The upper end of the window moves with the clock, so each batch looks at it.
    found = items_of(payloads(spark, path, True, files_per_trigger), mode, since, _EVER)
    if delay:
        found = recent_links(found, delay)

    def take(batch: DataFrame, number: int) -> None:
        take_batch(batch, pages(), root, gazetteer, geocodes, clock())

    writer = found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
