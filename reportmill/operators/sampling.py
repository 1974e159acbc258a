"""Even-in-time sampling without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reportmill.config import SAMPLE_ROUNDS
from reportmill.operators.hotkeys import broadcast_if_small
from reportmill.session import scratch_dir

# Rows a bucket may hold before it is looked at more finely.
BUCKET_ROWS = 1_000_000
_HOUR, _SECOND, _BLOCK = 3_600_000_000, 1_000_000, 65_536


def _wanted_ranks(n: Column, size: Column, before: Column, count: Column) -> Column:
    """Zero-based ranks the sample takes among ``count`` rows that follow ``before`` others.

    All ranks are taken when the group has at most n rows; one item means the lower median; otherwise item i sits at
    round(i * (size - 1) / (n - 1)).
    """
    step = (size - 1) / (n - 1)
    first = F.greatest(F.floor((before - 0.5) / step) - 1, F.lit(0))
    last = F.least(F.ceil((before + count) / step) + 1, n - 1)
    rank = lambda i: F.floor(i * step + 0.5)
    many = F.filter(
        F.transform(F.sequence(first, F.greatest(last, first)), rank), lambda r: (r >= before) & (r < before + count)
    )
    middle = F.floor((size - 1) / 2)
    one = F.when((middle >= before) & (middle < before + count), F.array(middle)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n == 1, one).otherwise(many)


def sample_evenly(
    rows: DataFrame,
    groups: list[str],
    n: int | DataFrame,
    time: str,
    seq: str,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Up to ``n`` rows per group, evenly spaced by ``time`` (ties by ``seq``, a unique integer), both ends included.

    ``n`` may be a table (groups, n). Ranks come from counts per time bucket, so only the buckets that hold a
    wanted rank are ever sorted. A bucket that is still too large is counted again by second, by instant and by blocks
    of ``seq``, whose size is bounded.
    """
    scratch_dir(rows.sparkSession)
    micros = F.unix_micros(time)
    levels = [
        ("_hour", F.floor(micros / _HOUR)),
        ("_second", F.floor(micros / _SECOND)),
        ("_instant", micros),
        ("_block", F.floor(F.col(seq) / _BLOCK)),
    ]
    quota = n if isinstance(n, DataFrame) else None
    keys = list(groups)
    chosen: DataFrame | None = None
    current = rows
    for name, value in levels:
        current = current.withColumn(name, value)
        if chosen is None:
            counts = current.groupBy(*groups, name).agg(F.count("*").alias("_count"))
            sizes = counts.groupBy(*groups).agg(F.sum("_count").alias("_size"))
            if quota is None:
                sizes = sizes.withColumn("_n", F.lit(n).cast("long"))
            else:
                sizes = sizes.join(quota.select(*groups, F.col("n").cast("long").alias("_n")), groups)
            counts = counts.join(sizes, groups).withColumn("_base", F.lit(0).cast("long"))
            part = groups
        else:
            # Only the rows of buckets with a wanted rank go on; a small bucket needs no finer look.
            found = chosen.select(*keys, "_size", "_n", "_base")
            counts = (
                current.join(broadcast_if_small(found), keys)
                .groupBy(*keys, name, "_size", "_n", "_base")
                .agg(F.count("*").alias("_count"))
            )
            part = keys
        in_order = Window.partitionBy(*part).orderBy(name)
        before = F.col("_base") + F.sum("_count").over(in_order) - F.col("_count")
        placed = counts.withColumn("_before", before)
        ranks = _wanted_ranks(F.col("_n"), F.col("_size"), F.col("_before"), F.col("_count"))
        keys = [*keys, name]
        all_of_it = F.col("_size") <= F.col("_n")
        chosen = (
            placed.withColumn("_all", all_of_it)
            .withColumn("_ranks", F.when(~F.col("_all"), ranks))
            .filter(F.col("_all") | (F.size("_ranks") > 0))
            .select(*keys, "_size", "_n", "_count", "_all", "_ranks", F.col("_before").alias("_base"))
            .checkpoint()
        )
        largest = chosen.filter(~F.col("_all")).agg(F.max("_count")).first()[0] or 0
        if largest <= bucket_rows:
            break
    picked = current.join(broadcast_if_small(chosen.drop("_size", "_n", "_count")), keys)
    whole = picked.filter("_all")
    within = Window.partitionBy(*keys).orderBy(time, seq)
    ranked = picked.filter("not _all").withColumn("_rank", F.col("_base") + F.row_number().over(within) - 1)
    sampled = ranked.filter(F.array_contains("_ranks", F.col("_rank"))).drop("_rank")
    return whole.unionByName(sampled).select(*rows.columns)


def sample_with_refill(
    pool: DataFrame,
    groups: list[str],
    per_group: int,
    time: str,
    seq: str,
    outcome: Callable[[DataFrame], DataFrame],
    rounds: int = SAMPLE_ROUNDS,
) -> DataFrame:
    """Samples each group, tries the picks, and samples the shortfall again from the rest.

    ``outcome`` maps picks to rows that keep ``groups`` and ``seq`` and add ``outcome``; only the value
    'stored' counts towards ``per_group``. The result gathers all tries with their ``round``.
    """
    scratch_dir(pool.sparkSession)
    remaining = pool
    tried: DataFrame | None = None
    for number in range(1, rounds + 1):
        if tried is None:
            quota: int | DataFrame = per_group
        else:
            stored = tried.groupBy(*groups).agg(F.count_if(F.col("outcome") == "stored").alias("stored"))
            quota = (
                remaining.select(*groups).distinct().join(stored, groups, "left")
                .select(*groups, (F.lit(per_group) - F.coalesce("stored", F.lit(0))).alias("n"))
                .filter("n > 0")
            )
        picks = sample_evenly(remaining, groups, quota, time, seq).checkpoint()
        if picks.isEmpty():
            break
        results = outcome(picks).withColumn("round", F.lit(number)).checkpoint()
        tried = results if tried is None else tried.unionByName(results)
        remaining = remaining.join(picks.select(*groups, seq), [*groups, seq], "left_anti")
    return tried if tried is not None else outcome(pool.limit(0)).withColumn("round", F.lit(0))
