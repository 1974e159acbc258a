"""Joins and first-row picks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with fewer rows than this is never worth special treatment.
HOT_ROWS = 200_000
# At most this many keys are broadcast; any other key holds under 1/1000 of the rows.
MAX_HOT_KEYS = 1_000
# Largest table that is ever broadcast on purpose.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table counted to be small; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_unique(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    weight: str,
    rows: int | None = None,
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Inner join with a table that has one row per key.

    ``weight`` says how many rows of ``big`` a key has. The rows of the heaviest keys are dealt over several tasks, one for
    each ``hot_rows`` of them, and their row of ``small`` is sent to each. There is one join, so Spark may still broadcast a
    ``small`` that is small, and partitions do not add up over repeated calls. When ``rows``, the size of ``big``, is known and
    below the threshold, no key can be hot.
    """
    plain = small.drop(weight)
    if rows is not None and rows < hot_rows:
        return big.join(plain, on)
    hot = small.filter(F.col(weight) >= hot_rows).orderBy(F.desc(weight), *on).limit(max_hot)
    hot = F.broadcast(hot.select(*on, F.ceil(F.col(weight) / hot_rows).cast("int").alias("_shares")))
    share = F.pmod(F.xxhash64(*big.columns), F.col("_shares")).cast("int")
    dealt = big.join(hot, on, "left").withColumn("_share", F.coalesce(share, F.lit(0))).drop("_shares")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))
    sent = plain.join(hot, on, "left").withColumn("_share", copies).drop("_shares")
    return dealt.join(sent, [*on, "_share"]).drop("_share")


def first_by(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The first row of each key under ``order`` (ascending).

    An aggregate rather than a window: partial minima are taken before the shuffle, so a hot key
    costs one row per input partition.
    """
    kept = [c for c in (columns or df.columns) if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*kept), rank).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in kept])


def descending(value: Column) -> Column:
    """Sort key that reverses a timestamp; null comes last."""
    return F.coalesce(-F.unix_micros(value), F.lit(2**63 - 1))


def ascending(value: Column) -> Column:
    """Sort key of a timestamp with null last."""
    return F.coalesce(F.unix_micros(value), F.lit(2**63 - 1))
