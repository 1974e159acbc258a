"""Integer vectors from stored ones, and their exact inner products.

Each component x of a vector becomes floor(scale * x), x as double. Products are taken in double precision where no sum can leave the
integers that doubles hold exactly; beyond that, in Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = float(1 << 53)  # doubles hold every integer below
_LONG = (1 << 63) - 1


def usable(vector: str, scale: int) -> Column:
    """Not null, not empty, and without a component that is null, no finite number, or none once multiplied by ``scale``."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def length_of(vector: str, scale: int) -> Column:
    """Length of the integer vector as a double; infinite beyond its range."""

    def component(x: Column) -> Column:
        value = x.cast("double") * scale
        return F.when(F.abs(value) < EXACT, F.floor(value).cast("double")).otherwise(value)

    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + component(x) * component(x)))


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key that is not null: the least by the other columns, in their order."""
    rest = [c for c in rows.columns if c != key]
    least = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return least.select(key, "_row.*")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(held), -1) if len(held) else flat.reshape(0, 0)


def whole(column: pa.ChunkedArray | pa.Array, scale: int) -> np.ndarray:
    return np.floor(scale * matrix(column))


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow."""
    most = np.maximum(np.abs(rows).max(1, initial=0.0), 1.0)
    return most * np.sqrt(((rows / most[:, None]) ** 2).sum(1))


def big_products(query: np.ndarray, rows: np.ndarray) -> list[int]:
    """Products of one vector with each row in Python's integers."""
    own = [int(x) for x in query]
    return [sum(x * int(y) for x, y in zip(own, row, strict=True)) for row in rows.tolist()]


def as_long(score: int) -> int:
    """A score that no long holds becomes the nearest one."""
    return max(-_LONG - 1, min(_LONG, int(score)))
