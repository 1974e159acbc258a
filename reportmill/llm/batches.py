"""Arrow and byte helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST_ID = (1 << 63) - 1
# The white space of words and line ends, and A-Z to a-z.
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def order_id(name: str) -> Column:
    """An id to compare by: a null id comes after every number."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def packed(rows: DataFrame, drop: tuple[str, ...] = ()) -> tuple[Column, list[str]]:
    """All columns but ``drop`` as one struct, so that an operator's own names cannot clash with them."""
    names = [c for c in rows.columns if c not in drop]
    fields = [F.col(f"`{c}`").alias(c) for c in names]
    return (F.struct(*fields) if fields else F.struct(F.lit(None).cast("boolean").alias("_"))), names


def unpacked(names: list[str], column: str = "_row") -> list[Column]:
    return [F.col(f"{column}.`{c}`").alias(c) for c in names]


def field_of(rows: DataFrame, name: str) -> T.DataType:
    return rows.schema[name].dataType


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary array; a null is empty."""
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if kind == pa.large_binary() else "")
    texts = texts.cast(kind)
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))


def whole_texts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of consecutive rows with about ``limit`` bytes; texts stay whole."""
    offsets, data = as_bytes(texts)
    first = 0
    while first < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(offsets) - 1)
        yield first, end, offsets[first : end + 1] - offsets[first], data[offsets[first] : offsets[end]]
        first = end


def int64s(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def blob(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unblob(data: bytes | None, kind, count: int) -> np.ndarray:
    """The values that ``blob`` stored; ``count`` of them."""
    if not data or not count:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(data, count * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
