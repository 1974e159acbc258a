"""Embedding whitening: components of the covariance by spectral divide and conquer, broadcast to whiten every vector.

Each component c of a vector becomes the integer x = floor(1024 * c) + 100000. One pass sums x, a second sums the products of x less
the rounded mean; both sums are of integers, added up as rows (dimension, dimension, sum), so the driver gets one d by d table
whatever the number of vectors. ``polar.components`` splits that covariance. The components, at most ``most`` vectors of d numbers,
are broadcast; every vector is projected where it lies. A last pass measures the covariance of what was projected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm.polar import components
from reportmill.llm.products import EXACT, matrix, usable
from reportmill.session import scratch_dir

SCALE, SHIFT = 1024, 100_000
MOST = 8
_TILE = 8192
_HUGE = 1e100
_LONG = (1 << 63) - 1
_SUMS = "i int, j int, total double"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """floor(SCALE * c) of the vectors, without the shift: it moves no covariance, and small numbers stay exact."""
    for batch in batches:
        for a in range(0, batch.num_rows, _TILE):
            yield np.floor(SCALE * matrix(batch.column("embedding").slice(a, _TILE)))


def _table(total: np.ndarray) -> pa.RecordBatch:
    """The entries of a matrix as rows (i, j, total)."""
    i, j = np.indices(total.shape)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "total"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each dimension the sum, the sum of absolute values, and the number of vectors."""
    total = None
    for x in _tiles(batches):
        total = np.stack([x.sum(0), np.abs(x).sum(0), np.full(x.shape[1], float(len(x)))]) + (0 if total is None else total)
    if total is not None:
        yield _table(total)


def _products(middle: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _tiles(batches):
            moved = x - middle
            total = moved.T @ moved + (0 if total is None else total)
        if total is not None:
            yield _table(total)

    return run


def _collected(parts: DataFrame) -> dict[tuple[int, int], float]:
    """The summed entries: as many as a matrix of dimensions has."""
    return {(r.i, r.j): r.total for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}


def _deviations(x: np.ndarray, n: int, sums: list[int] | None) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where no long holds it or the sums are not exact. The shift cancels out."""
    if sums is None:
        return [None] * len(x)
    most = n * float(np.abs(x).max(initial=0.0)) + max(map(abs, sums))
    if most < 2.0**62 and ((n * x - np.array(sums, np.float64)) ** 2).sum(1).max(initial=0.0) < 2.0**62:
        return ((n * x.astype(np.int64) - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v <= _LONG else None for v in exact]


def _whitened(x: np.ndarray, shared) -> np.ndarray:
    return (x - shared.value["mean"]) @ shared.value["axes"]


def _spread(shared):
    """Sums and products of whitened vectors: entries of the matrix of (1, w)' (1, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _tiles(batches):
            w = np.hstack([np.ones((len(x), 1)), _whitened(x, shared)])
            total = w.T @ w + (0 if total is None else total)
        if total is not None:
            yield _table(total)

    return run


def _project(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _TILE):
                part = batch.slice(a, _TILE)
                x = np.floor(SCALE * matrix(part.column("embedding")))
                w = _whitened(x, shared)
                offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(_deviations(x, shared.value["n"], shared.value["sums"]), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                    ["vec_id", "deviation", "whitened"],
                )

    return run


def whiten(vectors: DataFrame, most: int = MOST) -> tuple[DataFrame, dict]:
    """(rows, fit): rows hold vec_id, deviation and whitened (one number for each component); fit holds n, sums, values, axes and identity_error.

    The fit is over all vectors that take part: not null, not empty, without components that are null or no finite numbers (nor beyond
    1e100, whose products would be none), and of the commonest length (ties: the longer). Repeated rows count as often as they stand there, rows without
    an id too. Components are numbered by falling eigenvalue; those whose eigenvalue is nothing but rounding are left out, so a
    table of equal vectors, or of one, has none. A deviation is null where no long holds it, or where the absolute values of a dimension
    sum to 2**53 or more, so that sums in double precision may round. Extra columns are not read.
    """
    spark = vectors.sparkSession
    scratch_dir(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable("embedding", SCALE) & ~F.exists("embedding", lambda c: F.abs(c.cast("double")) > _HUGE))
    dims = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    dim = dims.agg(F.max(F.struct("n", "dim"))["dim"]).first()[0] or 0
    rows = rows.filter(F.size("embedding") == dim)
    fit = {"n": 0, "sums": [], "values": np.zeros(0), "trace": 0.0, "identity_error": 0.0, "mean": np.zeros(dim), "axes": np.zeros((dim, 0))}
    if dim:
        entries = _collected(rows.select("embedding").mapInArrow(_sums, _SUMS))
        n = int(entries[2, 0])
        sums = [int(entries[0, j]) for j in range(dim)]
        middle = np.array([float(round(s / n)) for s in sums])
        rest = np.array([float(s - n * int(m)) / n for s, m in zip(sums, middle.tolist(), strict=True)])  # what the rounded mean misses
        found = _collected(rows.select("embedding").mapInArrow(_products(middle), _SUMS))
        covariance = np.array([[found[i, j] for j in range(dim)] for i in range(dim)]) / n - np.outer(rest, rest)
        values, axes = components(covariance)
        real = np.flatnonzero(values > dim * np.finfo(np.float64).eps * max(float(values[0]), 0.0))[:most]
        exact = all(entries[1, j] < EXACT for j in range(dim))  # then so was every partial sum
        fit |= {"n": n, "sums": sums if exact else None, "values": values[real], "trace": float(np.trace(covariance)), "mean": middle + rest, "axes": axes[:, real] / np.sqrt(values[real])}
    shared = spark.sparkContext.broadcast(fit)  # most vectors of one length
    if len(fit["values"]):
        entries = _collected(rows.select("embedding").mapInArrow(_spread(shared), _SUMS))
        held = len(fit["values"])
        mean = np.array([entries[0, j + 1] for j in range(held)]) / fit["n"]
        spread = np.array([[entries[i + 1, j + 1] for j in range(held)] for i in range(held)]) / fit["n"] - np.outer(mean, mean)
        fit["identity_error"] = float(np.abs(spread - np.eye(held)).max())
    return rows.mapInArrow(_project(shared), "vec_id long, deviation long, whitened array<double>"), fit


def whitened_rows(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows, fit = whiten(vectors, most)
    explained = F.array(*[F.lit(float(v / fit["trace"])) for v in fit["values"]]).cast("array<double>")
    spread = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(fit["identity_error"]).alias("identity_error"),
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


# Eigenvectors are no SQL; tests/llm/test_whitening.py compares them with another method.
QUERIES = {"op13_whitening": (op13_whitening, None)}
