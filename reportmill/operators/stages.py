"""Stage boundaries inside a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.session import scratch_dir


def compute_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds (or replaces) columns that are evaluated exactly once per row.

    The optimizer moves a filter below the projection that makes its column by copying the expression; for
    long text rules that means running them several times. A one-element generator is not copied.
    """
    kept = [c for c in rows.columns if c not in columns]
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select(*[F.col(c) for c in rows.columns], F.inline(F.array(made)).alias(*[f"_new_{n}" for n in columns])).select(
        *kept, *[F.col(f"_new_{n}").alias(n) for n in columns]
    )


def written(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: packed by column, so that later steps read only the columns they use."""
    folder = f"{scratch_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
