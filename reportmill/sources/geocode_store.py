"""Geocode answers that grow: a table in buckets of the key, and a log of newer answers.

Answers are appended to the log, each batch under its own number, and of several answers to a key the newest counts. The log is
folded into a new version of the bucketed table from time to time. A lookup shuffles the keys it asks for, not the table: the
table lies in buckets already, and the log since the last folding is small beside it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.operators.hotkeys import first_by
from reportmill.schemas import GEOCODE
from reportmill.sources.tables import _folder, exists

BUCKETS = 64
_VALUES = ("lat", "lng", "display_name")


class GeocodeStore:
    """``root`` holds base/version=N (the bucketed table) and log/batch=N; base N takes in every batch below N."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _numbers(self, kind: str, key: str) -> list[int]:
        fs, folder = _folder(self.spark, f"{self.root}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}=") and exists(self.spark, f"{self.root}/{kind}/{n}/_SUCCESS"))

    def _name(self, version: int) -> str:
        return f"geocodes_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{version}"

    def _base(self) -> tuple[int, DataFrame]:
        """(number of the first batch that is not in it, the table)."""
        version = max(self._numbers("base", "version"), default=0)
        if not version:
            return 0, self.spark.createDataFrame([], GEOCODE)
        name = self._name(version)
        columns = ", ".join(GEOCODE.split(", "))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.root}/base/version={version}'")
        return version, self.spark.table(name)

    def _newer(self, since: int) -> DataFrame:
        """The newest answer of each key in the batches from ``since`` on; within a batch a hit wins, then the least."""
        batches = [n for n in self._numbers("log", "batch") if n >= since]
        schema = GEOCODE + ", batch bigint"
        if not batches:
            return self.spark.createDataFrame([], schema).drop("batch")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/log/batch={n}" for n in batches])
        order = [-F.col("batch"), F.col("lat").isNull(), F.col("lat"), F.col("lng"), F.coalesce("display_name", F.lit(""))]
        return first_by(rows, ["key"], order, ["key", *_VALUES]).select("key", *_VALUES)

    def add(self, answers: DataFrame) -> int:
        """Appends a batch of answers (key, lat, lng, display_name; nulls are known misses) and returns its number."""
        taken = [*self._numbers("log", "batch"), *[v - 1 for v in self._numbers("base", "version")]]
        number = max(taken, default=0) + 1
        answers.select("key", *_VALUES, F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.root}/log/batch={number}")
        return number

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, ...) with lat, lng, display_name and ``known``: false where nobody has answered yet."""
        since, base = self._base()
        newer = self._newer(since).select("key", F.struct(*_VALUES).alias("_new"))
        joined = keys.join(base.select("key", F.struct(*_VALUES).alias("_old")), "key", "left").join(newer, "key", "left")
        answer = F.coalesce("_new", "_old")
        return joined.select(*keys.columns, *[answer[c].alias(c) for c in _VALUES], answer.isNotNull().alias("known"))

    def unanswered(self, keys: DataFrame) -> DataFrame:
        """The distinct keys to ask a geocoder for."""
        return self.lookup(keys.select("key").distinct()).filter("NOT known").select("key")

    def current(self) -> DataFrame:
        """All answers, one for each key."""
        since, base = self._base()
        newer = self._newer(since)
        return base.join(newer.select("key"), "key", "left_anti").unionByName(newer)

    def fold(self) -> int:
        """Writes table and log as a new version of the table and returns its number; older versions and folded batches go."""
        since, _ = self._base()
        batches = [n for n in self._numbers("log", "batch") if n >= since]
        if not batches:
            return since
        number = batches[-1] + 1
        rows = self.current().repartition(self.buckets, "key")  # one file for each bucket
        rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.root}/base/version={number}").saveAsTable(self._name(number))
        fs, _ = _folder(self.spark, self.root)
        for version in self._numbers("base", "version"):
            if version < number:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version)}")
                fs.delete(_folder(self.spark, f"{self.root}/base/version={version}")[1], True)
        for batch in self._numbers("log", "batch"):
            if batch < number:
                fs.delete(_folder(self.spark, f"{self.root}/log/batch={batch}")[1], True)
        return number
