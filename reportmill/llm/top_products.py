"""Exact top-k search by inner product in buckets of about equal length (LEMP: Teflioudi, Gemulla and Mykytiuk, 2015).

Vectors fall into levels of length, ``LEVELS`` for each doubling, and a level into buckets of bounded size. Queries meet the
longest buckets first: their k-th score there is a threshold. A query is sent on only to buckets whose longest vector times its own
length reaches the threshold, and a bucket only to blocks that hold such a query.

Within a bucket the threshold becomes a local cosine threshold: threshold / (query's length * longest vector's length). By it
each query chooses how to find candidates. Coordinate pruning: a unit vector with that cosine to the query has its coordinates in
ranges around those of the query, so sorted lists of the query's largest coordinates are cut by binary search and intersected.
Length pruning, where the ranges cut too little: the vectors, longest first, up to the length that the threshold needs. Products of the
candidates are then taken exactly, and thresholds rise with what is found.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reportmill.llm.batches import int64s
from reportmill.llm.products import EXACT, as_long, big_products, length_of, lengths, one_each, usable, whole
from reportmill.session import scratch_dir

TOP = 5
SCALE = 256
LEVELS = 8  # of the squared length, for each doubling
LEAST_BUCKET, MOST_BUCKET = 4096, 65536  # rows of a bucket; in between, a 64th of all rows
BLOCK = 65536  # queries of a block
FOCUS = 3  # coordinates that coordinate pruning looks at
_TILE_ROWS, _TILE_QUERIES = 4096, 512
_SLACK = 1e-9  # bounds are doubles
_HIT = "query_id long, vec_id long, score long"


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, theta: np.ndarray, k: int):
        self.theta, self.k = theta.copy(), k
        self.query = self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(query):
            return
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.score, scores)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.query, self.id, self.score = query[kept], ids[kept], scores[kept]
        full = np.flatnonzero(rank == self.k - 1)
        self.theta[query[full]] = np.maximum(self.theta[query[full]], scores[full])


class Bucket:
    """Vectors by falling length, with their unit vectors and, on demand, sorted lists of coordinates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        size = lengths(rows)
        order = np.lexsort((ids, -size))
        self.ids, self.rows, self.size = ids[order], rows[order], size[order]
        self.unit = self.rows / np.where(self.size > 0, self.size, 1.0)[:, None]
        self.low, self.high = self.unit.min(0), self.unit.max(0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def prefix(self, need: float) -> int:
        """How many vectors are at least so long."""
        return int(np.searchsorted(-self.size, -need * (1 - _SLACK), "right"))

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = (order, self.unit[order, f])
        return self.lists[f]

    def candidates(self, query: np.ndarray, cosine: float, need: float) -> np.ndarray | None:
        """Vectors that coordinate pruning leaves, or None where length pruning is left the cheaper way."""
        focus = np.argsort(-np.abs(query), kind="stable")[:FOCUS]
        middle, wide = query[focus] * cosine, np.sqrt(np.maximum(0.0, 1 - query[focus] ** 2) * max(0.0, 1 - cosine**2)) + _SLACK
        # A cap around the query that holds an end of the axis reaches that end.
        low, high = np.where(query[focus] <= -cosine, -2.0, middle - wide), np.where(query[focus] >= cosine, 2.0, middle + wide)
        cuts = np.flatnonzero((low > self.low[focus]) | (high < self.high[focus]))
        prefix, best = self.prefix(need), None
        for i in cuts.tolist():
            order, values = self.list_of(int(focus[i]))
            a, b = np.searchsorted(values, low[i], "left"), np.searchsorted(values, high[i], "right")
            if best is None or b - a < len(best):
                best = order[a:b]
        if best is None or len(best) * 4 > prefix:
            return None
        near = self.unit[best[:, None], focus]
        return np.sort(best[((near >= low) & (near <= high)).all(1) & (best < prefix)])


def _tiles(bucket: Bucket, queries: np.ndarray, own: np.ndarray, theta: np.ndarray, k: int) -> Best:
    """Length pruning: products with one stretch of the bucket after another, for the queries that its longest vector can still serve."""
    best, size, open_ = Best(theta, k), lengths(queries), np.arange(len(queries))
    for first in range(0, len(bucket.ids), _TILE_ROWS):
        tile = slice(first, first + _TILE_ROWS)
        open_ = open_[size[open_] * bucket.size[first] * (1 + _SLACK) >= best.theta[open_]]
        if not len(open_):
            break
        ids = bucket.ids[tile]
        scores = queries[open_] @ bucket.rows[tile].T
        scores[own[open_][:, None] == ids[None, :]] = -np.inf
        limit = best.theta[open_]
        if len(ids) > k:
            limit = np.maximum(limit, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
        at, which = np.nonzero((scores >= limit[:, None]) & (scores > -np.inf))
        best.add(open_[at], ids[which], scores[at, which])
    return best


def search_bucket(own: np.ndarray, queries: np.ndarray, theta: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query number, id, score) of each query's k best rows among those that reach ``theta``. A row is no answer to its own id."""
    out: list[tuple[int, int, int]] = []
    exact = np.abs(queries).max(1, initial=0.0) * np.abs(rows).max(initial=0.0) * rows.shape[1] < EXACT
    for i in np.flatnonzero(~exact).tolist():
        ranked = sorted((-as_long(s), r) for s, r in zip(big_products(queries[i], rows), ids.tolist(), strict=True) if r != own[i])
        out.extend((i, r, -s) for s, r in ranked[:k])
    size, bucket = lengths(queries), Bucket(ids, rows)
    reach, by_length = size * bucket.size[0], []
    for i in np.flatnonzero(exact & (reach * (1 + _SLACK) >= theta)).tolist():
        found = bucket.candidates(queries[i] / size[i], min(1.0, theta[i] / reach[i]) * (1 - _SLACK), theta[i] / size[i]) if theta[i] > 0 else None
        if found is None:
            by_length.append(i)
            continue
        scores = bucket.rows[found] @ queries[i]
        ok = (scores >= theta[i]) & (bucket.ids[found] != own[i])
        order = np.lexsort((bucket.ids[found[ok]], -scores[ok]))[:k]
        out.extend((i, r, int(s)) for r, s in zip(bucket.ids[found[ok]][order].tolist(), scores[ok][order].tolist(), strict=True))
    for a in range(0, len(by_length), _TILE_QUERIES):
        some = np.array(by_length[a : a + _TILE_QUERIES])
        best = _tiles(bucket, queries[some], own[some], theta[some], k)
        out.extend((q, r, int(s)) for q, r, s in zip(some[best.query].tolist(), best.id.tolist(), best.score.tolist(), strict=True))
    return out


def _search(scale: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        own = int64s(queries["vec_id"].combine_chunks())
        theta = queries["theta"].combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
        hits = search_bucket(own, whole(queries["embedding"], scale), theta, int64s(rows["vec_id"].combine_chunks()), whole(rows["embedding"], scale), k)
        number, ids, scores = (np.array(x, np.int64) for x in (zip(*hits, strict=True) if hits else ((), (), ())))
        return pa.Table.from_arrays([pa.array(own[number]), pa.array(ids), pa.array(scores)], schema=schema)

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _levels(length: Column) -> Column:
    """Level of a length: longer vectors have higher ones; the zero vector has the lowest."""
    level = F.floor(2 * LEVELS * F.log2(length))
    return F.when(length > 0, level).otherwise(F.lit(-1)).cast("int")


def top_products(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE, least_bucket: int = LEAST_BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` (vec_id, embedding, ...) for each row that ``is_query`` (over vec_id) picks.

    Components become floor(scale * x); the score is the integer inner product, higher first, then smaller vec_id. A row is no
    answer to itself; vectors of other lengths than the query's are no answers. Rows with a null id, with a null or empty vector
    or one that holds null or non-finite components (also after scaling) take no part. Of rows that share an id the least vector
    stands for all. A score that no long holds counts as the nearest long. Extra columns are not read.
    """
    spark = vectors.sparkSession
    scratch_dir(spark)
    rows = one_each(vectors.filter(usable("embedding", scale)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vec_id")
    rows = rows.withColumns({"dim": F.size("embedding"), "length": length_of("embedding", scale)})
    rows = rows.withColumn("level", _levels(F.col("length"))).checkpoint()
    asked = rows.filter(is_query)
    total, n_asked = rows.count(), asked.count()
    room = max(least_bucket, min(MOST_BUCKET, total // 64))
    # One row for each level of length of each dimension.
    levels = rows.groupBy("dim", "level").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumns({"before": before, "parts": F.ceil(F.col("n") / room).cast("int")}).checkpoint()
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    dealt = rows.join(F.broadcast(levels.select("dim", "level", "parts")), ["dim", "level"]).select("dim", "level", part.alias("part"), "vec_id", "embedding")
    buckets = levels.select("dim", "level", "before", F.col("longest"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = F.col("before") + F.col("part") * room < room  # the longest vectors, a bucket's worth or a little more
    blocks = max(1, -(-n_asked // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).select("dim", "block", "vec_id", "length", "embedding")

    def meet(sent: DataFrame) -> DataFrame:
        key = ["dim", "level", "part", "block"]
        sent = sent.select(*key, "vec_id", "theta", "embedding")
        wanted = dealt.join(sent.select(*key).distinct(), key[:3])
        wanted = wanted.toDF(*wanted.columns)  # both sides come from one table
        return sent.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(_search(scale, k), _HIT)

    at_first = meet(asked.join(buckets.filter(first).select("dim", "level", "part"), "dim").withColumn("theta", F.lit(None).cast("double")))
    found = _best(at_first, k).drop("rank").checkpoint()
    theta = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("theta"))
    later = asked.join(theta, "vec_id", "left").join(buckets.filter(~first).select("dim", "level", "part", "longest"), "dim")
    later = later.filter(F.col("theta").isNull() | (F.col("length") * F.col("longest") * (1 + _SLACK) >= F.col("theta")))
    best = _best(found.unionByName(meet(later)), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_top_products(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES = {"op12_top_products": (op12_top_products, SQL)}
