"""Hard-negative mining over an inverted multi-index (Babenko and Lempitsky, 2012), exact by certified windows.

Vectors are cut into two halves, and each half has a small codebook. Codebooks are fitted on a bounded sample; every row is indexed: the pair
of its nearest codes is its cell. Rows are dealt into shards of bounded size, anchors into blocks, and a task searches one shard
for one block. For an anchor a, <a, x> is at most the sum over both halves of <a_h, c_h> + |a_h| * r_h, where r_h is the largest distance of
a row of the shard with that code to it. A heap visits cells by falling sums (multi-sequence algorithm). A window of scores is
certified, and the search ends, when no later cell can reach the worst score that the window still needs; a cell whose lower bound
lies above the window is passed over unread.

First the positives: the best rows of the anchor's own label. Then, for each of their scores, the window of scores that negatives may have.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reportmill.llm.batches import int64s
from reportmill.llm.products import EXACT, as_long, big_products, one_each, usable, whole
from reportmill.session import scratch_dir

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SAMPLE = 8192  # rows that codebooks are fitted on, at most
CODES = 8  # of a half; 64 cells
LEAST_SHARD, MOST_SHARD = 4096, 65536  # rows; in between, a 64th of all rows
BLOCK = 16384  # anchors
_ROUNDS = 8
_READ = 1024  # rows that are scored at a time, at least
_SLACK = 1e-9  # bounds are doubles


def codebooks(sample: DataFrame, codes: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the codes of both halves: k-means from farthest-first starts over the sample."""
    by_dim: dict[int, list] = {}
    for row in sample.collect():
        by_dim.setdefault(len(row[0]), []).append(row[0])
    return {dim: tuple(_k_means(half, codes) for half in halves(np.floor(SCALE * np.array(rows, np.float64)))) for dim, rows in by_dim.items()}


def halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (rows.shape[1] + 1) // 2
    return rows[:, :middle], rows[:, middle:]


def _distances(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows[:, None, :] - codes[None, :, :]) ** 2).sum(2)) if rows.size < 1 << 16 else np.stack([np.sqrt(((rows - c) ** 2).sum(1)) for c in codes], 1)


def _k_means(rows: np.ndarray, codes: int) -> np.ndarray:
    chosen = rows[:1]
    with np.errstate(over="ignore", invalid="ignore"):
        far = _distances(rows, chosen).min(1)
        while len(chosen) < codes and far.max() > 0:
            chosen = np.vstack([chosen, rows[int(far.argmax())]])
            far = np.minimum(far, _distances(rows, chosen[-1:])[:, 0])
        for _ in range(_ROUNDS):
            nearest = _distances(rows, chosen).argmin(1)
            chosen = np.stack([rows[nearest == k].mean(0) if (nearest == k).any() else chosen[k] for k in range(len(chosen))])
    return chosen


class MultiIndex:
    """The rows of a shard by cell, with the radii of its codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.radius, codes = books, [], []
        with np.errstate(over="ignore", invalid="ignore"):
            for half, book in zip(halves(rows), books, strict=True):
                apart = _distances(half, book)
                code = apart.argmin(1)
                radius = np.full(len(book), -1.0)  # a code without rows
                np.maximum.at(radius, code, apart[np.arange(len(code)), code])
                codes.append(code)
                self.radius.append(radius)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.begin = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1)).tolist()

    def _bounds(self, anchor: np.ndarray) -> list[tuple[list[int], list[float], list[float]]]:
        """For each half: codes by falling upper bound of their rows' products, those bounds, and the lower ones."""
        out = []
        for half, book, radius in zip(halves(anchor[None, :]), self.books, self.radius, strict=True):
            centre, wide = book @ half[0], float(np.sqrt((half[0] ** 2).sum())) * radius
            slack = _SLACK * (np.abs(centre) + np.abs(wide) + 1)
            order = np.argsort(-(centre + wide + slack), kind="stable")
            order = order[radius[order] >= 0]
            out.append((order.tolist(), (centre + wide + slack)[order].tolist(), (centre - wide - slack)[order].tolist()))
        return out

    def visit(self, anchor: np.ndarray, search: Positives | Windows) -> int:
        """Feeds cells to ``search`` until it is certified; returns how many rows were scored."""
        (first, up, down), (second, up_b, down_b) = self._bounds(anchor)
        heap = [(-(up[0] + up_b[0]), 0, 0)] if first and second else []
        waiting: list[slice] = []
        held = scored = 0
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < search.needed:
                break
            if j + 1 < len(second):
                heapq.heappush(heap, (-(up[i] + up_b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(up[i + 1] + up_b[0]), i + 1, 0))
            cell = first[i] * len(self.books[1]) + second[j]
            a, b = self.begin[cell], self.begin[cell + 1]
            if b > a and down[i] + down_b[j] <= search.most:
                waiting.append(slice(a, b))
                held += b - a
            if waiting and (held >= _READ or not heap):
                scored += self._feed(waiting, anchor, search)
                waiting, held = [], 0
        if waiting:
            scored += self._feed(waiting, anchor, search)
        return scored

    def _feed(self, cells: list[slice], anchor: np.ndarray, search: Positives | Windows) -> int:
        ids, labels, scores = (np.concatenate(x) for x in zip(*((self.ids[c], self.labels[c], self.rows[c] @ anchor) for c in cells), strict=True))
        search.take(ids, labels, scores)
        return len(ids)


def _first(ids: np.ndarray, scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:count]
    return ids[order], scores[order]


class Positives:
    """The best rows of the anchor's label, itself left out."""

    most = np.inf

    def __init__(self, own: int, label: int, count: int):
        self.own, self.label, self.count, self.needed = own, label, count, -np.inf
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def take(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        ok = (labels == self.label) & (ids != self.own) & (scores >= self.needed)
        self.ids, self.scores = _first(np.concatenate([self.ids, ids[ok]]), np.concatenate([self.scores, scores[ok]]), self.count)
        if len(self.ids) == self.count:
            self.needed = self.scores[-1]

    def found(self) -> list[tuple[int, int, int]]:
        return [(0, i, int(s)) for i, s in zip(self.ids.tolist(), self.scores.tolist(), strict=True)]


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and largest negative score for a positive one."""
    return -(-low * score // 100), high * score // 100


class Windows:
    """For each positive score the best rows of other labels within its window."""

    def __init__(self, label: int, positives: list[int], count: int, low: int, high: int):
        self.label, self.count = label, count
        self.windows = {p: (a, b) for p in positives for a, b in [window_of(p, low, high)] if a <= b}
        self.rows = {p: (np.zeros(0, np.int64), np.zeros(0)) for p in self.windows}
        self.worst = {p: float(a) for p, (a, _) in self.windows.items()}
        self.most = max((b for _, b in self.windows.values()), default=-np.inf)
        self.needed = min(self.worst.values(), default=np.inf)

    def take(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        ok = np.flatnonzero((labels != self.label) & (scores >= self.needed) & (scores <= self.most))
        ids, scores = ids[ok], scores[ok]
        for p, (_, high) in self.windows.items():
            inside = (scores >= self.worst[p]) & (scores <= high)
            if inside.any():
                held_ids, held = self.rows[p]
                self.rows[p] = _first(np.concatenate([held_ids, ids[inside]]), np.concatenate([held, scores[inside]]), self.count)
                if len(self.rows[p][0]) == self.count:
                    self.worst[p] = max(self.worst[p], float(self.rows[p][1][-1]))
        self.needed = min(self.worst.values(), default=np.inf)

    def found(self) -> list[tuple[int, int, int]]:
        return [(p, i, int(s)) for p, (ids, scores) in self.rows.items() for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]


def _in_integers(index: MultiIndex, anchor: np.ndarray, own: int, label: int, positives: list[int] | None, counts: tuple[int, int], window: tuple[int, int]) -> list[tuple[int, int, int]]:
    """The same search in Python's integers, for products that doubles do not hold exactly: every row is scored."""
    scored = sorted((-as_long(s), i, k) for s, i, k in zip(big_products(anchor, index.rows), index.ids.tolist(), index.labels.tolist(), strict=True))
    if positives is None:
        return [(0, i, -s) for s, i, k in scored if k == label and i != own][: counts[0]]
    out = []
    for p in positives:
        low, high = window_of(p, *window)
        out.extend([(p, i, -s) for s, i, k in scored if k != label and low <= -s <= high][: counts[1]])
    return out


def _search(shared, scale: int, counts: tuple[int, int], window: tuple[int, int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        x, a = whole(rows["embedding"], scale), whole(anchors["embedding"], scale)
        books = shared.value.get(x.shape[1]) or tuple(h[:1] for h in halves(x))
        index = MultiIndex(int64s(rows["vec_id"].combine_chunks()), int64s(rows["label"].combine_chunks()), x, books)
        most, out = float(np.abs(x).max()) * x.shape[1], []
        for own, label, scores, anchor in zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), anchors["positives"].to_pylist(), a, strict=True):
            if most * float(np.abs(anchor).max()) < EXACT:
                search = Positives(own, label, counts[0]) if scores is None else Windows(label, scores, counts[1], *window)
                index.visit(anchor, search)
                found = search.found()
            else:
                found = _in_integers(index, anchor, own, label, scores, counts, window)
            out.extend((own, *f) for f in found)
        columns = zip(*out, strict=True) if out else ((),) * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, least_shard: int = LEAST_SHARD, codes: int = CODES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, label, embedding, ...) that ``is_anchor`` picks.

    Components become floor(256 * x); a score is the integer inner product, higher first, then smaller vec_id. Positives are an
    anchor's best other rows of its label; their negatives the best rows of other labels that score ``low`` to ``high`` per cent of the
    positive's score, so a negative positive score has none. Vectors of other lengths than the anchor's are neither. Rows with a null
    id or label, with a null or empty vector, or one that holds null or non-finite components (also after scaling), take no
    part. Of rows that share an id the least by label, then vector, stands for all. A score that no long holds counts as the nearest
    long. Extra columns are not read.
    """
    spark = vectors.sparkSession
    scratch_dir(spark)
    rows = vectors.filter(usable("embedding", SCALE) & F.col("label").isNotNull())
    rows = one_each(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"), "vec_id")
    rows = rows.withColumn("dim", F.size("embedding")).checkpoint()
    total = rows.count()
    order = F.xxhash64("vec_id")
    share = min(1.0, 0.9 * SAMPLE / max(1, total))
    sample = rows.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(order, "vec_id").limit(SAMPLE).select("embedding")
    shared = spark.sparkContext.broadcast(codebooks(sample, codes))  # two codebooks for each length of the sample
    shards = max(1, -(-total // max(least_shard, min(MOST_SHARD, total // 64))))
    anchors = rows.filter(is_anchor)
    blocks = max(1, -(-anchors.count() // BLOCK))
    asked = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    dealt = rows.withColumn("shard", F.pmod(order, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(some: DataFrame) -> DataFrame:
        key = ["dim", "block", "shard"]
        sent = some.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*key, "vec_id", "label", "embedding", "positives")
        found = sent.groupBy(*key).cogroup(dealt.toDF(*dealt.columns).groupBy(*key)).applyInArrow(
            _search(shared, SCALE, (positives, negatives), (low, high)), "anchor_id long, positive_score long, vec_id long, score long"
        )
        ranked = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(ranked))

    near = meet(asked.withColumn("positives", F.lit(None).cast("array<long>"))).filter(F.col("rank") <= positives)
    near = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).checkpoint()
    windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("positives"))  # at most ``positives`` numbers
    far = meet(asked.join(windows, "vec_id")).filter(F.col("rank") <= negatives)
    far = far.select("anchor_id", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_inner_product(a.e, x.e)::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id AND len(a.e) = len(x.e)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""

QUERIES = {"op11_hard_negatives": (op11_hard_negatives, SQL)}
