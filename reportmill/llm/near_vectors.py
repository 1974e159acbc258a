"""Embedding near-dedup by cover trees.

Equal vectors of a label become one node with a weight. Nodes go to the nearest of a few pivots, the top level of the tree: pivots are
chosen farthest-first from a bounded sample, and every vector is placed. A label's nodes at a pivot make blocks of bounded size; a
pair of blocks meets in one task unless their covering radii keep all their vectors apart. The task builds a cover tree for each
block and traverses both. It returns a count and a representative for each vector, never its pairs, so a group of near copies
costs rows in proportion to its size. Connected components join what the tasks found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.llm.batches import int64s
from reportmill.llm.cover_tree import threshold_links
from reportmill.operators.components import connected_components
from reportmill.session import scratch_dir

LEAST = 0.93
BLOCK = 2048
SAMPLE = 4096
MOST_PIVOTS = 64
_NO_ID = 1 << 62


def _usable() -> Column:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pivots(nodes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """For each dimension ``count`` unit vectors at most, farthest-first among at most SAMPLE nodes."""
    share = min(1.0, 0.9 * SAMPLE / max(1, nodes.count()))
    picked = nodes.filter(F.pmod(F.xxhash64("node", "key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("key", "node").limit(SAMPLE).select("embedding").collect()
    out: dict[int, list] = {}
    for row in picked:
        out.setdefault(len(row[0]), []).append(row[0])
    for size, rows in out.items():
        unit = np.array(rows, np.float64)
        unit /= np.sqrt((unit**2).sum(1))[:, None]
        chosen, apart = [0], 2 - 2 * (unit @ unit[0])
        while len(chosen) < min(count, len(unit)) and apart.max() > 1e-12:
            chosen.append(int(apart.argmax()))
            apart = np.minimum(apart, 2 - 2 * (unit @ unit[chosen[-1]]))
        out[size] = unit[chosen]
    return out


def _place(shared):
    def run(batches):
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("embedding")])
            cell, far = np.zeros(len(lengths), np.int64), np.full(len(lengths), 2.0)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                unit = _matrix(batch.column("embedding").take(pa.array(at)))
                unit /= np.sqrt((unit**2).sum(1))[:, None]
                if size in shared.value:
                    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (unit @ shared.value[size].T)))
                    cell[at], far[at] = apart.argmin(1), apart.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return run


def _traverse(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = int64s(table["side"].chunk(0))
        order = np.lexsort((int64s(table["key"].chunk(0)), int64s(table["node"].chunk(0)), side))
        table = table.take(pa.array(order)).combine_chunks()
        alone = bool((side == side[0]).all()) and int(side[0]) == 0
        node, key, copies = (int64s(table[c].chunk(0)) for c in ("node", "key", "copies"))
        split = None if alone else int((side == 0).sum())
        count, root = threshold_links(_matrix(table["embedding"].chunk(0)), copies, least, split)
        linked = count > 0
        return pa.table([pa.array(node[linked]), pa.array(key[linked]), pa.array(count[linked]), pa.array(node[root[linked]])], ["node", "key", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label, ...).

    Rows link when their labels are equal and not null, and the cosine of their vectors in double precision is ``least`` or more. A
    vector that is null, empty or zero, or has a null or non-finite component, links with nothing, nor do vectors of different
    lengths. Equal rows link with each other. Rows without an id are after all others and have no component id unless a row with
    one is in reach; such a row is kept if it stands for itself. Extra columns are not read.
    """
    spark = vectors.sparkSession
    scratch_dir(spark)
    name = F.coalesce(F.col("vec_id").cast("long"), F.xxhash64("label", "embedding").bitwiseAND(F.lit(_NO_ID - 1)).bitwiseOR(F.lit(_NO_ID)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), name.alias("name"), "label", "embedding", F.coalesce(_usable(), F.lit(False)).alias("usable"))
    good = rows.filter("usable").select("vec_id", "name", "label", "embedding", F.xxhash64("label", "embedding").alias("key"))
    nodes = good.groupBy("key", "label", "embedding").agg(F.min("name").alias("node"), F.count("*").alias("copies")).checkpoint()
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chosen = pivots(nodes, min(MOST_PIVOTS, -(-largest // block)) if largest else 1)
    shared = spark.sparkContext.broadcast(chosen)

    placed = nodes.mapInArrow(_place(shared), "key long, label {0}, embedding {1}, node long, copies long, cell long, far double".format(*(nodes.schema[c].dataType.simpleString() for c in ("label", "embedding"))))
    placed = placed.withColumn("dim", F.size("embedding")).checkpoint()
    cells = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    blocks = cells.select("label", "dim", "cell", "radius", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # At most MOST_PIVOTS squared distances for each dimension of the sample.
    gaps = spark.createDataFrame([(d, i, j, float(np.sqrt(max(0.0, 2 - 2 * p[i] @ p[j])))) for d, p in chosen.items() for i in range(len(p)) for j in range(len(p))], "dim int, cell long, cell_b long, gap double")
    other = blocks.withColumnsRenamed({"cell": "cell_b", "radius": "radius_b", "part": "part_b"})
    pairs = blocks.join(other, ["label", "dim"]).filter((F.col("cell") < F.col("cell_b")) | ((F.col("cell") == F.col("cell_b")) & (F.col("part") <= F.col("part_b"))))
    pairs = pairs.join(gaps, ["dim", "cell", "cell_b"], "left").filter(
        F.coalesce("gap", F.lit(0.0)) <= F.col("radius") + F.col("radius_b") + float(np.sqrt(2 - 2 * least)) + 1e-9
    )
    pair = F.struct("label", "dim", "cell", "part", "cell_b", "part_b")
    ends = [F.struct(F.col("cell").alias("c"), F.col("part").alias("p"), F.lit(0).alias("side")), F.struct(F.col("cell_b").alias("c"), F.col("part_b").alias("p"), F.lit(1).alias("side"))]
    selves = (F.col("cell") == F.col("cell_b")) & (F.col("part") == F.col("part_b"))
    meets = pairs.select("label", "dim", pair.alias("pair"), F.explode(F.when(selves, F.array(ends[0])).otherwise(F.array(*ends))).alias("end")).select("label", "dim", "pair", F.col("end.c").alias("cell"), F.col("end.p").alias("part"), "end.side")
    dealt = placed.join(cells.select("label", "dim", "cell", "parts"), ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    gathered = dealt.join(meets, ["label", "dim", "cell", "part"]).select("pair", "node", "key", "copies", "side", "embedding")
    found = gathered.groupBy("pair").applyInArrow(_traverse(least), "node long, key long, links long, root long").checkpoint()

    components = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("key", "node").agg(F.sum("links").alias("links"))
    known = nodes.select("key", "label", "embedding", "node", "copies").join(links, ["key", "node"], "left").join(components, "node", "left")
    known = known.select("key", "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    joined = good.join(known, ["key", "label", "embedding"]).select("vec_id", "name", "n_links", "component")
    rest = rows.filter("not usable").select("vec_id", "name", F.lit(0).cast("long").alias("n_links"), F.col("name").alias("component"))
    return joined.unionByName(rest).select(
        "vec_id", "n_links", F.when(F.col("component") < _NO_ID, F.col("component")).alias("component_id"), (F.col("name") == F.col("component")).alias("kept")
    )


def op4_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u
), least AS (
  SELECT u, min(w) AS component_id FROM reach GROUP BY u
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.u = e.vec_id) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.u
"""

QUERIES = {"op4_near_vectors": (op4_near_vectors, SQL)}
