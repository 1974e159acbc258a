"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Between the steps leaves are cut: a name with one neighbour, a smaller one, has that neighbour's component whatever else happens. The
steps turn most names into leaves, so rounds after the first work on what is left, which is soon small enough for one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.operators.hotkeys import HOT_ROWS, join_unique
from reportmill.session import scratch_dir

# Edges that one task may join; what is left beyond that goes through another round.
SMALL_GRAPH = 200_000


def _oriented(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs with the larger name first; loops dropped."""
    return pairs.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    ).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    ends = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit(1).alias("w")).unionByName(
        edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"), F.lit(0).alias("w"))
    )
    nearest = ends.groupBy("u").agg(F.min("v").alias("v"), F.sum("w").alias("w")).filter("w > 0")
    nearest = nearest.select(F.col("u").alias("lo"), F.least("u", "v").alias("m"), "w")
    return _oriented(join_unique(edges, nearest, ["lo"], "w", rows, hot_rows), "hi", "m")


def _small_star(edges: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    nearest = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("w"))
    joined = join_unique(edges, nearest, ["hi"], "w", rows, hot_rows)
    pairs = joined.select(F.explode(F.array(F.struct(F.col("hi").alias("a"), "m"), F.struct(F.col("lo").alias("a"), "m"))).alias("p"))
    return _oriented(pairs.select("p.a", "p.m"), "a", "m")


def _cut_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, rest): edges of names that have one neighbour, a smaller one, and all others. Both are checkpointed."""
    ends = edges.select(F.col("hi").alias("node"), "lo", F.lit(0).alias("above")).unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(None).cast(edges.schema["lo"].dataType).alias("lo"), F.lit(1).alias("above"))
    )
    alone = ends.groupBy("node").agg(F.count("lo").alias("n"), F.sum("above").alias("above"), F.min("lo").alias("lo")).filter("n = 1 AND above = 0")
    leaves = alone.select(F.col("node").alias("hi"), "lo").checkpoint()
    return leaves, edges.join(leaves.select("hi"), "hi", "left_anti").select("hi", "lo").checkpoint()


def _hang(found: DataFrame, leaves: DataFrame, hot_rows: int) -> DataFrame:
    """Adds cut leaves and the names they hung on to (node, component)."""
    stems = leaves.groupBy("lo").agg(F.count("*").alias("w")).join(found.withColumnRenamed("node", "lo"), "lo", "left").checkpoint()
    named = stems.select("lo", "w", F.coalesce("component", "lo").alias("component"))
    hung = join_unique(leaves, named, ["lo"], "w", None, hot_rows).select(F.col("hi").alias("node"), "component")
    bare = stems.filter(F.col("component").isNull()).select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return found.unionByName(hung).unionByName(bare)


def _joined(batches):
    """(node, component) of a small graph, by union-find: the smaller root wins."""
    parent = {}

    def root(name):
        while parent[name] != name:
            parent[name] = name = parent[parent[name]]
        return name

    for batch in batches:
        for hi, lo in zip(batch["hi"].to_pylist(), batch["lo"].to_pylist()):
            parent.setdefault(hi, hi), parent.setdefault(lo, lo)
            a, b = root(hi), root(lo)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        kind = batch.schema.field("hi").type
        yield pa.RecordBatch.from_arrays([pa.array(parent, kind), pa.array([root(name) for name in parent], kind)], ["node", "component"])


def connected_components(
    edges: DataFrame, a: str = "u", b: str = "v", hot_rows: int = HOT_ROWS, rounds: int | None = None, small_graph: int = SMALL_GRAPH
) -> DataFrame:
    """(node, component) for every node of an undirected edge list; the component is its smallest node.

    Each round is checkpointed to the shared folder, so lineage stays short and a lost executor
    costs a re-read. Rounds grow with the logarithm of the graph, and stop when nothing moves or when at most ``small_graph``
    edges are left, which one task joins. With ``rounds`` the search stops early: equal labels still mean connected, but one
    component may carry several labels.
    """
    scratch_dir(edges.sparkSession)
    whole = _oriented(edges, a, b).persist(StorageLevel.DISK_ONLY)
    leaves, current = _cut_leaves(whole)
    whole.unpersist()
    cut = [leaves]
    before = _fingerprint(current)
    number = 0
    while before[0] > small_graph and number != rounds:
        number += 1
        grown = _large_star(current, before[0], hot_rows)
        if before[0] >= hot_rows:
            # Large graphs: the next step needs the true size of this one to find its hot keys.
            grown = grown.checkpoint()
        # The large-star step never adds edges, so its input size bounds the small-star input.
        starred = _small_star(grown, before[0], hot_rows).persist(StorageLevel.DISK_ONLY)
        leaves, current = _cut_leaves(starred)
        starred.unpersist()
        cut.append(leaves)
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    if before[0] <= small_graph:
        kind = current.schema["hi"].dataType.simpleString()
        found = current.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}").checkpoint()
    else:
        roots = current.select(F.col("lo").alias("node")).distinct()
        linked = current.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
        if rounds is not None:
            roots = roots.join(linked.select("node"), "node", "left_anti")
        found = linked.unionByName(roots.withColumn("component", F.col("node")))
    for leaves in reversed(cut):
        found = _hang(found, leaves, hot_rows)
    return found
