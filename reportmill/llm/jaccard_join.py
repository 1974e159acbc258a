"""N-gram Jaccard join by T-occurrence search.

1. Every text becomes its set of shingle hashes. Equal sets within a batch become one node, named by their least document;
   equal sets of different batches are linked by their 128-bit digest, and only the least of them goes on.
2. Two sets that are similar enough share a shingle among the rarest of each (prefix filter). Rarity comes from counts of all
   shingles in a table of fixed size; any order would do, this one keeps common passages out. Each batch sends its
   prefixes in buckets as 32-bit prints; nodes that share a print join the cell of the least of them. A false print adds work only.
3. Cells are searched: each set asks the inverted lists of its cell for sets that occur T times. The shortest lists are merged, the
   longest (DivideSkip) are probed by binary search for the candidates left, and a pair is linked if its overlap is enough. Sets that
   are already connected are not compared again.
4. A cell above its size is split; its least node is in all parts. Connected components of what was found leave one main
   component in nearly all of such a cell; members outside it search the other parts too, so no link is lost.

A merge of short lists is numpy's stable sort of presorted lists with run counts, in place of a binary heap: the same lists and counts.
"""

from __future__ import annotations

import hashlib
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm.batches import blob, int64s, unblob, whole_texts
from reportmill.llm.shingles import shingle_sets
from reportmill.operators.components import connected_components
from reportmill.session import scratch_dir

LEAST = 75  # percent
BATCH_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
COUNTERS = 1 << 17
SLICES = 16
CELL_SHINGLES = 1 << 20
CELL_NODES = 2000
MOST_BUCKETS = 4096
_NO_ID = 1 << 62  # names of rows without an id start here


def _name() -> Column:
    """A document's number; rows without an id get one above all ids from their text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(_NO_ID - 1)).bitwiseOR(F.lit(_NO_ID)))


def _sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` piece by piece: while it hashes a text it needs some fifty bytes for each of its bytes."""
    made, first = [], 0
    while first < len(offsets) - 1:
        end = max(int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1, first + 1)
        made.append(shingle_sets(offsets[first : end + 1] - offsets[first], data[offsets[first] : offsets[end]]))
        first = end
    hashes, sizes = zip(*made, strict=True)
    return np.concatenate(hashes), np.concatenate(sizes)


def _batches(batches, limit: int = BATCH_BYTES):
    """(names, hashes, sizes) of groups of whole texts."""
    for batch in batches:
        names = int64s(batch.column(0))
        for first, end, offsets, data in whole_texts(batch.column(1), limit):
            yield names[first:end], *_sets(offsets, data)


def _digests(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, ends = memoryview(hashes.tobytes()), np.cumsum(sizes) * 8
    return [hashlib.blake2b(raw[e - 8 * n : e], digest_size=16).digest() if n else b"" for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _nodes(names: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """The least document of the batch with the same set."""
    least: dict[bytes, int] = {}
    for name, digest in zip(names.tolist(), digests, strict=True):
        least[digest] = min(least.get(digest, name), name)
    return np.array([least[d] for d in digests], np.int64)


def _describe(batches):
    for names, hashes, sizes in _batches(batches):
        digests = _digests(hashes, sizes)
        nodes = np.where(sizes > 0, _nodes(names, digests), names)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(nodes), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary())], ["name", "node", "n_shingles", "digest"])


def _count_shingles(batches):
    counts = np.zeros(COUNTERS, np.int64)
    for _, hashes, _ in _batches(batches):
        counts += np.bincount((hashes >> np.uint64(47)).astype(np.int64), minlength=COUNTERS)
    if counts.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([blob(x) for x in np.split(counts, SLICES)], pa.binary())], ["slice", "counts"])


def _add_counts(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[number] = held.get(number, 0) + unblob(counts, np.int64, COUNTERS // SLICES)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([blob(x) for x in held.values()], pa.binary())], ["slice", "counts"])


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How often shingles fall on each of COUNTERS counters, over all texts."""
    parts = texts.mapInArrow(_count_shingles, "slice int, counts binary").repartition(SLICES, "slice")
    counts = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for number, data in parts.mapInArrow(_add_counts, "slice int, counts binary").collect():  # SLICES rows
        counts[number] = unblob(bytes(data), np.int64, COUNTERS // SLICES)
    return counts.ravel()


def _prefix(sizes: np.ndarray, least: int) -> np.ndarray:
    return np.where(sizes > 0, sizes - -(-least * sizes // 100) + 1, 0)


def _send_prefixes(shared, buckets: int, least: int):
    def run(batches):
        counts = shared.value
        for names, hashes, sizes in _batches(batches):
            nodes = _nodes(names, _digests(hashes, sizes))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((hashes, counts[(hashes >> np.uint64(47)).astype(np.int64)], owner))
            first = np.cumsum(sizes) - sizes
            own = np.flatnonzero(nodes == names)
            own = own[np.unique(names[own], return_index=True)[1]]
            width = _prefix(sizes[own], least)
            ends = np.cumsum(width)
            picked = order[np.repeat(first[own] - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)]
            if not len(picked):
                continue
            bucket = ((hashes[picked] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            print_, node, size = hashes[picked].astype(np.uint32), np.repeat(names[own], width), np.repeat(sizes[own], width)
            before = np.arange(len(picked)) - np.repeat(ends - width, width)
            most = ((100 * size - (100 + least) * before) // least).astype(np.int64)
            order = np.lexsort((before, node, bucket))
            held, start = np.unique(bucket[order], return_index=True)
            parts = np.split(order, start[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array([len(p) for p in parts], pa.int32()), pa.array([blob(print_[p]) for p in parts], pa.binary()), pa.array([blob(np.diff(node[p], prepend=0)) for p in parts], pa.binary()),
                 pa.array([blob(np.stack([size[p], most[p]]).astype(np.int32)) for p in parts], pa.binary())],
                ["bucket", "n", "prints", "nodes", "sizes"],
            )

    return run


def _cells(table: pa.Table) -> pa.Table:
    """(cell, node): nodes that share a print and may be similar by size, in the cell of the least of them.

    If a print is the first that two sets share, at most what follows it in each can be shared too. So a set of size k with b
    shingles before the print reaches partners of (100 k - (100 + least) b) / least at most. Sorted by size, the nodes
    of a print fall into groups that no member reaches out of.
    """
    n, prints, nodes, sizes = (table[c].to_pylist() for c in ("n", "prints", "nodes", "sizes"))
    prints = np.concatenate([unblob(p, np.uint32, k) for p, k in zip(prints, n, strict=True)])
    nodes = np.concatenate([np.cumsum(unblob(x, np.int64, k)) for x, k in zip(nodes, n, strict=True)])
    size, most = np.concatenate([unblob(x, np.int32, 2 * k).reshape(2, k) for x, k in zip(sizes, n, strict=True)], 1).astype(np.int64)
    order = np.lexsort((size, prints))
    prints, nodes, size, most = prints[order], nodes[order], size[order], most[order]
    new = np.ones(len(prints), bool)
    new[1:] = prints[1:] != prints[:-1]
    # The farthest reach so far within each print: a running maximum of reaches raised by the print's number.
    lift = (np.cumsum(new) - 1) * (1 << 32)
    new[1:] |= size[1:] + lift[1:] > np.maximum.accumulate(most + lift)[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(nodes, first)
    count = np.diff(np.append(first, len(prints)))
    cell = np.repeat(least, count)
    shared = np.repeat(np.maximum.reduceat(nodes, first) != least, count)
    pairs = np.unique(np.stack([cell[shared], nodes[shared]], 1), axis=0)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["cell", "node"])


def occurrence_search(lists: list[np.ndarray], threshold: int, sets: list[np.ndarray], tokens: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Members that at least ``threshold`` of the inverted lists hold; ``lists`` belong to ``tokens``; ``skip`` marks members to leave out.

    DivideSkip: all but the longest lists are merged, and members that occur in them often enough to reach the threshold with all
    the long ones are looked up there: a long list holds a member if the member's set has the list's token.
    """
    order = np.argsort([len(x) for x in lists], kind="stable")
    longest = max(2, len(lists[order[-1]]))
    set_aside = min(threshold - 1, int(threshold / (0.01 * log2(longest) + 1)))
    short, long = order[: len(order) - set_aside], order[len(order) - set_aside :]
    merged = np.concatenate([lists[i] for i in short])
    merged = np.sort(merged[~skip[merged]], kind="stable")
    if not len(merged):
        return merged
    first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
    member, count = merged[first], np.diff(np.append(first, len(merged)))
    likely = count >= threshold - set_aside
    asked, found = np.sort(tokens[long]), []
    for m, c in zip(member[likely].tolist(), count[likely].tolist(), strict=True):
        at = np.minimum(np.searchsorted(sets[m], asked), len(sets[m]) - 1)
        if c + int((sets[m][at] == asked).sum()) >= threshold:
            found.append(m)
    return np.array(found, np.int64)


def links_of_cell(names: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, asks: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links that connect members with different labels; members that ask search all others. Enough links for all components."""
    sizes = np.array([len(s) for s in sets])
    _, labels = np.unique(labels, return_inverse=True)
    labels = labels.copy()
    if len(sets) == 2:
        together = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(names[0]), int(names[1]))] if labels[0] != labels[1] and 100 * together >= least * (sizes.sum() - together) else []
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    holders, bounds = member[order], np.searchsorted(place[order], np.arange(len(tokens) + 1))
    begins, links = np.cumsum(sizes) - sizes, []
    for i in np.flatnonzero(asks).tolist():
        if (labels == labels[i]).all():
            continue
        skip = (labels == labels[i]) | (100 * sizes < least * sizes[i]) | (100 * sizes[i] < least * sizes)
        if skip.all():
            continue
        own = place[begins[i] : begins[i] + sizes[i]]
        lists = [holders[bounds[t] : bounds[t + 1]] for t in own.tolist()]
        threshold = -(-least * int(sizes[i]) // 100)
        for j in occurrence_search(lists, threshold, sets, sets[i], skip).tolist():
            if labels[i] != labels[j]:
                together = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * together >= least * (sizes[i] + sizes[j] - together):
                    links.append((int(names[i]), int(names[j])))
                    labels[labels == labels[j]] = labels[i]
    return links


def _search(least: int):
    def run(table: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if table.num_rows:
            table = table.sort_by([("cell", "ascending"), ("part", "ascending"), ("node", "ascending")]).combine_chunks()
            key = np.stack([int64s(table["cell"].chunk(0)), int64s(table["part"].chunk(0))])
            names, labels = int64s(table["node"].chunk(0)), int64s(table["label"].chunk(0))
            asks = table["asks"].chunk(0).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), table.num_rows], strict=True):
                sets = []
                for _, _, offsets, data in whole_texts(table["text"].chunk(0).slice(a, b - a), BATCH_BYTES):
                    hashes, sizes = _sets(offsets, data)
                    sets += np.split(hashes, np.cumsum(sizes)[:-1])
                links += links_of_cell(names[a:b], sets, labels[a:b], asks[a:b], least)
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["u", "v"])

    return run


def _searched(assigned: DataFrame, texts: DataFrame, bins: int, least: int) -> DataFrame:
    """Links found in (cell, part, node, label, asks) rows, whose texts are fetched by node. A bin is some whole parts."""
    rows = assigned.join(texts, assigned["node"] == texts["name"]).select("cell", "part", "node", "label", "asks", "text")
    return rows.groupBy(F.pmod(F.xxhash64("cell", "part"), F.lit(bins))).applyInArrow(_search(least), "u long, v long")


def near_duplicates(docs: DataFrame, least: int = LEAST, cell_nodes: int = CELL_NODES, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """(doc_id, name, n_shingles, component) of each row of ``docs`` (doc_id, text, ...); ``component`` is the least name reachable.

    Sets are linked when 100 x intersection >= ``least`` x union; a text without words is linked with nothing. Rows without an id
    get a name above all ids from their text. Repeated rows are equal sets and share a component. Extra columns are not read.
    """
    spark = docs.sparkSession
    scratch_dir(spark)
    texts = docs.select(_name().alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, min(MOST_BUCKETS, -(-2 * total // BATCH_BYTES)))
    described = texts.mapInArrow(_describe, "name long, node long, n_shingles long, digest binary").checkpoint()
    nodes = described.filter("n_shingles > 0").groupBy("node", "digest").agg(F.max("n_shingles").alias("n_shingles"))
    nodes = nodes.withColumn("prime", F.min("node").over(Window.partitionBy("digest"))).checkpoint()
    copies = nodes.filter("node != prime").select(F.col("node").alias("u"), F.col("prime").alias("v"))
    prime = nodes.filter("node = prime").groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))

    counts = spark.sparkContext.broadcast(shingle_counts(texts))
    prefixes = texts.mapInArrow(_send_prefixes(counts, buckets, least), "bucket int, n int, prints binary, nodes binary, sizes binary")
    members = prefixes.groupBy("bucket").applyInArrow(_cells, "cell long, node long").distinct().join(prime, "node")
    cells = members.groupBy("cell").agg(F.count("*").alias("held"), F.sum("n_shingles").alias("load")).filter("held > 1")
    parts = F.greatest(F.lit(1), F.ceil(F.col("load") / cell_shingles), F.ceil(F.col("held") / cell_nodes)).cast("int")
    placed = members.join(cells.select("cell", parts.alias("parts")), "cell").withColumn(
        "in_parts", F.when(F.col("node") == F.col("cell"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts"))))
    )
    placed = placed.select("cell", "parts", "node", "n_shingles", F.explode("in_parts").alias("part")).checkpoint()
    load = placed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bins = max(8, -(-load // (2 * cell_shingles)))
    first = _searched(placed.withColumn("label", F.col("node")).withColumn("asks", F.lit(True)), texts, bins, least)
    edges = first.unionByName(copies).checkpoint()
    found = connected_components(edges)

    split = placed.filter("parts > 1")
    if not split.isEmpty():
        # Members of split cells outside the cell's main component search the parts that they are not in.
        labelled = split.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").withColumn("label", F.coalesce("component", "node"))
        shares = labelled.groupBy("cell", "label").agg(F.count("*").alias("held"))
        main = shares.groupBy("cell").agg(F.max_by("label", F.struct("held", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").select("cell", "main")
        open_ = labelled.join(main, "cell").select("cell", "parts", "node", "part", "label", "main")
        index = open_.select("cell", "part", "node", "label", F.lit(False).alias("asks"))
        asking = open_.filter("label != main").select("cell", "node", "label", "parts", F.col("part").alias("own"))
        asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part != own")
        again = index.unionByName(asking.select("cell", "part", "node", "label", F.lit(True).alias("asks"))).checkpoint()
        bins = max(8, -(-again.count() // cell_nodes))
        found = connected_components(edges.unionByName(_searched(again, texts, bins, least)))
    rows = described.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    plain = rows.select("name", "n_shingles", F.coalesce("component", "node").alias("component"))
    return plain.select(F.when(F.col("name") < _NO_ID, F.col("name")).alias("doc_id"), "name", "n_shingles", "component")


def one_of_each(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of its least document stays, unchanged.

    Of rows that share that document's id and text, all stay.
    """
    copies = near_duplicates(docs, least).filter("name != component").select(F.col("name").alias("_copy")).distinct()
    return docs.join(copies, _name() == F.col("_copy"), "left_anti")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", "n_shingles", F.when(F.col("component") < _NO_ID, F.col("component")).alias("component_id"))


QUERIES = {"op3_jaccard_join": (op3_jaccard_join, None)}
