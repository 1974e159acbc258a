"""Line dedup: two Bloom filters find lines that may repeat, and only those are shuffled.

1. Every task sets the bits of its line hashes in a once-seen filter, and those that it meets again from another document in
   a twice-seen filter. Filters of tasks merge by ``once = a | b`` and ``twice = ta | tb | (a & b)``, slice by slice, streaming.
2. A line whose bits are all in the merged twice-seen filter is a suspect. Only suspects travel. Within a batch the smallest
   document id of a line stands for the batch, so a line of a third of all documents is one row per batch and task.
3. Equal suspects meet by their exact text; the smallest document keeps the line. Lost lines are cut in one join by document.

The filters have a fixed size (``filter_bits``), so what is broadcast is bounded; a fuller filter only sends more suspects, and
the result stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.batches import BLANKS, LOWER, blob, order_id, packed, unblob, unpacked

FILTER_BITS = 1 << 26
SLICES = 64
MIN_CHARS = 10
_HELD = 1 << 21  # hashes that a task gathers before it sets bits


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).translate(LOWER)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def document_keys(text: bytes, least: int) -> set[bytes]:
    """The keys of a text that take part."""
    return {k for k in map(line_key, set(text.split(b"\n"))) if _long_enough(k, least)}


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)


def _add(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    """Sets the bits of hashes, one for each document that has the line."""
    for positions in _positions(hashes, bits):
        at, count = np.unique(positions, return_counts=True)
        word, first = np.unique(at >> np.uint64(3), return_index=True)
        bit = np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))
        seen = np.bitwise_or.reduceat(bit, first)
        again = np.bitwise_or.reduceat(np.where(count > 1, bit, np.uint8(0)), first)
        twice[word] |= again | (seen & once[word])
        once[word] |= seen


def _task_filters(least: int, bits: int):
    def run(batches):
        once, twice, held, n = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), [], 0
        for batch in batches:
            seen: dict[int, set[bytes]] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    keys = document_keys(text, least)
                    if doc in seen:
                        keys -= seen[doc]
                    seen.setdefault(doc, set()).update(keys)
                    held.extend(map(xxhash.xxh3_64_intdigest, keys))
            if len(held) >= _HELD:
                _add(once, twice, np.array(held, np.uint64), bits)
                n, held = n + len(held), []
        if held:
            _add(once, twice, np.array(held, np.uint64), bits)
            n += len(held)
        if n:
            size = bits // 8 // SLICES
            parts = [slice(i * size, (i + 1) * size) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([blob(once[p]) for p in parts], pa.binary()), pa.array([blob(twice[p]) for p in parts], pa.binary())],
                ["slice", "once", "twice"],
            )

    return run


def _merge_filters(bits: int):
    size = bits // 8 // SLICES

    def run(batches):
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for number, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = unblob(once, np.uint8, size), unblob(twice, np.uint8, size)
                if number in state:
                    a, b = state[number]
                    o, t = a | o, b | t | (a & o)
                state[number] = (o, t)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), pa.array([blob(t) for _, t in state.values()], pa.binary())], ["slice", "twice"])

    return run


def twice_seen(docs: DataFrame, least: int = MIN_CHARS, bits: int = FILTER_BITS) -> np.ndarray:
    """The twice-seen filter of a (id, text as binary) frame: ``bits / 8`` bytes at any size of the input."""
    parts = docs.mapInArrow(_task_filters(least, bits), "slice int, once binary, twice binary")
    merged = parts.repartition(SLICES, "slice").mapInArrow(_merge_filters(bits), "slice int, twice binary")
    filter_, size = np.zeros(bits // 8, np.uint8), bits // 8 // SLICES
    for number, data in merged.collect():  # SLICES rows
        filter_[number * size : (number + 1) * size] = unblob(bytes(data), np.uint8, size)
    return filter_


def _suspects(shared, least: int, bits: int):
    def run(batches):
        twice = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held: dict[bytes, set[int]] = {}
            for doc, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                if text:
                    for key in document_keys(text, least):
                        held.setdefault(key, set()).add(doc)
            if not held:
                continue
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held))
            sure = np.ones(len(held), bool)
            for at in _positions(hashes, bits):
                sure &= (twice[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            lines, docs, lost = [], [], []
            for (key, owners), suspect in zip(held.items(), sure.tolist(), strict=True):
                if suspect:
                    first = min(owners)
                    for doc in owners:
                        lines.append(key)
                        docs.append(doc)
                        lost.append(doc != first)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array(docs, pa.int64()), pa.array(lost, pa.bool_())], ["line", "doc", "lost"])

    return run


def _cut(batches):
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, gone in zip(batch.column("_text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            kept = lines
            if gone:
                gone = set(gone)
                kept = [x for x in lines if line_key(x) not in gone]
            texts.append(b"\n".join(kept).decode("utf-8", "replace"))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["_row", "text", "n_lines", "n_dropped"]
        )


def repeated_lines(docs: DataFrame, least: int = MIN_CHARS, bits: int = FILTER_BITS) -> DataFrame:
    """(doc, gone): the line keys that each document of a (id, text as binary) frame loses."""
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, least, bits))
    pairs = docs.mapInArrow(_suspects(shared, least, bits), "line binary, doc long, lost boolean")
    # A row that lost within its batch is alone in its group; one row per batch and line is left to compare.
    group = Window.partitionBy("line", F.when(F.col("lost"), F.col("doc")))
    first = pairs.withColumn("first", F.min("doc").over(group)).filter(F.col("lost") | (F.col("doc") > F.col("first")))
    return first.groupBy("doc").agg(F.collect_set("line").alias("gone"))


def line_dedup(docs: DataFrame, least: int = MIN_CHARS, bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` cut, and n_lines (before) and n_dropped.

    A line's key is the line without blanks at both ends, A-Z lowered. Keys of at least ``least`` code points stay only in the
    smallest document that holds them (there, every occurrence); other lines stay. A null or empty text is one empty line.
    Null ids count as one document after all others; rows that share an id are one document. Other columns pass through; columns
    called n_lines or n_dropped are replaced.
    """
    row, names = packed(docs, ("text", "n_lines", "n_dropped"))
    rows = docs.select(row.alias("_row"), order_id("doc_id").alias("_id"), F.col("text").cast("binary").alias("_text"))
    gone = repeated_lines(rows.select("_id", "_text"), least, bits)
    joined = rows.join(gone, rows["_id"] == gone["doc"], "left").select("_row", "_text", F.col("gone").alias("_gone"))
    schema = T.StructType([joined.schema["_row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_cut, schema).select(*unpacked(names), "text", "n_lines", "n_dropped")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.*, coalesce(k.doc_id > f.first_doc, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUERIES = {"op10_line_dedup": (op10_line_dedup, SQL)}
