"""Suffix-array dedup: removes bytes covered by strings that also start in an earlier document.

Every window of ``length`` bytes is named by the least hash of its ``GRAM``-byte substrings, so equal windows have equal names
wherever they stand, and neighbouring windows mostly share a name: a run of such windows is the unit of work.

1. Documents are dealt into chunks of about ``CHUNK_BYTES`` by hash. A chunk sends each of its names once, as a 32-bit
   fingerprint in a bucket with the number of its runs; names seen by two chunks come back to them as suspects. False ones only
   cost time.
2. A chunk sends the distinct texts of its suspect runs once each, with the least document that has it: a passage in a third of
   all documents is one row per chunk. In its bucket, suffix sorting finds equal runs; where different runs share a name their
   windows are sorted as suffixes, and a common extension of ``length`` bytes joins them. The least document of each window
   goes back to the chunks.
   A name with many runs (a phrase that stands in many different surroundings) is dealt over several buckets by a hash of the whole
   window: equal windows still meet, and each bucket looks only at the windows of its share.
3. A chunk marks the windows that start in an earlier document and cuts the bytes they cover.

The three steps read one shuffle of the documents. Work and memory of a task follow its chunk or bucket, not the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reportmill.llm.batches import as_bytes, blob, int64s, order_id, packed, unblob, unpacked
from reportmill.llm.suffixes import Hashed, mix, sliding_min, spread, suffix_sort

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 2 << 20
SHARE = 1 << 18  # windows of a name that a bucket looks at, about
_STRIDE = np.uint64(0x9E3779B97F4A7C15)  # fixed value: tells the shares of a name apart
_STEP_BYTES = 1 << 19  # sorted at a time within a bucket


class Runs:
    """The runs of a chunk: windows [first, first + count) of one document that share a name."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, length: int, gram: int):
        self.text, self.length = Hashed(data), length
        sizes = np.diff(offsets)
        self.first = self.count = self.doc = np.zeros(0, np.int64)
        self.name = np.zeros(0, np.uint64)
        if len(data) >= length:
            names = sliding_min(self.text.windows(gram), length - gram + 1)
            # Windows that start in the last bytes of a text reach into the next one and belong to nobody.
            cross = np.zeros(len(names) + 1, bool)
            tail = np.minimum(sizes, length - 1)
            at = spread(offsets[1:] - tail, tail)
            cross[at[at <= len(names)]] = True
            cross = cross[:-1]
            change = np.ones(len(names), bool)
            change[1:] = (names[1:] != names[:-1]) | (cross[1:] != cross[:-1])
            begins = offsets[:-1][sizes > 0]
            change[begins[begins < len(names)]] = True
            first = np.flatnonzero(change)
            count = np.diff(np.append(first, len(names)))
            real = ~cross[first]
            self.first, self.count, self.name = first[real], count[real], mix(names[first[real]])
            self.doc = ids[np.searchsorted(offsets, self.first, "right") - 1]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each run, one run for each number): runs of equal text have equal numbers, whatever the order of rows."""
        size = self.count + (self.length - 1)
        whole = mix(self.text.of(self.first, size))
        order = np.lexsort((size, self.name, whole))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([key[order[1:]] != key[order[:-1]] for key in (whole, self.name, size)])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return number, order[new]


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _chunk(table: pa.Table, length: int, gram: int) -> tuple[Runs, np.ndarray, np.ndarray]:
    texts = table["_text"].combine_chunks()
    offsets, data = as_bytes(texts)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    return Runs(int64s(table["_id"].combine_chunks()), offsets, data, length, gram), offsets, data


def _send_names(length: int, gram: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        runs, _, _ = _chunk(table, length, gram)
        chunk = table["_chunk"][0].as_py()
        names, times = np.unique(runs.name, return_counts=True)
        bucket, print_ = _bucket(names, buckets), names.astype(np.uint32)
        order = np.lexsort((print_, bucket))
        bucket, print_, times = bucket[order], print_[order], times[order]
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (print_[1:] != print_[:-1])
        times = np.add.reduceat(times, np.flatnonzero(new)).astype(np.uint32) if len(order) else times
        bucket, print_ = bucket[new], print_[new]
        held, first = np.unique(bucket, return_index=True)
        parts, counts = (np.split(x, first[1:]) if len(held) else [] for x in (print_, times))
        columns = [pa.array([blob(np.diff(p, prepend=np.uint32(0))) for p in parts], pa.binary()), pa.array(list(map(blob, counts)), pa.binary())]
        return pa.table([pa.array(held, pa.int32()), pa.array([chunk] * len(held), pa.int64()), pa.array([len(p) for p in parts], pa.int32()), *columns], ["bucket", "chunk", "n", "prints", "counts"])

    return run


def _shared_names(most_windows: int, per_run: int):
    """Prints that two chunks or more sent, for each chunk its own, with the number of shares their windows are dealt in."""

    def run(table: pa.Table) -> pa.Table:
        bucket, chunks, n, prints, counts = (table[c].to_pylist() for c in ("bucket", "chunk", "n", "prints", "counts"))
        lists = [np.cumsum(unblob(p, np.uint32, k), dtype=np.uint32) for p, k in zip(prints, n, strict=True)]
        every, times = np.concatenate(lists), np.concatenate([unblob(c, np.uint32, k) for c, k in zip(counts, n, strict=True)]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        every, times = every[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        several = np.diff(np.append(first, len(every))) > 1
        shared = every[first[several]]
        shares = (1 + np.add.reduceat(times, first)[several] * per_run // most_windows).astype(np.uint32)
        at = [np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in lists]
        held = [(x[shared[i] == x], shares[i][shared[i] == x]) if len(shared) else (x[:0], x[:0]) for x, i in zip(lists, at, strict=True)]
        keep = [i for i, (x, _) in enumerate(held) if len(x)]
        columns = [pa.array([chunks[i] for i in keep], pa.int64()), pa.array([bucket[i] for i in keep], pa.int32()), pa.array([len(held[i][0]) for i in keep], pa.int32())]
        columns += [pa.array([blob(held[i][k]) for i in keep], pa.binary()) for k in (0, 1)]
        return pa.table(columns, ["chunk", "bucket", "n", "prints", "shares"])

    return run


def _window_shares(windows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The share each window falls into: equal windows of a name fall into the same."""
    return ((windows >> np.uint64(20)) % shares.astype(np.uint64)).astype(np.int64)


def _dealt(text: Hashed, first: np.ndarray, count: np.ndarray, shares: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, share, offset) of every window of the given runs, ordered by them."""
    run, offset = np.repeat(np.arange(len(first)), count), spread(np.zeros(len(first), np.int64), count)
    share = _window_shares(mix(text.of(first[run] + offset, length)), shares[run])
    order = np.lexsort((offset, share, run))
    return run[order], share[order], offset[order]


_SENT = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("bytes", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary())]
    + [("shares", pa.binary()), ("share", pa.binary()), ("texts", pa.binary())]
)


def _send_runs(length: int, gram: int, buckets: int):
    def run(docs: pa.Table, suspects: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SENT.empty_table()
        runs, _, data = _chunk(docs, length, gram)
        number, held = runs.distinct()
        bucket = _bucket(runs.name[held], buckets)
        code = (bucket.astype(np.uint64) << np.uint64(32)) | runs.name[held].astype(np.uint32)
        listed = [(np.uint64(b) << np.uint64(32)) | unblob(p, np.uint32, k).astype(np.uint64) for b, k, p in zip(*(suspects[c].to_pylist() for c in ("bucket", "n", "prints")), strict=True)]
        dealt = [unblob(p, np.uint32, k) for k, p in zip(*(suspects[c].to_pylist() for c in ("n", "shares")), strict=True)]
        sent, dealt = np.concatenate([np.zeros(0, np.uint64), *listed]), np.concatenate([np.zeros(0, np.uint32), *dealt])
        order = np.argsort(sent)
        sent, dealt = sent[order], dealt[order].astype(np.int64)
        at = np.minimum(np.searchsorted(sent, code), max(len(sent) - 1, 0))
        sure = sent[at] == code if len(sent) else np.zeros(len(code), bool)
        shares = np.where(sure, dealt[at], 1) if len(sent) else np.ones(len(code), np.int64)
        # Within the chunk: names that documents with different ids have.
        order = np.lexsort((runs.doc, runs.name))
        ranked, docs_ranked = runs.name[order], runs.doc[order]
        several = np.unique(ranked[1:][(ranked[1:] == ranked[:-1]) & (docs_ranked[1:] != docs_ranked[:-1])])
        sure |= np.isin(runs.name[held], several)
        least = np.full(len(held), np.iinfo(np.int64).max)
        np.minimum.at(least, number, runs.doc)
        # A run of a name in several shares goes to the bucket of each share that one of its windows falls into.
        whole, split = np.flatnonzero(sure & (shares == 1)), np.flatnonzero(sure & (shares > 1))
        of, share, _ = _dealt(runs.text, runs.first[held[split]], runs.count[held[split]], shares[split], length)
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (share[1:] != share[:-1])
        picked, share = np.concatenate([whole, split[of[new]]]), np.concatenate([np.zeros(len(whole), np.int64), share[new]])
        spot = runs.name[held[picked]] + share.astype(np.uint64) * _STRIDE
        target = np.where(shares[picked] == 1, bucket[picked], _bucket(mix(spot), buckets))
        order = np.argsort(target, kind="stable")
        picked, share, target = picked[order], share[order], target[order]
        size = runs.count[held] + (length - 1)
        groups, first = np.unique(target, return_index=True)
        rows = []
        for b, numbers, parts in zip(groups.tolist(), *(np.split(x, first[1:]) if len(groups) else [] for x in (picked, share)), strict=True):
            text = data[spread(runs.first[held[numbers]], size[numbers])]
            columns = (numbers.astype(np.uint32), size[numbers].astype(np.uint32), least[numbers], shares[numbers].astype(np.uint32), parts.astype(np.uint32), text)
            rows.append((b, docs["_chunk"][0].as_py(), len(numbers), len(text), *map(blob, columns)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT) if rows else _SENT.empty_table()

    return run


def _names_of(data: np.ndarray, start: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The name of each run: all its windows have the same, so the first is enough."""
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), _STEP_BYTES // length):
        places = start[i : i + _STEP_BYTES // length]
        grams = Hashed(data[(places[:, None] + np.arange(length)).ravel()]).windows(gram)
        grams = np.append(grams, np.zeros(gram - 1, np.uint64)).reshape(-1, length)
        out[i : i + len(places)] = grams[:, : length - gram + 1].min(1)
    return out


def _by_name(name: np.ndarray, size: np.ndarray):
    """Runs in groups of about _STEP_BYTES, with all runs of a name in one group."""
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    step = (np.cumsum(size[order]) - size[order])[first] // _STEP_BYTES
    return np.split(order, first[1:][step[1:] != step[:-1]])


def _least_of_windows(data: np.ndarray, size: np.ndarray, doc: np.ndarray, name: np.ndarray, length: int) -> np.ndarray:
    """The least document of each window of the runs that stand one after another in ``data``."""
    start = np.cumsum(size) - size
    order, common = suffix_sort(data, start, size)
    new = np.ones(len(order), bool)
    new[1:] = (common[1:] != size[order[1:]]) | (common[1:] != size[order[:-1]])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    head = order[new]
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
    width = size[head] - (length - 1)
    begin = np.cumsum(width) - width
    firsts = np.repeat(least, width)
    # Different runs of one name may share windows: sort those windows as suffixes.
    _, which, count = np.unique(name[head], return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[which] > 1)
    if len(mixed):
        places = spread(start[head[mixed]], width[mixed])
        slots = spread(begin[mixed], width[mixed])
        ranked, shared = suffix_sort(data, places, np.full(len(places), length, np.int64))
        new = shared < length
        new[0] = True
        best = np.minimum.reduceat(firsts[slots[ranked]], np.flatnonzero(new))
        firsts[slots[ranked]] = best[np.cumsum(new) - 1]
    return firsts[spread(begin[group], width[group])]


def _least_of_shares(data: np.ndarray, start: np.ndarray, count: np.ndarray, doc: np.ndarray, name: np.ndarray, shares: np.ndarray, share: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs that stand for one share of their name: (run, least document) of their windows in that share, in order."""
    run, part, offset = _dealt(Hashed(data), start, count, shares, length)
    mine = part == share[run]
    run, place = run[mine], start[run[mine]] + offset[mine]
    least = np.empty(len(run), np.int64)
    # One name and share at a time: about SHARE windows.
    order = np.lexsort((share[run], name[run]))
    keys = name[run[order]], share[run[order]]
    new = np.ones(len(order), bool)
    new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    for some in np.split(order, np.flatnonzero(new)[1:]) if len(order) else ():
        ranked, common = suffix_sort(data, place[some], np.full(len(some), length, np.int64))
        other = common < length
        other[0] = True
        best = np.minimum.reduceat(doc[run[some[ranked]]], np.flatnonzero(other))
        least[some[ranked]] = best[np.cumsum(other) - 1]
    return run, least


def _first_documents(length: int, gram: int):
    """For the runs of a bucket, the least document that has each of their windows."""

    def run(table: pa.Table) -> pa.Table:
        chunks, n, total, numbers, sizes, docs, splits, parts, texts = (table[c].to_pylist() for c in ("chunk", "n", "bytes", "numbers", "sizes", "docs", "shares", "share", "texts"))
        joined = lambda blobs, kind, counts: np.concatenate([unblob(x, kind, k) for x, k in zip(blobs, counts, strict=True)])
        size, doc, data = joined(sizes, np.uint32, n).astype(np.int64), joined(docs, np.int64, n), joined(texts, np.uint8, total)
        shares, share = joined(splits, np.uint32, n).astype(np.int64), joined(parts, np.uint32, n).astype(np.int64)
        start, width = np.cumsum(size) - size, size - (length - 1)
        name = _names_of(data, start, length, gram)
        whole, split = np.flatnonzero(shares == 1), np.flatnonzero(shares > 1)
        of, least = _least_of_shares(data, start[split], width[split], doc[split], name[split], shares[split], share[split], length)
        width[split] = np.bincount(of, minlength=len(split))  # windows that are answered
        begin = np.cumsum(width) - width
        firsts = np.empty(int(width.sum()), np.int64)
        firsts[spread(begin[split], width[split])] = least
        for some in _by_name(name[whole], size[whole]) if len(whole) else ():
            runs = whole[some]
            firsts[spread(begin[runs], width[runs])] = _least_of_windows(data[spread(start[runs], size[runs])], size[runs], doc[runs], name[runs], length)
        ends = np.cumsum([int(width[b - k : b].sum()) for b, k in zip(np.cumsum(n).tolist(), n, strict=True)])
        out = np.split(firsts, ends[:-1])
        return pa.table(
            [pa.array(chunks, pa.int64()), pa.array(n, pa.int32()), *(pa.array(x, pa.binary()) for x in (numbers, splits, parts)), pa.array([len(x) for x in out], pa.int64()), pa.array([blob(x) for x in out], pa.binary())],
            ["chunk", "n", "numbers", "shares", "share", "n_windows", "firsts"],
        )

    return run


def _answers(runs: Runs, held: np.ndarray, decided: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, values): where the answers to each distinct run's windows begin, -1 for none, and the least documents."""
    n, n_windows = (decided[c].to_pylist() for c in ("n", "n_windows"))
    numbers, shares, share = (np.concatenate([unblob(x, np.uint32, k) for x, k in zip(decided[c].to_pylist(), n, strict=True)]).astype(np.int64) for c in ("numbers", "shares", "share"))
    values = np.concatenate([unblob(x, np.int64, k) for x, k in zip(decided["firsts"].to_pylist(), n_windows, strict=True)])
    begin, whole = np.full(len(held), -1, np.int64), shares == 1
    split = np.unique(numbers[~whole])
    if not len(split):
        width = runs.count[held[numbers]]
        begin[numbers] = np.cumsum(width) - width
        return begin, values
    # Answers of shares come in the order of their entries: each share of a run holds its windows in order.
    of_split = np.ones(len(held), np.int64)
    of_split[numbers] = shares
    of, part, offset = _dealt(runs.text, runs.first[held[split]], runs.count[held[split]], of_split[split], length)
    code = of * (1 << 32) + part
    entry = np.searchsorted(split, numbers) * (1 << 32) + share
    low, high = np.searchsorted(code, entry, "left"), np.searchsorted(code, entry, "right")
    width = np.where(whole, runs.count[held[numbers]], high - low)
    came = np.cumsum(width) - width
    every = np.unique(numbers)
    full = runs.count[held[every]]
    begin[every] = np.cumsum(full) - full
    out = np.empty(int(full.sum()), np.int64)
    out[spread(begin[numbers[whole]], width[whole])] = values[spread(came[whole], width[whole])]
    rows = spread(low[~whole], width[~whole])
    out[begin[split[of[rows]]] + offset[rows]] = values[spread(came[~whole], width[~whole])]
    return begin, out


def _cut(length: int, gram: int, schema: pa.Schema):
    def run(docs: pa.Table, decided: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        runs, offsets, data = _chunk(docs, length, gram)
        cover = np.zeros(len(data) + 1, np.int32)
        if decided.num_rows:
            number, held = runs.distinct()
            begin, values = _answers(runs, held, decided, length)
            known = np.flatnonzero(begin[number] >= 0)
            places = spread(runs.first[known], runs.count[known])
            earlier = values[spread(begin[number[known]], runs.count[known])] < np.repeat(runs.doc[known], runs.count[known])
            places = places[earlier]
            cover[places] += 1
            cover[places + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            mask = gone[a:b]
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            spans = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
            kept = data[a:b][~mask].tobytes() if len(edges) else data[a:b].tobytes()
            out.append((b - a, spans, kept))
        n_bytes, spans, kept = zip(*out, strict=True)
        columns = [docs["_row"].combine_chunks(), pa.array(n_bytes, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def span_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, share: int = SHARE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_bytes, spans (removed runs of bytes, end exclusive) and kept (the remaining bytes).

    A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id; strings are judged on the
    input and never cross documents. A null text is empty; a null id comes after all others; rows that share an id, repeated rows
    among them, do not remove each other. Other columns but text pass through; columns of the new names are replaced.
    """
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())]
    row, names = packed(docs, ("text", "n_bytes", "spans", "kept"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(8, chunks)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("_chunk"), order_id("doc_id").alias("_id"), row.alias("_row"), text.alias("_text"))
    dealt = rows.groupBy("_chunk")
    prints = dealt.applyInArrow(_send_names(length, gram, buckets), "bucket int, chunk long, n int, prints binary, counts binary")
    suspects = prints.groupBy("bucket").applyInArrow(_shared_names(share, length - gram + 1), "chunk long, bucket int, n int, prints binary, shares binary")
    sent = dealt.cogroup(suspects.groupBy("chunk")).applyInArrow(
        _send_runs(length, gram, buckets), "bucket int, chunk long, n int, bytes long, numbers binary, sizes binary, docs binary, shares binary, share binary, texts binary"
    )
    decided = sent.groupBy("bucket").applyInArrow(_first_documents(length, gram), "chunk long, n int, numbers binary, shares binary, share binary, n_windows long, firsts binary")
    schema = T.StructType([rows.schema["_row"], *made])
    cut = dealt.cogroup(decided.groupBy("chunk")).applyInArrow(_cut(length, gram, to_arrow_schema(schema)), schema)
    return cut.select(*unpacked(names), "n_bytes", "spans", "kept")


def op2_span_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return span_dedup(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_span_dedup": (op2_span_dedup, None)}
