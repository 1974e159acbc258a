"""SentencePiece encoding that keeps source positions, and decoding.

Encoding follows three steps, inside tasks and batch by batch:

1. Normalisation. At each place the longest prefix that the model's compiled character map knows is replaced, otherwise one
   character is kept; every normalised character remembers the bytes it came from. A model without a map keeps every character.
2. Byte-pair merges, best score first and leftmost among equals. No piece holds certain neighbours (a letter before a word mark,
   anything beside a line end), so texts are cut there and each distinct cut is merged once per task.
3. Characters without a piece become byte pieces. Every piece is projected to the original bytes it covers.

The model is read once on the driver and travels to the tasks as its bounded list of pieces.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from array import array
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.batches import packed, unpacked

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_CACHED_CUTS, _SHORT, _GROUP_CHARS = 400_000, 48, 1 << 21


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes whose values point into replacement strings."""

    def __init__(self, data: bytes):
        (size,) = struct.unpack_from("<I", data) if data else (0,)
        self.units = struct.unpack_from(f"<{size // 4}I", data, 4) if size else ()
        self.strings = data[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest known prefix of ``text[at:]``."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._child(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


@dataclass
class Model:
    """What encoding needs of a model: pieces with scores and kinds, the character map, and the white-space rules."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    charmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = False

    @classmethod
    def read(cls, path: str) -> Model:
        """A byte-pair model with byte pieces; other kinds of model are refused."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        held = proto.ModelProto()
        with open(path, "rb") as file:
            held.ParseFromString(file.read())
        rules, how = held.normalizer_spec, held.trainer_spec
        if how.model_type != how.BPE or not how.byte_fallback or how.treat_whitespace_as_suffix or not rules.escape_whitespaces:
            raise ValueError("only byte-pair models with byte pieces and leading word marks are supported")
        if any(p.type == _USER for p in held.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        return cls(
            [p.piece for p in held.pieces], [p.score for p in held.pieces], [p.type for p in held.pieces],
            bytes(rules.precompiled_charsmap), rules.add_dummy_prefix, rules.remove_extra_whitespaces,
        )

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    @cached_property
    def held(self) -> dict[str, bytes]:
        """Cuts merged so far with their ids, packed; emptied when it is full."""
        return {}

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(keys of neighbours that merge, place of what they make, id by place, id by character), for merging many cuts at once.

        Runs of marks share a score in many models and are left out; cuts that have one merge alone. None if other pieces share a
        score or a piece has a character that is no piece: such models merge cut by cut.
        """
        ids, places = self.ids, {p: n for p, n in self.order.items() if p == MARK or set(p) != {MARK}}
        longer = [n for p, n in places.items() if len(p) > 1]
        if len(set(longer)) < len(longer) or any(c not in ids for p in ids for c in p):
            return None
        made = {ids[p[:i]] * len(self.pieces) + ids[p[i:]]: places[p] for p in places for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids}
        keys = np.array(sorted(made), np.int64)
        by_place = np.zeros(len(ids), np.int32)
        by_place[longer] = [ids[p] for p in places if len(p) > 1]
        by_char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                by_char[ord(p)] = i
        by_char[ord(" ")] = by_char[ord(MARK)]
        return keys, np.array([made[k] for k in keys.tolist()], np.int32), by_place, by_char

    @cached_property
    def widths(self) -> np.ndarray:
        """Source bytes of each piece where nothing is mapped: a mark stands for one blank."""
        return np.array([1 if k == _BYTE else len(p.replace(MARK, " ").encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.uint32)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (_NORMAL, _UNUSED)}

    @cached_property
    def order(self) -> dict[str, int]:
        """A piece's place among all scores, best first; equal scores share a place."""
        best = sorted({self.scores[i] for i in self.ids.values()}, reverse=True)
        place = {score: n for n, score in enumerate(best)}
        return {p: place[self.scores[i]] for p, i in self.ids.items()}

    @cached_property
    def byte_ids(self) -> list[int]:
        named = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        return [named[f"<0x{b:02X}>"] for b in range(256)]

    @cached_property
    def control(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _CONTROL}

    @cached_property
    def map(self) -> CharMap:
        return CharMap(self.charmap)

    @cached_property
    def cutter(self) -> re.Pattern | None:
        """Cuts a text where no piece can reach across; None if this vocabulary has pieces that do."""
        inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any("\n" in pair or (pair[1] == MARK and pair[0] != MARK) for pair in inner):
            return None
        return re.compile(f"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n")

    @cached_property
    def surfaces(self) -> list[bytes]:
        out = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            plain = piece.replace(MARK, " ").encode()
            out.append(b"" if kind == _CONTROL else bytes([self.byte_ids.index(i)]) if kind == _BYTE else " ⁇ ".encode() if kind == _UNKNOWN else plain)
        return out

    def normalise(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """(characters, first byte, end byte) of the normalised text."""
        raw = text.encode()
        chars, starts, ends, at = [], [], [], 0
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit:
                size, new = hit[0], hit[1].decode()
            else:
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                new = raw[at : at + size].decode()
            for c in new:
                if self.squeeze and c == " " and (not chars or chars[-1] == MARK):
                    continue
                chars.append(MARK if c == " " else c)
                starts.append(at)
                ends.append(at + size)
            at += size
        while self.squeeze and chars and chars[-1] == MARK:
            chars.pop(), starts.pop(), ends.pop()
        if chars and self.dummy_prefix:
            chars.insert(0, MARK), starts.insert(0, starts[0]), ends.insert(0, starts[1])
        return chars, starts, ends

    def merge(self, chars: list[str]) -> list[int]:
        """Characters in each piece after all merges."""
        n, ids, scores = len(chars), self.ids, self.scores
        text, size = list(chars), [1] * n
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, int]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < n:
                joined = ids.get(text[left] + text[after[left]])
                if joined is not None:
                    heapq.heappush(queue, (-scores[joined], left, size[left] + size[after[left]]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, left, length = heapq.heappop(queue)
            right = after[left] if size[left] else n
            if right >= n or size[left] + size[right] != length:
                continue
            text[left] += text[right]
            size[left], size[right] = length, 0
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [s for s in size if s]

    def merged(self, text: str) -> list[str]:
        """The pieces of a normalised text; a character without a piece stays alone."""
        if len(text) > _SHORT:
            out, at = [], 0
            for count in self.merge(list(text)):
                out.append(text[at : at + count])
                at += count
            return out
        parts, order, none = list(text), self.order, len(self.pieces)
        ranks = [order.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = order.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = order.get(parts[i] + parts[i + 1], none)
        return parts

    def _slow_ids(self, cut: str) -> bytes:
        ids: list[int] = []
        for piece in self.merged(cut.replace(" ", MARK)):
            known = self.ids.get(piece)
            ids.extend([known] if known is not None else [self.byte_ids[b] for b in piece.encode()])
        return array("I", ids).tobytes()

    def _merge_many(self, cuts: list[str], length: int) -> dict[str, bytes]:
        """Ids of cuts of one length: in each round every cut that can merges its best neighbours."""
        keys, places, by_place, by_char = self.pairs
        none, out, names = len(by_place), {}, np.array(cuts, object)
        rows = by_char[np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)].reshape(len(cuts), length)
        odd = (rows < 0).any(1)
        out.update((c, self._slow_ids(c)) for c in names[odd])
        rows, names = rows[~odd], names[~odd]

        def place(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = left.astype(np.int64) * len(self.pieces) + right
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, places[at], none).astype(np.int32)

        ranks = place(rows[:, :-1], rows[:, 1:])
        while len(rows):
            width = rows.shape[1]
            best = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            done = ranks[np.arange(len(rows)), best] == none if width > 1 else np.ones(len(rows), bool)
            packed_ids = rows[done].astype("<u4").tobytes()
            out.update((c, packed_ids[4 * width * i : 4 * width * (i + 1)]) for i, c in enumerate(names[done]))
            rows, ranks, names, best = rows[~done], ranks[~done], names[~done], best[~done]
            if not len(rows):
                break
            each = np.arange(len(rows))
            rows[each, best] = by_place[ranks[each, best]]
            left = np.ones(rows.shape, bool)
            left[each, best + 1] = False
            gone = np.ones(ranks.shape, bool)
            gone[each, best] = False
            rows, ranks = rows[left].reshape(len(rows), width - 1), ranks[gone].reshape(len(rows), width - 2)
            for shift in (-1, 0):
                ok = np.flatnonzero((best + shift >= 0) & (best + shift < width - 2))
                at = best[ok] + shift
                ranks[ok, at] = place(rows[ok, at], rows[ok, at + 1])
        return out

    def _learn(self, cuts: set[str]) -> None:
        """Merges the cuts that are not held yet."""
        if len(self.held) > _CACHED_CUTS:
            self.held.clear()
        by_length: dict[int, list[str]] = {}
        for cut in cuts - self.held.keys():
            by_length.setdefault(0 if len(cut) > _SHORT or "  " in cut or not self.pairs else len(cut), []).append(cut)
        for length, group in by_length.items():
            self.held.update(self._merge_many(group, length) if length else {c: self._slow_ids(c) for c in group})

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first byte, end byte) of each text, without begin and end ids."""
        none = (np.zeros(0, np.uint32),) * 3
        if self.charmap or self.squeeze or self.cutter is None:
            return [self._encode_mapped(t) if t else none for t in texts]
        cut = [[] if MARK in t or not t else self.cutter.findall(" " + t if self.dummy_prefix else t) for t in texts]
        self._learn(set().union(*cut))
        out, get = [], self.held.__getitem__
        for text, cuts in zip(texts, cut, strict=True):
            if not cuts:
                out.append(self._encode_mapped(text) if text else none)
                continue
            ids = np.frombuffer(b"".join(map(get, cuts)), "<u4")
            sizes = self.widths[ids]
            if self.dummy_prefix:
                sizes[0] -= 1  # the added mark has no source
            ends = np.cumsum(sizes, dtype=np.uint32)
            out.append((ids, ends - sizes, ends))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_many([text])[0]

    def _encode_mapped(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chars, first, last = self.normalise(text)
        ids, starts, ends, at = [], [], [], 0
        for count in self.merge(chars) if chars else []:
            known = self.ids.get("".join(chars[at : at + count]))
            found = [known] if known is not None else [self.byte_ids[b] for b in chars[at].encode()]
            ids += found
            whole = known is not None or last[at] - first[at] != len(found)
            starts += [first[at]] if known is not None else [first[at] + (0 if whole else i) for i in range(len(found))]
            ends += [last[at + count - 1]] if known is not None else [last[at] if whole else first[at] + i + 1 for i in range(len(found))]
            at += count
        return np.array(ids, np.uint32), np.array(starts, np.uint32), np.array(ends, np.uint32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unlike plain joining, one leading mark of the text's first piece goes."""
        surfaces, skip = self.surfaces, 0
        first = next((i for i in ids if surfaces[i]), None)
        if (self.dummy_prefix or self.squeeze) and first is not None and self.kinds[first] in (_NORMAL, _UNUSED) and self.pieces[first][0] == MARK:
            skip = 1
        runs, controls = [[]], set(self.control.values())
        if controls.isdisjoint(ids[1:-1]):  # bytes on two sides of a control id never form one character
            runs = [ids]
        else:
            for i in ids:
                runs.append([]) if i in controls else runs[-1].append(i)
        return "".join(b"".join([surfaces[i] for i in run]).decode("utf-8", "each_byte") for run in runs)[skip:]


def _encoded(model: Model, texts: pa.Array):
    """Encodes the texts of a column in groups of about _GROUP_CHARS characters."""
    group, size = [], 0
    for text in texts:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= _GROUP_CHARS:
            yield from model.encode_many(group)
            group, size = [], 0
    yield from model.encode_many(group)


def _packed_columns(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], arrays: bool) -> list[pa.Array]:
    if arrays:
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64), kind)) for k, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))]
    return [pa.array([r[0].astype("<u4").tobytes() for r in rows], pa.binary()), pa.array([np.stack(r[1:], 1).astype("<u4").tobytes() for r in rows], pa.binary())]


def encode(docs: DataFrame, path: str, begin: str | None = "<s>", end: str | None = "</s>", arrays: bool = True) -> DataFrame:
    """``docs`` (text, ...) with ids (array of int) and the source bytes of each, starts and ends (arrays of long).

    With ``arrays=False``: ids as little-endian unsigned 32-bit integers and spans as pairs of such, both binary. Begin and end ids
    cover no bytes. A null or empty text has no other ids. Other columns pass through; columns of the new names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model.read(path))
    made = {"ids": T.ArrayType(T.IntegerType()), "starts": T.ArrayType(T.LongType()), "ends": T.ArrayType(T.LongType())} if arrays else {"ids": T.BinaryType(), "spans": T.BinaryType()}
    row, names = packed(docs, tuple(made))
    rows = docs.select(row.alias("_row"), F.col("text").alias("_text"))

    def run(batches):
        own = model.value
        head = [own.control[begin]] if begin else []
        tail = [own.control[end]] if end else []
        for batch in batches:
            out = []
            for ids, starts, ends in _encoded(own, batch.column(1)):
                stop = [int(ends[-1]) if len(ends) else 0] * len(tail)
                out.append(tuple(np.concatenate([a, b, c]).astype(np.uint32) for a, b, c in ((head, ids, tail), ([0] * len(head), starts, stop), ([0] * len(head), ends, stop))))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_packed_columns(out, arrays)], ["_row", *made])

    schema = T.StructType([rows.schema["_row"], *(T.StructField(n, t) for n, t in made.items())])
    return rows.mapInArrow(run, schema).select(*unpacked(names), *made)


def decode(rows: DataFrame, path: str, to: str = "decoded") -> DataFrame:
    """``rows`` (ids, ...) with the text of ids, an array of int or packed as by ``encode``; null ids give a null."""
    model = rows.sparkSession.sparkContext.broadcast(Model.read(path))
    row, names = packed(rows, (to,))
    given = rows.select(row.alias("_row"), F.col("ids").alias("_ids"))

    def run(batches):
        own = model.value
        for batch in batches:
            column = batch.column(1)
            if pa.types.is_binary(column.type):
                lists = [None if x is None else np.frombuffer(x, "<u4").tolist() for x in column.to_pylist()]
            else:
                lists = column.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else own.decode(x) for x in lists], pa.string())], ["_row", "_text"])

    schema = T.StructType([given.schema["_row"], T.StructField("_text", T.StringType())])
    return given.mapInArrow(run, schema).select(*unpacked(names), F.col("_text").alias(to))


def model_path() -> str:
    """The public tokenizer file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def round_trip(docs: DataFrame, path: str, begin: str = "<s>", end: str = "</s>") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256): what ``encode`` and ``decode`` give for each text, as digests.

    Both run on a text in one task, so neither ids nor texts travel. Nulls and empty texts as in ``encode``.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model.read(path))

    def run(batches):
        own = model.value
        head, tail = [own.control[begin]], [own.control[end]]
        for batch in batches:
            out = []
            for ids, starts, ends in _encoded(own, batch.column(1)):
                stop = [int(ends[-1]) if len(ends) else 0]
                ids = np.concatenate([head, ids, tail]).astype("<u4")
                spans = np.stack([np.concatenate([[0], starts, stop]), np.concatenate([[0], ends, stop])], 1).astype("<u4")
                decoded = own.decode(ids.tolist()).encode()
                out.append((len(ids), *(hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), decoded, spans.tobytes()))))
            if out:
                n_tokens, *digests = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), *(pa.array(d, pa.string()) for d in digests)], made)

    made = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op1_pieces(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())


QUERIES = {"op1_pieces": (op1_pieces, None)}
