"""Encoding and decoding against the sentencepiece library, and the source spans."""

import random

import pytest
import sentencepiece

from reportmill.llm import pieces

ODD = [
    "", " ", "  ", "a", " a", "  a  b ", "\n", "\n\n x", "x\n", "▁", "a▁▁b", "<s>", "</s> <unk> <0x0A>", "\t\x00\x7f", "ñ 𝄞 　 é", "東京都に住む", "a" * 3000,
    "word " * 400, "%%% in*** &&&", "\r\n mixed space line", "ﬁ ① Ａ ｶﾞ",
]


@pytest.fixture(scope="module")
def own():
    return pieces.Model.read(pieces.model_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def random_texts(count):
    pick = random.Random(5)
    alphabet = ["a", "th", "e", " ", "  ", "\n", "▁", "é", "ß", "の", "𝄞", "tion", "ing", "0", "7", ".", ",", "<s>", "Z", "\t", "́"]
    return ["".join(pick.choices(alphabet, k=pick.randrange(60))) for _ in range(count)]


def test_ids_and_decoding_equal_the_library(own, library):
    for text in ODD + random_texts(1500):
        ids = own.encode(text)[0].tolist()
        assert ids == library.encode(text), text
        assert own.decode([1, *ids, 2]) == library.decode([1, *ids, 2]), text


def test_any_ids_decode_like_the_library(own, library):
    pick = random.Random(6)
    for _ in range(1500):
        ids = [pick.choice([pick.randrange(32000), pick.randrange(3, 259), 28705, 1, 2]) for _ in range(pick.randrange(8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_spans_tile_the_source(own):
    for text in ODD + random_texts(300):
        raw = text.encode()
        ids, starts, ends = own.encode(text)
        assert [*starts[1:], len(raw)] == list(ends) if len(ids) else raw == b""
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            surface = own.surfaces[ids[i]]
            got = raw[a:b].replace(pieces.MARK.encode(), b" ")
            assert got == (surface[1:] if i == 0 else surface)


def test_compiled_map_takes_the_longest_prefix_and_keeps_positions():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    from sentencepiece import sentencepiece_model_pb2 as proto

    held = proto.ModelProto()
    held.ParseFromString(normalizer.serialized_model_proto())
    model = pieces.Model(["x"], [0.0], [1], bytes(held.normalizer_spec.precompiled_charsmap), held.normalizer_spec.add_dummy_prefix, held.normalizer_spec.remove_extra_whitespaces)
    for text in ["ﬁ ① Ａ ｶﾞ", "  two   spaces ", "é ä", " x　", "plain", "", "   ", "㍿ ½ Å"]:
        chars, starts, ends = model.normalise(text)
        assert "".join(chars) == normalizer.normalize(text)
        raw = text.encode()
        assert all(0 <= a <= b <= len(raw) for a, b in zip(starts, ends, strict=True)) and starts == sorted(starts)


def test_rows(spark, library):
    rows = [(1, "Hello  world\n", 7), (2, None, 8), (3, "", 9), (3, "", 9), (None, "ñ" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path = pieces.model_path()
    got = pieces.decode(pieces.encode(docs, path), path).collect()
    assert [r.ids for r in got] == [library.encode(t or "", add_bos=True, add_eos=True) for _, t, _ in rows]
    assert [r.decoded for r in got] == [t or "" for _, t, _ in rows]
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in got)
    assert pieces.encode(docs.filter("doc_id = 99"), path).collect() == []


def test_query_equals_the_library(spark, library, tmp_path):
    import hashlib

    import numpy as np

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in pieces.op1_pieces(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_bos=True, add_eos=True)
        row = got[doc.doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
