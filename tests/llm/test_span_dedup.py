"""Suffix sorting and byte-span dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from reportmill.llm import suffixes
from reportmill.llm.span_dedup import op2_span_dedup, span_dedup


def brute(docs, length):
    """docs: (id or None, text or None) → (n_bytes, n_removed, n_spans, kept) of each."""
    first = {}
    raw = [((2**63 - 1 if i is None else i), (t or "").encode()) for i, t in docs]
    for i, data in raw:
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, data in raw:
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(data), sum(gone), spans, kept))
    return out


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", bytes(range(256))])
def test_suffix_sort(alphabet):
    pick = random.Random(len(alphabet))
    data = bytes(pick.choices(alphabet, k=3000))
    data = np.frombuffer(data + data[:700] + b"a" * 300, np.uint8)
    starts = np.arange(len(data))
    lengths = np.minimum(np.array([pick.choice([1, 5, 50, 500, 4000]) for _ in starts]), len(data) - starts)
    order, common = suffixes.suffix_sort(data, starts, lengths)
    want, want_common = suffixes._plain_sort(data, starts, lengths)
    texts = [data[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
    assert [texts[i] for i in order] == [texts[i] for i in want] and common.tolist() == want_common.tolist()


def test_a_false_extension_goes_to_the_plain_sort(monkeypatch):
    monkeypatch.setattr(suffixes.Hashed, "of", lambda self, starts, lengths: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"bananas and bananas or bananes", np.uint8)
    starts = np.arange(len(data))
    order, common = suffixes.suffix_sort(data, starts, len(data) - starts)
    assert order.tolist() == sorted(starts.tolist(), key=lambda s: data[s:].tobytes()) and common.max() == 8


def random_docs(seed, count, words):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choices("abcdeé", k=pick.randrange(1, 6))) for _ in range(words)]
    passages = [" ".join(pick.choices(vocabulary, k=30)) for _ in range(4)]
    docs = []
    for i in range(count):
        parts = [pick.choice(passages) if pick.random() < 0.3 else " ".join(pick.choices(vocabulary, k=pick.randrange(1, 25))) for _ in range(pick.randrange(5))]
        text = " ".join(parts)
        if docs and pick.random() < 0.2:
            base = pick.choice(docs)[1] or ""
            cut = pick.randrange(len(base) + 1)
            text = base[:cut] + pick.choice(["", "X"]) + base[cut:]
        docs.append((i, text))
    pick.shuffle(docs)
    return docs


@pytest.mark.parametrize(("length", "gram", "words", "chunk"), [(50, 24, 40, 4000), (50, 24, 6, 1 << 20), (10, 4, 15, 2000), (8, 8, 10, 900)])
def test_spans_equal_brute_force(spark, length, gram, words, chunk):
    docs = random_docs(words, 120, words)
    docs += [(500, None), (501, ""), (502, "a" * 400), (503, "b" + "a" * 300), (504, "ab" * 200), (505, "ba" * 150), (None, docs[3][1]), (None, "new " * 30), docs[5], docs[5], (506, "x" * length), (507, "x" * (length - 1)), (508, "y" + "x" * length)]
    frame = spark.createDataFrame([(i, t, n, "clash") for n, (i, t) in enumerate(docs)], "doc_id long, text string, n long, kept string")
    got = sorted(span_dedup(frame, length, gram, chunk).collect(), key=lambda r: r.n)
    assert len(got) == len(docs)
    for r, want in zip(got, brute(docs, length), strict=True):
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) == want, docs[r.n]


@pytest.mark.parametrize("share", [1, 300, 1 << 18])
def test_a_name_in_many_different_runs(spark, share):
    """One phrase in 1,000 different surroundings, some of which repeat: its windows are dealt over many buckets."""
    pick = random.Random(8)
    word = lambda: "".join(pick.choices("abcdefgh", k=6))
    phrase, after = "the quite common phrase of thirty", [word() + word() + word() for _ in range(30)]
    docs = [(i, f"{word()} {word()} {phrase} {pick.choice(after)} {word()}") for i in range(1000)]
    docs += [(2000 + i, docs[i * 7][1][5:]) for i in range(40)] + [(3000, (phrase + " ") * 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in span_dedup(frame, 50, 24, 4000, share).collect()}
    for (i, _), want in zip(docs, brute(docs, 50), strict=True):
        r = got[i]
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) == want, i


def test_bytes_are_verified_in_steps(monkeypatch):
    monkeypatch.setattr(suffixes, "_CHECKED", 64)
    data = np.frombuffer(b"abcabcabd" * 90, np.uint8)
    starts = np.arange(len(data))
    order, common = suffixes.suffix_sort(data, starts, len(data) - starts)
    want, want_common = suffixes._plain_sort(data, starts, len(data) - starts)
    assert order.tolist() == want.tolist() and common.tolist() == want_common.tolist()


def test_empty_table(spark):
    assert span_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op2_span_dedup(spark, folder).collect()}
    assert len(got) == len(docs)
    for (i, _), (n, removed, spans, kept) in zip(docs, brute(docs, 50), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
