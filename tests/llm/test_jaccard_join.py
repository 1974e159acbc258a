"""Shingles, occurrence search and near-duplicate components against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from reportmill.llm import jaccard_join
from reportmill.llm.jaccard_join import near_duplicates, one_of_each, op3_jaccard_join
from reportmill.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    """[(name, text)] → [(size, least name reachable)]"""
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), name), name)
    return [(len(s), least[root(i)]) for i, s in enumerate(sets)]


def random_docs(seed, count):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = pick.choices(vocabulary, k=40)
    docs = []
    for i in range(count):
        words = pick.choices(vocabulary, k=pick.randrange(1, 60)) + (passage if pick.random() < 0.3 else [])
        if docs and pick.random() < 0.7:
            words = list(docs[pick.randrange(max(1, len(docs) // 8))][1])
            for _ in range(pick.choice([0, 1, 1, 2, 3, 5])):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
        docs.append((i, words))
    docs = [(i, pick.choice([" ", "\n", "  "]).join(w if pick.random() < 0.9 else w.upper() for w in words)) for i, words in docs]
    pick.shuffle(docs)
    return docs


def test_shingle_sets():
    texts = ["", "a", "A b", "a b c d e", "a b c d e a b c d e a", " \n", "é É x y z w", "a b c d", "x" * 1000]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    hashes, sizes = shingle_sets(offsets, np.frombuffer(b"".join(raw), np.uint8))
    assert sizes.tolist() == [len(shingles(t)) for t in texts] and len(set(hashes.tolist())) == len(set().union(*map(shingles, texts)))


@pytest.mark.parametrize(("cell_nodes", "seed"), [(2000, 1), (7, 2), (2, 3)])
def test_components_equal_brute_force(spark, cell_nodes, seed):
    docs = random_docs(seed, 160) + [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE two"), (905, "one two three")]
    docs += [docs[0], docs[0], (906, "w " * 3000), (907, "w " * 2990)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, component string").repartition(5)
    want = {name: w for (name, _), w in zip(docs, brute(docs), strict=True)}
    got = near_duplicates(frame, cell_nodes=cell_nodes).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_shingles, r.component) == want[r.doc_id], r
    kept = one_of_each(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {n for n, (_, c) in want.items() if n == c}


def test_chains_over_split_cells(spark):
    """Members that are linked to the least one only over others, in parts of two."""
    words = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join(words[k : k + 40])) for k in range(0, 20, 2)] + [(100 + k, " ".join(words[k : k + 40]) + f" x{k}") for k in range(0, 20, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {name: w[1] for (name, _), w in zip(docs, brute(docs), strict=True)}
    for size in (2, 3, 2000):
        assert {r.doc_id: r.component for r in near_duplicates(frame, cell_nodes=size).collect()} == want


def test_rows_without_id_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (None, "other words of its own"), (None, None)]
    found = op_rows(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(found, key=str) == sorted([(None, 2, 5), (None, 2, 5), (5, 2, 5), (None, 1, None), (None, 0, None)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def op_rows(found):
    return [(r.doc_id, r.n_shingles, r.component if r.component < 1 << 62 else None) for r in found.collect()]


def test_occurrence_search_counts_all_lists():
    pick = random.Random(8)
    for _ in range(200):
        sets = [np.array(sorted(pick.sample(range(40), pick.randrange(1, 30))), np.uint64) for _ in range(12)]
        query = sets[0]
        lists = [np.array([m for m, s in enumerate(sets) if t in s]) for t in query]
        skip = np.array([True, *[pick.random() < 0.2 for _ in sets[1:]]])
        for threshold in (1, len(query) // 2 + 1, len(query)):
            got = jaccard_join.occurrence_search(lists, threshold, sets, query, skip)
            assert sorted(got.tolist()) == [m for m, s in enumerate(sets) if not skip[m] and len(np.intersect1d(s, query)) >= threshold]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = {name: w for (name, _), w in zip(docs, brute(docs), strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op3_jaccard_join(spark, folder).collect()} == want


def test_texts_are_hashed_in_pieces():
    """A batch's sets are those of its texts one by one, and hashing them takes a few times the batch's bytes."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 900))) for _ in range(2400)] + [None, "", " ".join(rng.choices(words, k=90_000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["name", "text"])
    tracemalloc.start()
    made = list(jaccard_join._batches([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 9 * batch.nbytes
    assert [n for names, _, _ in made for n in names.tolist()] == list(range(len(texts)))
    sets = [x.tolist() for _, hashes, sizes in made for x in np.split(hashes, np.cumsum(sizes)[:-1])]
    for text, found in list(zip(texts, sets, strict=True))[-40:]:
        raw = (text or "").encode()
        assert found == shingle_sets(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))[0].tolist()
