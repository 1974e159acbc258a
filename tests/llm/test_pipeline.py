"""The pipeline, stage by stage against brute force on a small table."""

import random

import pytest
import sentencepiece

import corpus_pipeline
from reportmill.llm import mixing, pieces
from tests.llm.test_jaccard_join import brute as brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pick = random.Random(9)
    words = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(240):
        lines = [" ".join(pick.choices(words, k=pick.randrange(8, 15))) for _ in range(pick.randrange(4, 9))] + (["A shared line, in many texts."] if i % 3 == 0 else [])
        text = "\n".join(lines)
        if i % 10 == 9:
            text = rows[-1][1].replace(" ", "  ", 1)
        if i % 20 == 5:
            text = "%%% ".join(pick.choices(words, k=60))
        if i % 20 == 7:
            text = " ".join(["idiot", "clown", *pick.choices(words, k=60)])
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "src0", 0), rows[3]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 20 != 5), int(i % 20 == 7)) for i in range(0, 240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if number < 4:
            assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        made.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen.append(docs.collect())
    start, kept, cut, single, mixed, coded = seen
    ids = {r.doc_id for r in kept}
    assert {r.doc_id for r in start} - ids == {500, 501, *range(5, 240, 20)}
    assert sorted(r.doc_id for r in kept).count(3) == 2

    first = {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        for line in set(r.text.split("\n")):
            first.setdefault(line.strip().lower(), r.doc_id)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(x.strip()) < 10 or first[x.strip().lower()] == r.doc_id) for r in kept}
    emptied = {i for i, text in want.items() if not text.strip()}
    assert {r.doc_id: r.text for r in cut} == {i: text for i, text in want.items() if i not in emptied} and all(r.n_chars == len(r.text) for r in cut)

    pairs = [(r.doc_id, r.text) for r in cut]
    components = {name: c for (name, _), (_, c) in zip(pairs, brute_components(pairs), strict=True)}
    assert {r.doc_id for r in single} == {n for n, c in components.items() if n == c}

    clean = {r.doc_id for r in single if "idiot" not in r.text and r.text}
    assert clean <= {r.doc_id for r in mixed} and {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    toxic = [r for r in single if "idiot" in r.text]
    assert sum("idiot" in r.text for r in mixed) < len(toxic)

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = {r.doc_id: r.text for r in mixed}
    assert len(coded) == len(mixed)
    for r in coded:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_mixing_meets_shares_of_a_corpus_with_other_ones(spark, tmp_path):
    pick = random.Random(6)
    shared = [f"w{i}" for i in range(200)]
    domains = ["good"] * 360 + ["poor"] * 42 + ["toxic"] * 198
    rows = [(i, " ".join(pick.choices(shared, k=70) + pick.choices([f"{d}{j}" for j in range(20)], k=30)), "en", "s", 0) for i, d in enumerate(domains)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(d != "poor"), int(d == "toxic")) for i, d in enumerate(domains)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    made = [r.doc_id for r in corpus_pipeline.mix_domains(spark, docs, str(tmp_path)).collect()]
    assert {i for i, d in enumerate(domains) if d == "good"} <= set(made)
    for domain, share in mixing.SHARES.items():
        assert sum(domains[i] == domain for i in made) / len(made) == pytest.approx(share, abs=0.03)


def test_emptied_documents_and_repeated_rows(spark):
    text, other = "a line of more than ten characters\nand one more of them", "a text of its own that nobody else has"
    rows = [(1, text), (2, text), (3, f"{text}\n"), (4, other), (4, other), (None, "words without an id, " * 3), (None, "words without an id, " * 3), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    cut = corpus_pipeline.cut_repeated_lines(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in cut) == sorted([(0, rows[5][1])] * 2 + [(1, text), (4, other), (4, other)])
    single = corpus_pipeline.keep_one_of_each(spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in single) == [0, 0, 1, 4, 4, 5, 6]  # repeated rows stay


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 150
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "source mixing", "token encoding"]
