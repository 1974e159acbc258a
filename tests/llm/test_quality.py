"""Quality rules: counts against plain Python, the estimate against numpy, verdicts of planted texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def counted(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_counts(spark):
    pick = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "a " * 9, "x y " * 30, "é\xa0b c\n\n \nc\nc\n c", "#*$%&|<> #", "w " * 5000]
    texts += [" ".join(pick.choices(["a", "b\n", "cc", "d"], k=pick.randrange(60))) for _ in range(100)]
    texts += ["\n".join(" ".join(pick.choices("abcdefghijklmnop", k=9)) for _ in range(3)) * 2 for _ in range(20)]
    docs = spark.createDataFrame([(i, t, None, "s", "clash") for i, t in enumerate(texts)], SCHEMA)
    got = quality.statistics(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counted(texts[r.doc_id]), texts[r.doc_id]


def test_estimate_equals_concentration_steps_in_numpy(spark):
    rng = np.random.default_rng(2)
    size, names = 400, quality.FEATURES
    x = rng.normal(size=(size, 5)) @ np.diag([1, 0.3, 0.5, 0.2, 0.4]) + [5, 1.6, 0, 0, 0]
    x[:60] += [3, 1, 4, 4, 4]
    quality.scratch_dir(spark)
    rows = spark.createDataFrame([("en", None, *map(float, r)) for r in x], f"lang string, source string, {', '.join(f'{n} double' for n in names)}")
    got = quality.estimates(rows).collect()
    assert len(got) == 1 and got[0].source is None
    floors = np.diag([quality.FLOORS[n] ** 2 for n in names])
    middle, scale = np.median(x, 0), np.median(np.abs(x - np.median(x, 0)), 0) * 1.4826
    best = None
    for mean, cov in ((middle, np.diag(scale**2)), (x.mean(0), np.cov(x.T, bias=True))):
        for _ in range(quality.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floors), x - mean)
            near = x[d <= np.sort(d)[int(np.ceil(quality.SHARE * size)) - 1]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True)
        key = np.linalg.det(cov + floors)
        best = min(best or (key, mean, cov), (key, mean, cov), key=lambda b: b[0])
    inverse = np.linalg.inv(best[2] * quality._correction(quality.SHARE, 5) + floors)
    for i, a in enumerate(names):
        assert getattr(got[0], f"m_{a}") == pytest.approx(best[1][i], abs=0.02)
        for j in range(i, 5):
            assert getattr(got[0], f"p_{a}_{names[j]}") == pytest.approx(inverse[i, j], abs=0.03 * np.abs(inverse).max())


def test_verdicts(spark):
    pick = random.Random(4)
    words = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randrange(2, 9))) for _ in range(300)]
    clean = [(i, " ".join(pick.choices(words, k=pick.randrange(30, 600))), pick.choice(["en", None]), pick.choice(["s", "t"]), "x") for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}%%%" for w in pick.choices(words, k=100)), "en", "s", "x") for i in range(10)]
    other = [(2000, None, None, None, None), (2001, "", "en", "s", ""), clean[0]]
    got = quality.judged(spark.createDataFrame(clean + junk + other, SCHEMA)).collect()
    assert len(got) == 313
    verdict = {r.doc_id: r.kept for r in got}
    assert all(verdict[i] for i in range(300)) and not any(verdict[r[0]] for r in junk) and not verdict[2000] and not verdict[2001]
    kept = quality.keep_good(spark.createDataFrame(clean + junk + other, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, *range(300)]) and kept.columns == ["doc_id", "text", "lang", "source", "kept"]
    assert quality.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clean_labelled_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.op9_quality(spark, folder).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"), F.count("*"))
    shares = {r.quality: r.share for r in got.collect()}
    assert shares[1] > 0.99 and shares[0] < 0.5
