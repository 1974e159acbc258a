"""Source mixing: held-out accuracy, totals that meet the targets, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import mixing

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_totals(spark):
    mixing.scratch_dir(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    scores = mixing.scored(docs, train)
    assert scores.count() == docs.count()
    top = F.greatest(*[f"p_{d}" for d in mixing.DOMAINS])
    guess = F.when(F.col("p_good") == top, "good").when(F.col("p_poor") == top, "poor").otherwise("toxic")
    judged = scores.join(held, "doc_id").select((guess == mixing._domain()).cast("int").alias("right"), mixing._domain().alias("domain"))
    right = {r.domain: r.share for r in judged.groupBy("domain").agg(F.avg("right").alias("share")).collect()}
    assert judged.agg(F.avg("right")).first()[0] > 0.85 and right["good"] > 0.9 and right["toxic"] > 0.5, right
    words = scores.agg(F.sum("n_words")).first()[0]
    targets = {d: s * words for d, s in mixing.SHARES.items()}
    rated = scores.withColumn("rate", mixing.rates(scores, targets))
    got = rated.agg(*[F.sum(F.col("rate") * F.col("n_words") * F.col(f"p_{d}")) for d in mixing.DOMAINS], F.min("rate")).first()
    assert got[3] >= 0
    for i, d in enumerate(mixing.DOMAINS):
        assert got[i] == pytest.approx(targets[d], rel=1e-3)


def test_rates_equal_dense_projected_gradient(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([2, 1, 0.3], 200)
    n = rng.integers(0, 500, 200)
    rows = spark.createDataFrame([(int(w), *map(float, q)) for w, q in zip(n, p, strict=True)], "n_words long, p_good double, p_poor double, p_toxic double")
    for share in ([0.5, 0.3, 0.2], [0.97, 0.0, 0.03], [0.1, 0.1, 0.8]):
        target = np.array(share) * n.sum()
        second, rate = (p * n[:, None]).T @ p, np.ones(200)
        weight = np.linalg.inv(second + mixing.RIDGE * second.max() * np.eye(3))
        for _ in range(mixing.STEPS):
            over = (rate * n) @ p - target
            if np.abs(over).max() <= mixing.CLOSE * target.sum():
                break
            rate = np.maximum(0, rate - p @ weight @ over)
        got = rows.select(mixing.rates(rows, dict(zip(mixing.DOMAINS, target.tolist(), strict=True))).alias("r")).collect()
        assert np.allclose([r.r for r in got], rate, atol=1e-5)


def rows_of(spark, n, p):
    return spark.createDataFrame([(int(w), *map(float, q)) for w, q in zip(n, p, strict=True)], "n_words long, p_good double, p_poor double, p_toxic double")


def test_totals_meet_targets_to_the_word(spark, caplog):
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.5, 0.3, 0.2], 200), rng.integers(1, 500, 200)
    target = np.array([0.6, 0.25, 0.15]) * n.sum()
    rows = rows_of(spark, n, p)
    got = np.array([r.r for r in rows.select(mixing.rates(rows, dict(zip(mixing.DOMAINS, target.tolist(), strict=True))).alias("r")).collect()])
    assert np.abs((got * n) @ p - target).max() < 1e-6 * n.sum() and not caplog.records


def test_targets_out_of_reach_are_told(spark, caplog):
    p, n = np.full((20, 3), 1 / 3), np.full(20, 100)
    rows = rows_of(spark, n, p)
    rows.select(mixing.rates(rows, {"good": 1000.0, "poor": 500.0, "toxic": 500.0}).alias("r")).collect()
    assert len(caplog.records) == 1 and "over their targets" in caplog.text


def test_least_rates_are_part_of_the_fit(spark):
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet([0.5, 0.3, 0.2], 200), rng.integers(1, 500, 200)
    low = (p[:, 0] >= 0.5) * 1.0
    target = (np.where(low > 0, 1.3, 0.6) * n) @ p
    rows = rows_of(spark, n, p)
    column = mixing.rates(rows, dict(zip(mixing.DOMAINS, target.tolist(), strict=True)), least=F.when(F.col("p_good") >= 0.5, 1.0).otherwise(0.0))
    got = np.array([r.r for r in rows.select(column.alias("r")).collect()])
    assert (got >= low).all() and np.abs((got * n) @ p - target).max() < 1e-3 * n.sum()


def test_odd_input(spark):
    rows = [(1, "fine words here", "s", 1), (1, "fine words here", "s", 1), (2, None, None, 2), (3, "", "s", 3), (None, "word " * 3000, "t", 4), (5, "idiot clown", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (None, 1, 0), (2, None, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, labels).collect()
    assert len(got) == 5 and all(r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].n_words == 0 and by_id[None].n_words == 3000
    assert len({(round(r.p_good, 9), round(r.p_toxic, 9)) for r in mixing.mixed(docs, labels.limit(0)).collect()}) == 1
    assert mixing.mixed(docs.limit(0), labels).collect() == []
    twice = mixing.repeat_by_rate(docs, mixing.mixed(docs, labels).withColumn("rate", F.lit(2.0)))
    assert twice.columns == docs.columns and twice.count() == 12
    assert mixing.repeat_by_rate(docs, mixing.mixed(docs, labels).withColumn("rate", F.lit(0.0))).count() == 0


def test_plans_of_steps_stay_short(spark, monkeypatch):
    """Each step's plan held the rates of all steps before, which took the driver's memory; at most CUT steps are in one plan now."""
    rows = spark.createDataFrame([(i, 20 + i % 7, 0.9, 0.06 + i % 5 / 100) for i in range(60)], "doc_id long, n_words long, p_good double, p_poor double").withColumn("p_toxic", 1 - F.col("p_good") - F.col("p_poor"))
    seen, plain = [], type(rows).agg
    monkeypatch.setattr(type(rows), "agg", lambda self, *c: seen.append(max(str(x).lower().count("greatest(") for x in c)) or plain(self, *c))
    mixing.rates(rows, {"good": 900.0, "poor": 700.0, "toxic": 100.0}, least=F.when(F.col("p_good") >= 0.5, 1.0).otherwise(0.0))
    assert len(seen) > 3 * mixing.CUT and 1 < max(seen) <= mixing.CUT
