"""The geocode store: newest answers win, before and after folding, and lookups leave the table where it lies."""

import random

from reportmill.schemas import GEOCODE
from reportmill.sources.geocode_store import GeocodeStore


def answers(spark, *rows):
    return spark.createDataFrame([(k, v, v, n) for k, v, n in rows], GEOCODE)


def keys(spark, *names):
    return spark.createDataFrame([(k, i) for i, k in enumerate(names)], "key string, n int")


def test_newest_answer_wins_before_and_after_folding(spark, tmp_path):
    rnd, want = random.Random(2), {}
    store = GeocodeStore(spark, str(tmp_path / "geo"), 4)
    assert store.lookup(keys(spark, "a")).collect()[0]["known"] is False and store.current().collect() == [] and store.fold() == 0
    for number in range(6):
        batch = {f"goa|place {rnd.randint(0, 30)}": rnd.choice([None, float(rnd.randint(0, 9))]) for _ in range(12)}
        store.add(answers(spark, *[(k, v, None if v is None else k) for k, v in batch.items()]))
        want |= batch
        if number in (1, 2, 4):
            store.fold()
        again = GeocodeStore(spark, str(tmp_path / "geo"), 4)
        assert {r.key: r.lat for r in again.current().collect()} == want
        got = again.lookup(keys(spark, *[f"goa|place {i}" for i in range(40)], None)).collect()
        assert len(got) == 41 and {r.key: r.lat for r in got if r.known} == want
        assert {r.key for r in again.unanswered(keys(spark, *[r.key for r in got if r.key], "x", "x")).collect()} == {r.key for r in got if not r.known and r.key} | {"x"}
    # Within one batch a hit wins over a miss.
    store.add(answers(spark, ("k", None, None), ("k", 3.0, "b"), ("k", 2.0, "a")))
    assert [(r.lat, r.display_name) for r in store.lookup(keys(spark, "k")).collect()] == [(2.0, "a")]


def test_a_lookup_does_not_shuffle_the_table(spark, tmp_path):
    store = GeocodeStore(spark, str(tmp_path / "geo"), 4)
    store.add(answers(spark, *[(f"k{i}", float(i), "x") for i in range(200)]))
    store.fold()
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        _, base = store._base()
        asked = keys(spark, *[f"k{i}" for i in range(0, 400, 3)])
        plan = asked.join(base, "key", "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert store.lookup(asked).filter("known").count() == 67
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
