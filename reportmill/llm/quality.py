"""Quality rules: base limits and robust multivariate outliers, in DataFrame functions only.

Every text gives a vector of transformed statistics. For each language and source, minimum-covariance-determinant estimates are
found by concentration steps: start from medians and from plain moments, keep the ``SHARE`` of documents nearest to the estimate,
take their mean and covariance, repeat, and keep the start with the smaller determinant. The covariance is corrected for the
share left out, and each group is drawn towards the pooled estimate with the weight of ``PRIOR`` documents, so that small groups
need no special case. A document beyond ``CUTOFF`` squared Mahalanobis distance is rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions.patterns import let
from reportmill.llm.batches import order_id
from reportmill.session import scratch_dir

SHARE = 0.75
STEPS = 4
PRIOR = 100
CUTOFF = 30.9  # chi-square with five degrees of freedom: one clean document in 100,000
WINDOW = 8
# White space between words, and symbol characters.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
# Each feature's least standard deviation: a share that is zero in nearly every document must not turn a single symbol into an outlier.
FLOORS = {"x_length": 0.8, "x_word": 0.15, "x_symbols": 0.35, "x_lines": 1.3, "x_repeats": 1.3}
FEATURES = tuple(FLOORS)
_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
_GROUP = ("lang", "source", "start")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _covered(hashes: Column) -> Column:
    """Places within WINDOW places after the start of a window that occurs twice."""

    def count(ordered: Column) -> Column:
        twice = F.filter(
            ordered, lambda e, j: F.coalesce(F.get(ordered, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(ordered, j + 1)["h"] == e["h"], F.lit(False))
        )
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), spans)

    def spans(starts: Column) -> Column:
        widths = F.transform(starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(widths, F.lit(0), lambda a, b: a + b)

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), count)


def repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more."""

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashed) - WINDOW), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]))

    def judged(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), judged)))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed) of each row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeat_words(words).cast("long").alias("n_repeat_words")
        )

    def repeated(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    found = docs.select(
        "doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), let(words_of(F.col("text")), counts).alias("w"), let(lines, repeated).alias("l"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
    ).select("doc_id", "lang", "source", "text_hash", "w.*", "l.*", "n_symbols")
    return found.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics: logarithms of length, of word length, and of percentages."""

    def percent(part: str, whole: str) -> Column:
        return F.log1p(100.0 * F.col(part) / (F.col(whole) + 1))

    return stats.withColumns({
        "x_length": F.log1p(F.col("n_words").cast("double")), "x_word": F.log((F.col("word_chars") + 1.0) / (F.col("n_words") + 1.0)),
        "x_symbols": percent("n_symbols", "word_chars"), "x_lines": percent("n_dup_lines", "n_lines"), "x_repeats": percent("n_repeat_words", "n_words"),
    })


def _entry(prefix: str, a: str, b: str) -> str:
    return f"{prefix}_{a}_{b}" if (a, b) in _PAIRS else f"{prefix}_{b}_{a}"


def _inverted(groups: DataFrame) -> DataFrame:
    """Adds p_a_b, the inverse of c_a_b with squared floors on its diagonal, and log_det. Sweeps one feature after another."""
    swept = groups.withColumns({f"p_{a}_{b}": F.col(f"c_{a}_{b}") + (FLOORS[a] ** 2 if a == b else 0.0) for a, b in _PAIRS}).withColumn("log_det", F.lit(0.0))
    for k in FEATURES:
        pivot, made = F.col(f"p_{k}_{k}"), {"log_det": F.col("log_det") + F.log(F.abs(F.col(f"p_{k}_{k}")))}
        for a, b in _PAIRS:
            ak, kb = F.col(_entry("p", a, k)), F.col(_entry("p", k, b))
            made[f"p_{a}_{b}"] = -1.0 / pivot if a == k == b else (kb if a == k else ak) / pivot if k in (a, b) else F.col(f"p_{a}_{b}") - ak * kb / pivot
        swept = swept.withColumns(made)
    return swept.withColumns({f"p_{a}_{b}": -F.col(f"p_{a}_{b}") for a, b in _PAIRS})


def _distance() -> Column:
    """Squared Mahalanobis distance of a row to the m_ and p_ columns beside it."""
    total = F.lit(0.0)
    for a, b in _PAIRS:
        total += (1.0 if a == b else 2.0) * F.col(f"p_{a}_{b}") * (F.col(a) - F.col(f"m_{a}")) * (F.col(b) - F.col(f"m_{b}"))
    return total


def _moments(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in FEATURES], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in _PAIRS]
    )


def _beside(rows: DataFrame, groups: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with their group's columns; null keys are keys."""
    named = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = [rows[k].eqNullSafe(named[f"_g_{k}"]) for k in keys]
    return rows.join(named, same).drop(*[f"_g_{k}" for k in keys])


def _chi_square(value: float, degrees: int) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    s, x = degrees / 2, value / 2
    term = total = 1 / s
    for i in range(1, 500):
        term *= x / (s + i)
        total += term
    return total * math.exp(-x + s * math.log(x) - math.lgamma(s))


def _correction(share: float, degrees: int) -> float:
    """What a covariance of the nearest ``share`` is multiplied by to fit a normal distribution."""
    low, high = 0.0, 100.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, degrees) < share else (low, middle)
    return share / _chi_square(low, degrees + 2)


def estimates(vectors_: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(lang, source, m_*, p_*): the estimate of each group, one row each."""
    rows = vectors_.select("lang", "source", *FEATURES)
    median = [F.percentile_approx(a, 0.5, 1000).alias(f"m_{a}") for a in FEATURES]
    middles = rows.groupBy("lang", "source").agg(*median).checkpoint()
    spread = _beside(rows, middles, ("lang", "source")).groupBy("lang", "source").agg(
        *[F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5, 1000).alias(f"s_{a}") for a in FEATURES], *[F.first(f"m_{a}").alias(f"m_{a}") for a in FEATURES]
    )
    diagonal = {f"c_{a}_{b}": (1.4826 * F.col(f"s_{a}")) ** 2 if a == b else F.lit(0.0) for a, b in _PAIRS}
    starts = [spread.withColumns(diagonal).withColumn("start", F.lit("median")), _moments(rows, ("lang", "source")).withColumn("start", F.lit("mean"))]
    columns = [*_GROUP, *[f"m_{a}" for a in FEATURES], *[f"c_{a}_{b}" for a, b in _PAIRS]]
    current = _inverted(starts[0].select(*columns).unionByName(starts[1].select(*columns))).checkpoint()
    both = rows.withColumn("start", F.explode(F.array(F.lit("median"), F.lit("mean"))))
    for _ in range(steps):
        near = _beside(both, current, _GROUP).select(*_GROUP, *FEATURES, _distance().alias("d"))
        limits = near.groupBy(*_GROUP).agg(F.percentile_approx("d", share, 1000).alias("limit"))
        current = _inverted(_moments(_beside(near, limits, _GROUP).filter("d <= limit"), _GROUP)).checkpoint()
    best = current.groupBy("lang", "source").agg(F.min_by(F.struct("n", *columns[3:]), F.struct("log_det", "start")).alias("best")).select("lang", "source", "best.*")
    scaled = best.withColumns({f"c_{a}_{b}": _correction(share, len(FEATURES)) * F.col(f"c_{a}_{b}") for a, b in _PAIRS}).checkpoint()
    pooled = scaled.agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"all_{c}") for c in columns[3:]])
    drawn = scaled.crossJoin(F.broadcast(pooled))  # one row
    drawn = drawn.withColumns({c: (F.col("n") * F.col(c) + PRIOR * F.col(f"all_{c}")) / (F.col("n") + PRIOR) for c in columns[3:]})
    return _inverted(drawn).select("lang", "source", *[f"m_{a}" for a in FEATURES], *[f"p_{a}_{b}" for a, b in _PAIRS])


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source, ...): its counts, base_failed, and kept.

    A null or empty text has no words and fails. A null language or source is a group of its own. Repeated rows and ties give
    repeated rows. Extra columns are not read.
    """
    scratch_dir(docs.sparkSession)
    made = vectors(statistics(docs)).checkpoint()
    near = _beside(made, estimates(made), ("lang", "source"))
    return near.withColumn("kept", ~F.col("base_failed") & (_distance() <= cutoff)).drop(*[f"m_{a}" for a in FEATURES], *[f"p_{a}_{b}" for a, b in _PAIRS])


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    bad = judged(docs, cutoff).filter("not kept").select(order_id("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_text")).distinct()
    return docs.join(bad, (order_id("doc_id") == F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_text")), "left_anti")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality": (op9_quality, None)}
