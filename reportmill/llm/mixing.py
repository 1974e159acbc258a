"""Mixing sources to target weights, in DataFrame functions only.

1. A naive Bayes classifier over distinct words and their other characters is fitted on a bounded sample of labelled documents (``TRAIN_ROWS``).
   Every document gets a posterior for each domain; nothing is assigned hard.
2. Document rates are the nonnegative least-squares fit of expected domain totals (rate x words x posterior) to the targets. The
   projected gradient runs from rate 1 in the metric of words, so that equal posteriors get equal rates; residuals are weighted by
   the inverse of the domains' second moments, raised by RIDGE so that domains which the posteriors hardly tell apart do not
   push rates to extremes. With this weight 1 is a safe step. A step needs one sum for each domain; the rates of
   up to CUT steps are one column expression over rates that are stored, so plans stay short.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions.patterns import let
from reportmill.llm.batches import order_id
from reportmill.llm.quality import words_of
from reportmill.session import scratch_dir

_LOG = logging.getLogger(__name__)

DOMAINS = ("good", "poor", "toxic")
SHARES = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
TRAIN_ROWS = 10_000
FEATURES = 50_000
SMOOTHING = 1.0
SIGMAS = 5.0
STEPS = 60
# Steps after which rates are stored; a plan over more of them grows with every step, on the driver too.
CUT = 10
RIDGE = 0.02
CLOSE = 1e-7
STILL = 1e-12
# Letters of the languages at hand; they would only tell languages apart.
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàâäáãçéèêëíîïñóôöõúûùüßÀÂÄÁÃÇÉÈÊËÍÎÏÑÓÔÖÕÚÛÙÜ"


def _domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")


def _word_feature(word: Column) -> Column:
    return F.xxhash64(word)


def _rest_feature(word: Column) -> Column:
    """What is left of a word without its letters; null if nothing is."""
    rest = F.translate(word, _LETTERS, "")
    return F.when(rest != "", F.xxhash64(rest, F.lit(1)))


def labelled_sample(labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, domain) of about ``bound`` labelled documents at most, spread by hash; labels with a null are left out."""
    whole = labels.select("doc_id", "quality", "toxic").dropna()
    share = min(1.0, 0.98 * bound / max(1, whole.count()))
    picked = whole.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return picked.groupBy("doc_id").agg(F.min(_domain()).alias("domain"))


def log_priors(docs: DataFrame, sample: DataFrame) -> list[Column]:
    """Shares of the domains among the labelled documents that ``docs`` holds."""
    named = F.broadcast(sample.withColumnRenamed("doc_id", "_id"))  # TRAIN_ROWS rows at most
    held = docs.select("doc_id").join(named, F.col("doc_id") == F.col("_id")).groupBy("domain").agg(F.count_distinct("_id").alias("n"))
    sizes = {r["domain"]: r["n"] for r in held.collect()}
    whole = sum(sizes.values()) + len(DOMAINS)
    return [F.log(F.lit((sizes.get(d, 0) + 1) / whole)) for d in DOMAINS]


def fit(docs: DataFrame, sample: DataFrame) -> tuple[DataFrame, list[Column]]:
    """((feature, w_<domain>...), log priors): the FEATURES that tell domains apart best, at most.

    A weight says how much more often a domain has a feature than all domains together. Where the difference is no more than chance
    (SIGMAS) it is 0, or the sum over many common words would drown the few that tell.
    """
    named = sample.select(F.col("doc_id").alias("_id"), "domain")
    texts = docs.select("doc_id", "text").join(F.broadcast(named), F.col("doc_id") == F.col("_id"))  # TRAIN_ROWS rows at most
    words = texts.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    parts = words.select("domain", F.explode(F.array_compact(F.array(_word_feature(F.col("word")), _rest_feature(F.col("word"))))).alias("feature"))
    counts = parts.groupBy("feature").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]).checkpoint()
    totals = counts.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DOMAINS]).first()
    seen, total = [F.col(d) for d in DOMAINS], max(1, sum(totals))
    alike = [sum(seen[1:], seen[0]) * (totals[d] / total) for d in DOMAINS]
    apart = [F.abs(s - a) / F.sqrt(a + 1) for s, a in zip(seen, alike, strict=True)]
    logs = [F.when(z > SIGMAS, F.log((s + SMOOTHING) / (a + SMOOTHING))).otherwise(F.lit(0.0)).alias(f"w_{d}") for z, s, a, d in zip(apart, seen, alike, DOMAINS, strict=True)]
    best = F.greatest(*apart)
    weights = counts.filter(best > SIGMAS).orderBy(best.desc(), "feature").limit(FEATURES).select("feature", *logs)
    return weights.checkpoint(), log_priors(docs, sample)


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[Column]) -> DataFrame:
    """(doc_id, source, _id, text_hash, n_words, p_<domain>...), one row for each distinct id and text.

    Evidence is tempered by the square root of length, so that memberships of long texts stay soft.
    """
    keys = ["doc_id", "source", "text_hash", "n_words", "n_distinct"]
    made = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.array_distinct(w).alias("words")))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), made.alias("made"))
    words = rows.select("doc_id", "source", "text_hash", "made.n_words", F.size("made.words").alias("n_distinct"), F.explode_outer("made.words").alias("word"))
    table = weights.select("feature", *[f"w_{d}" for d in DOMAINS])  # FEATURES rows at most
    whole = F.broadcast(table.select(F.col("feature").alias("_f"), *[F.col(f"w_{d}").alias(f"a_{d}") for d in DOMAINS]))
    rest = F.broadcast(table.select(F.col("feature").alias("_r"), *[F.col(f"w_{d}").alias(f"b_{d}") for d in DOMAINS]))
    probed = words.join(whole, _word_feature(F.col("word")) == F.col("_f"), "left").join(rest, _rest_feature(F.col("word")) == F.col("_r"), "left")
    # Repeated rows add up alike in every domain; the number of words found says how often the row is there.
    sums = probed.groupBy(*keys).agg(*[F.sum(F.coalesce(f"a_{d}", F.lit(0.0)) + F.coalesce(f"b_{d}", F.lit(0.0))).alias(f"s_{d}") for d in DOMAINS], F.count("*").alias("found"))
    times = F.greatest(F.lit(1.0), F.col("found") / F.greatest(F.lit(1), F.col("n_distinct")))
    heat = F.sqrt(1 + F.col("n_distinct") / 100)
    logits = {f"l_{d}": prior + F.coalesce(F.col(f"s_{d}") / times, F.lit(0.0)) / heat for d, prior in zip(DOMAINS, priors, strict=True)}
    exps = {f"e_{d}": F.exp(F.col(f"l_{d}") - F.greatest(*logits)) for d in DOMAINS}
    shares = {f"p_{d}": F.col(f"e_{d}") / sum((F.col(e) for e in list(exps)[1:]), F.col(list(exps)[0])) for d in DOMAINS}
    return sums.withColumns(logits).withColumns(exps).withColumns(shares).select(*keys[:4], *shares)


def inverse(matrix: list[list[float]]) -> list[list[float]]:
    """Gauss-Jordan elimination of a small symmetric matrix whose diagonal is raised by RIDGE of its largest entry."""
    n = len(matrix)
    ridge = RIDGE * max(1e-9, *(matrix[i][i] for i in range(n)))
    rows = [[*map(float, matrix[i]), *(float(i == j) for j in range(n))] for i in range(n)]
    for i in range(n):
        rows[i][i] += ridge
    for i in range(n):
        best = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[best] = rows[best], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [r[n:] for r in rows]


def rates(scores: DataFrame, targets: dict[str, float], steps: int = STEPS, least: Column | None = None) -> Column:
    """The rate of each row of ``scores`` (n_words, p_*): a column over them. ``targets`` are words for each domain.

    No rate is below ``least`` (0 to 1; 0 if not given): each step is projected on it. Steps end when all totals are CLOSE, or when
    they move no more; a fit that ends elsewhere logs what it misses.
    """
    scratch_dir(scores.sparkSession)
    share, n = [F.col(f"p_{d}") for d in DOMAINS], F.col("n_words")
    least = F.lit(0.0) if least is None else least
    second = scores.agg(*[F.coalesce(F.sum(n * a * b), F.lit(0.0)).alias(f"m{i}{j}") for i, a in enumerate(share) for j, b in enumerate(share)]).first()
    weight = inverse([list(second[len(DOMAINS) * i : len(DOMAINS) * (i + 1)]) for i in range(len(DOMAINS))])
    rate, whole = F.lit(1.0), max(1.0, sum(targets.values()))
    # ``recent`` is the rate over ``held``, ``rate`` the same over the caller's rows.
    held, recent = scores, rate
    before: list[float] | None = None
    for step in range(steps + 1):
        totals = held.agg(*[F.coalesce(F.sum(recent * n * p), F.lit(0.0)).alias(d) for d, p in zip(DOMAINS, share, strict=True)]).first()
        over = [totals[i] - targets[d] for i, d in enumerate(DOMAINS)]
        if max(map(abs, over)) <= CLOSE * whole:
            break
        if step == steps or (before and max(abs(a - b) for a, b in zip(over, before, strict=True)) <= STILL * whole):
            _LOG.warning("mixing ends after %d steps with %s words over their targets %s", step, dict(zip(DOMAINS, over, strict=True)), targets)
            break
        before = over
        pull = [sum(w * o for w, o in zip(row, over, strict=True)) for row in weight]
        back = sum((p * x for p, x in zip(share[1:], pull[1:], strict=True)), share[0] * pull[0])
        rate = F.greatest(least, rate - back)
        if step % CUT == CUT - 1:
            floor = least if held is scores else F.col("_least")
            held = held.select("n_words", *[f"p_{d}" for d in DOMAINS], floor.alias("_least"), F.greatest(floor, recent - back).alias("_rate")).checkpoint()
            recent = F.col("_rate")
        else:
            recent = F.greatest(least if held is scores else F.col("_least"), recent - back)
    return rate


def scored(docs: DataFrame, labels: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Posteriors of all documents, cut from their lineage.

    Where ``docs`` are what is left of ``whole``, words are learned from that, and priors are those of what is left.
    """
    scratch_dir(docs.sparkSession)
    sample = labelled_sample(labels)
    weights, priors = fit(docs if whole is None else whole, sample)
    if whole is not None:
        priors = log_priors(docs, sample)
    return posteriors(docs, weights, priors).checkpoint()


def mixed(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, scale: float = 1.0) -> DataFrame:
    """(doc_id, source, text_hash, n_words, p_<domain>..., rate) for each distinct id and text of ``docs`` (doc_id, text, source, ...).

    ``shares`` of the corpus's words, times ``scale``, are the targets. Rates are at least 0; with shares that no rates can reach
    they are the least-squares fit. A document without words has the prior as posterior and weighs nothing. Without labels all
    domains are alike. Null ids and sources are values. Rows that share id, text and source are one; extra columns are not read.
    """
    scores = scored(docs, labels)
    words = scores.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    targets = {d: (shares or SHARES)[d] * scale * words for d in DOMAINS}
    return scores.withColumn("rate", rates(scores, targets))


def repeat_by_rate(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """``docs`` with every row as often as its rate says; the fraction is settled by a hash of the id, so reruns agree."""
    named = rated.select(order_id("doc_id").alias("_mix_id"), F.col("text_hash").alias("_mix_text"), F.col("rate").alias("_mix_rate")).dropDuplicates(["_mix_id", "_mix_text"])
    lot = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / (1 << 20)
    joined = docs.join(named, (order_id("doc_id") == F.col("_mix_id")) & F.xxhash64("text").eqNullSafe(F.col("_mix_text")))
    times = F.floor(F.col("_mix_rate") + lot).cast("int")
    return joined.withColumn("_mix_times", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = mixed(docs, labels)
    return rated.select("doc_id", "source", "n_words", *[F.round(f"p_{d}", 6).alias(f"p_{d}") for d in DOMAINS], F.round("rate", 6).alias("rate"))


QUERIES = {"op8_mixing": (op8_mixing, None)}
