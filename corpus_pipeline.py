"""The corpus pipeline: quality rules, line dedup, near-duplicate join, source mixing, token encoding.

Each stage reads all that the one before kept and returns the columns of documents; the last returns the encoded corpus. A document
whose every line an earlier one has goes with its lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm import jaccard_join, line_dedup, mixing, pieces, quality
from reportmill.session import scratch_dir

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def cut_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; n_chars follows the text. Documents left without a word are dropped."""
    cut = line_dedup.line_dedup(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id."""
    return jaccard_join.one_of_each(docs)


def mix_domains(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that domains have mixing.SHARES of as many words as there are.

    A document that is more likely good than not stays at least once; where such documents have more good words than the share
    allows, all domains grow with them. The classifier learns from all documents, as few poor ones are left here.
    """
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scores = mixing.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole)
    good = F.col("p_good") >= 0.5
    held = scores.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.when(good, F.col("n_words") * F.col("p_good"))), F.lit(0.0))).first()
    words = max(held[0], held[1] / mixing.SHARES["good"])
    targets = {d: share * words for d, share in mixing.SHARES.items()}
    return mixing.repeat_by_rate(docs, scores.withColumn("rate", mixing.rates(scores, targets, least=F.when(good, 1.0).otherwise(0.0))))


def encode_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: ids as little-endian unsigned 32-bit integers, their source bytes as pairs of such, and their number."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.model_path(), arrays=False)
    return coded.select("doc_id", "lang", "source", F.floor(F.length("ids") / 4).alias("n_tokens"), "ids", "spans")


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", cut_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("source mixing", mix_domains),
    ("token encoding", encode_tokens),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*_COLUMNS)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs


# Covariance estimates, components and byte-pair merges are no SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": (run, ORACLE_SQL)}
