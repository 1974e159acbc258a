"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern, with their places, in one pass over each text. Their hashes are then counted over the corpus: in
how many repositories and by how many owners. A value that several owners share is a copied example; one that stays with its owner
looks live. Counting runs in three levels of partial aggregates, so a value in a third of all texts is a few rows per task. Long
mixed tokens that no base pattern covers are candidates too and become spans if they look live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions.patterns import let
from reportmill.llm.batches import order_id
from reportmill.operators.hotkeys import join_unique
from reportmill.session import scratch_dir

OWNERS = 1
REPOSITORIES = 3
# The patterns of each kind, in listed order, and the length a match (or its value) needs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the same runs as [0-9a-f]+ of 24 characters or more
LEAST_VALUE, LEAST_ACCESS = 6, 20
# The method's own candidates: long runs of token characters that mix digits, capitals and small letters.
TOKEN = r"[A-Za-z0-9+/_-]{28,}+"
KINDS = ("assign", "access", "hex", "token")

_BLOCK = 256
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _ahead(steps: Column) -> Column:
    """Sums of the blocks of steps before each block, so that very many matches in one text stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(blocks, lambda held: F.transform(F.sequence(F.lit(0), F.size(held) - 1), lambda b: _sum(F.slice(held, F.lit(1), b))))


def _before(steps: Column, ahead: Column, i: Column) -> Column:
    block = F.floor(i / _BLOCK).cast("int")
    return F.get(ahead, block) + _sum(F.slice(steps, block * _BLOCK + 1, i % _BLOCK))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def spans_of(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """Matches that ``keep`` lets through, as (start, kind, end, value) in code points: the text between matches gives the places."""

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            last = F.size(found) - 1
            steps = F.transform(F.sequence(F.lit(0), last), lambda i: F.length(F.get(gaps, i)) + F.length(F.get(found, i)))

            def with_steps(steps: Column) -> Column:
                def span(ahead: Column, i: Column) -> Column:
                    start = _before(steps, ahead, i) + F.length(F.get(gaps, i))
                    return let(start, lambda s: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(F.get(found, i))).alias("end"), value(F.get(found, i)).alias("value")))

                kept = F.filter(F.sequence(F.lit(0), last), lambda i: keep(F.get(found, i)))
                return let(_ahead(steps), lambda ahead: F.transform(kept, lambda i: span(ahead, i)))

            return let(steps, with_steps)

        none = F.array().cast(_SPANS)
        return F.when(F.exists(found, keep), let(F.split(text, pattern, -1), with_gaps).cast(_SPANS)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9].*[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda e: e["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda e: F.concat_ws(":", F.get(names, e["kind"]), e["start"].cast("string"), e["end"].cast("string"))), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, _id, text_hash, owner, repository, base, more): sorted base spans and further candidates of each row."""
    text = F.coalesce("text", F.lit(""))
    assign = spans_of(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE, lambda m: F.regexp_extract(m, ASSIGN, 2))
    access = spans_of(text, ACCESS, 1, lambda m: F.length(m) >= LEAST_ACCESS, lambda m: m)
    hexes = spans_of(text, HEX, 2, lambda m: F.lit(True), lambda m: m)
    token = spans_of(text, TOKEN, 3, _mixed, lambda m: m)
    keys = [F.col("doc_id"), order_id("doc_id").alias("_id"), F.xxhash64("text").alias("text_hash"), F.col("source").alias("owner"), F.struct("source", "lang").alias("repository")]
    found = docs.select(*keys, F.sort_array(F.concat(assign, access, hexes)).alias("base"), token.alias("more"))
    free = F.filter("more", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.withColumn("more", free)


def live_values(found: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(value_hash, n): hashes with at most so many owners and repositories, and how many spans have them."""
    values = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("s")).select("owner", "repository", F.xxhash64("s.value").alias("value_hash"))
    per_repository = values.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    per_owner = per_repository.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return per_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n")).filter(
        (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    ).select("value_hash", "n")


def scan(docs: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang, source, ...): counts, base_sha256, spans, n_live and n_example.

    An owner is a source, a repository a language of a source; nulls are values. A null or empty text has no spans. Base spans
    always stay; a further token is a span only if it looks live. Repeated rows count as one appearance of their repository and
    give repeated rows. Extra columns are not read.
    """
    scratch_dir(docs.sparkSession)
    found = candidates(docs).checkpoint()
    spans = found.dropDuplicates(["_id", "text_hash", "owner", "repository"]).select(
        "_id", "text_hash", F.explode(F.concat("base", "more")).alias("s")
    ).select("_id", "text_hash", "s", F.xxhash64("s.value").alias("value_hash"))
    live = join_unique(spans, live_values(found, owners, repositories), ["value_hash"], "n").groupBy("_id", "text_hash").agg(
        F.collect_set(F.when(F.col("s.kind") == 3, F.col("s"))).alias("tokens"), F.count_if(F.col("s.kind") < 3).alias("n_live")
    )
    named = live.withColumnsRenamed({"_id": "_live_id", "text_hash": "_live_text"})
    rows = found.join(named, (F.col("_id") == F.col("_live_id")) & (F.col("text_hash") == F.col("_live_text")), "left")
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    tokens = F.coalesce("tokens", F.array().cast(_SPANS))
    n_live = F.coalesce("n_live", F.lit(0)).cast("long")
    return rows.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", tokens))).alias("spans"), n_live.alias("n_live"), (F.size("base") - n_live).alias("n_example"),
    )


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


QUERIES = {"op7_secrets": (op7_secrets, None)}
