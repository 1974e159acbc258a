"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join.

A url has one key for every host suffix and every path prefix whose length some rule has. Rules are hashed into blocks of 256 bits
with all bits of a key in one block, so the filter is a small table keyed by block: probing it is a broadcast join, and its size is
fixed by ``blocks`` at any number of rules. Keys that pass meet the rules in an exact join, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 14
HASHES = 6
_WORDS = 4

# The rules of the registered query, as (host, path, action).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _bits(hashed: Column) -> list[Column]:
    """The bits of a key within its block: bytes of its hash."""
    return [F.shiftright(hashed, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(HASHES)]


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 48).cast("long") * 65_537 + F.shiftrightunsigned(hashed, 20).cast("long"), F.lit(blocks))


def _mask(bits: list[Column], word: int) -> Column:
    mask = F.lit(0).cast("long")
    for bit in bits:
        mask = mask.bitwiseOR(F.when(F.floor(bit / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)).otherwise(F.lit(0).cast("long")))
    return mask


def blocked_filter(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, w0..w3): at most ``blocks`` rows of 256 bits."""
    hashed = keys.select(F.xxhash64(key).alias("h"))
    words = [_mask(_bits(F.col("h")), w).alias(f"w{w}") for w in range(_WORDS)]
    return hashed.select(_block(F.col("h"), blocks).alias("block"), *words).groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(_WORDS)])


def possible(rows: DataFrame, key: str, filter_: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows whose key may be in the filter."""
    hashed = F.xxhash64(key)
    probed = rows.withColumn("_block", _block(hashed, blocks)).join(F.broadcast(filter_.withColumnRenamed("block", "_block")), "_block")
    hit = F.lit(True)
    for w in range(_WORDS):
        mask = _mask(_bits(hashed), w)
        hit &= F.col(f"w{w}").bitwiseAND(mask) == mask
    return probed.filter(hit).drop("_block", *[f"w{w}" for w in range(_WORDS)])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", blocks: int = BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url, ...).

    ``rules`` are (host, path, action). A rule fits its host and subdomains where the url's path starts with its path; the longest
    host and path together wins, then the longer host. A url that no rule fits has no rule and the default verdict. A url that is
    null or has no ``://`` has an empty host and path. Rules with a null are ignored; of equal rules the least action counts.
    """
    ruled = rules.select("host", "path", "action").dropna().groupBy("host", "path").agg(F.min("action").alias("verdict"))
    ruled = ruled.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "verdict")
    # Distinct lengths of rule paths: at most as many as the longest rule has characters.
    lengths = [r[0] for r in rules.dropna().select(F.length("path")).distinct().collect()]
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    asked = urls.select("host", "path").filter("host != ''").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("path"))
    starts = F.transform(fitting, lambda n: F.col("path").substr(F.lit(1), n))
    keys = asked.withColumn("part", F.explode(hosts)).withColumn("start", F.explode(starts)).withColumn("rule", F.concat("part", "start"))
    hits = possible(keys, "rule", blocked_filter(ruled, "rule", blocks), blocks)
    # The joined host must be the rule's own: a host never holds a slash, and a rule path starts where it ends.
    exact = hits.join(ruled, "rule").filter(F.length("part") == F.col("host_chars"))
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_chars", "rule", "verdict")).alias("best"))
    found = best.select("host", "path", "best.rule", "best.verdict")
    return urls.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op6_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, action string"))


SQL = r"""
WITH rules(h, p, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), ranked AS (
  SELECT u.*, r.h || r.p AS rule, r.action, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS n
  FROM urls u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM ranked WHERE n = 1
"""

QUERIES = {"op6_url_rules": (op6_url_rules, SQL)}
