"""Text, address, date and similarity queries, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportmill.catalog import bindings as B
from reportmill.catalog.reads import GROUP_SQL as _GROUP_SQL
from reportmill.config import ARREST_WORDS, CATEGORIES, EXCLUDE_WORDS, NOT_PLACES, TITLE_STOP_WORDS
from reportmill.functions import names, text, times, tokens, urls
from reportmill.operators.police import number
from reportmill.operators.similarity import order_words
from reportmill.operators.stages import compute_once


def classify_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i)\\b({c.words})\\b') THEN '{c.id}'" for c in CATEGORIES if c.words) + " ELSE 'other' END"


def classify_raw_sql(column: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, '(?i)\\b({c.words})\\b') THEN lower(regexp_extract({column}, '(?i)\\b({c.words})\\b'))" for c in CATEGORIES if c.words)
    return f"CASE {cases} END"


# The same rules for an engine without look-ahead.
_NUM = (
    r"(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
    r"|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:-(?:one|two|three|four|five|six|seven|eight|nine))?"
)
_STEPS = (
    (r"\b(?:h\.?\s?no\b\.?|house\s+no\b\.?)\s*[\w/-]*\d[\w/-]*", "", "gi"),
    (rf"\b(?:aged\s+(?:about\s+)?{_NUM}|{_NUM}-(?:and-a-half-)?(?:years?|months?)-old)\b", "", "gi"),
    (r"\b[sdwr]/o\b(?:\b[a-z]\.|[^,.;])*", "", "gi"),
    (r"\s+", " ", "g"),
    (r"\s+([,.;])", r"\1", "g"),
    (r",(\s*,)+", ",", "g"),
    (r",([.;])", r"\1", "g"),
)


def scrub_sql(column: str) -> str:
    for pattern, to, flags in _STEPS:
        column = f"regexp_replace({column}, {B.quote(pattern)}, {B.quote(to)}, '{flags}')"
    return f"trim({column})"


_SITES = r"(?:\s+[|–—-]\s+(?:latest news\b.*|hindustan times|times of india|the times of india|deccan herald|goemkarponn\b.*))+$"


def clean_title_sql(column: str) -> str:
    return f"trim(regexp_replace({scrub_sql(column)}, {B.quote(_SITES)}, '', 'i'))"


def clean_description_sql(clean: str) -> str:
    """From an already scrubbed column."""
    cut = f"substr({clean}, 1, 299)"
    last = f"(299 - strpos(reverse({cut}), ' '))"
    kept = f"CASE WHEN strpos(reverse({cut}), ' ') > 0 AND {last} > 180 THEN substr({cut}, 1, {last}) ELSE {cut} END"
    return f"CASE WHEN {clean} = '' THEN NULL WHEN length({clean}) <= 300 THEN {clean} ELSE regexp_replace({kept}, '[\\s,;:.-]+$', '') || '…' END"


def classify_documents(spark, folder):
    d = B.documents(spark, folder).select("doc_id", "text")
    return compute_once(d, {"found": text.classified(F.col("text"))}).select("doc_id", "found.category", "found.phrase")


def classify_titles(spark, folder):
    return B.reports(spark, folder).select("id", "category", text.classify(F.col("title")).alias("found"), text.classify_raw(F.col("title")).alias("phrase"))


def report_groups(spark, folder):
    return B.reports(spark, folder).select("id", text.group_of(F.col("category"), F.col("title"), F.col("description")).alias("group"))


def scrub_documents(spark, folder):
    d = B.documents(spark, folder).withColumn("clean", text.clean_text(F.col("text")))
    return d.select("doc_id", F.length("clean").alias("n"), F.md5("clean").alias("clean"))


def clean_documents(spark, folder):
    return B.documents(spark, folder).select("doc_id", text.clean_description(F.col("text")).alias("description"))


def clean_reports(spark, folder):
    r = B.reports(spark, folder)
    return r.select("id", text.clean_title(F.col("title")).alias("title"), text.clean_description(F.col("description")).alias("description"))


def incident_times(spark, folder):
    d = B.documents(spark, folder).withColumn("t", times.incident_time(F.col("text"), F.col("published_at")))
    return d.select("doc_id", times.ist_iso(F.col("t.incident_at")).alias("incident"), "t.precision")


# Each lead sentence dates its document; the expected instant follows from the row number alone.
_PUB = "CAST(published_at + INTERVAL 330 MINUTE AS DATE)"
_INCIDENT_SQL = f"""WITH {B.DOCUMENTS_SQL}, found AS (SELECT doc_id, CASE doc_id % 7
    WHEN 0 THEN {_PUB} - CAST((isodow({_PUB}) + 6) % 7 AS INTEGER) + INTERVAL 23 HOUR + INTERVAL 30 MINUTE
    WHEN 1 THEN {_PUB} - 1 + INTERVAL 9 HOUR
    WHEN 2 THEN CASE WHEN make_date(2024, 1, day) <= {_PUB} THEN CAST(make_date(2024, 1, day) AS TIMESTAMP) ELSE CAST(make_date(2023, 1, day) AS TIMESTAMP) END
    WHEN 3 THEN CASE WHEN make_date(2024, 1, day) <= {_PUB} THEN CAST(make_date(2024, 1, day) AS TIMESTAMP) ELSE CAST(make_date(2023, 12, day) AS TIMESTAMP) END
    WHEN 4 THEN CAST({_PUB} AS TIMESTAMP) END AS t,
    CASE doc_id % 7 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'date' WHEN 3 THEN 'date_range' WHEN 4 THEN 'date' ELSE 'unknown' END AS precision FROM docs)
SELECT doc_id, strftime(t, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS incident, precision FROM found"""


def canonical_links(spark, folder):
    c = B.candidates(spark, folder).withColumn("link", urls.canonical_url(F.col("url")))
    return c.select("seq", "link", urls.report_id(F.col("link")).alias("id"), urls.slug_title(F.col("url")).alias("words"))


_CANON = "CASE WHEN url LIKE 'http%' THEN regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', 'https://'), '(.)/$', '\\1') END"
_SEGMENTS = "list_filter(string_split(regexp_replace(link, '^https://[^/]*', ''), '/'), lambda s: contains(s, '-'))"
_SLUG = f"CASE WHEN link IS NOT NULL THEN trim(replace(regexp_replace(regexp_replace(coalesce({_SEGMENTS}[1], ''), '\\.(html?|cms)$', '', 'i'), '-\\d{{5,}}$', ''), '-', ' ')) END"


def likely_incidents(spark, folder):
    return B.candidates(spark, folder).select("seq", text.likely_incident(F.col("title"), F.col("url")).alias("likely"))


_HEAD = f"CASE WHEN trim(title) <> '' THEN title ELSE coalesce({_SLUG}, '') END"
LIKELY_SQL = f"""linked AS (SELECT *, {_CANON} AS link FROM candidates), headed AS (SELECT *, {_HEAD} AS head FROM linked),
  judged AS (SELECT *, head <> '' AND NOT regexp_matches(head, '(?i)\\b({EXCLUDE_WORDS})\\b')
    AND ({classify_sql('head')} <> 'other' OR regexp_matches(head, '(?i)\\b({ARREST_WORDS})\\b')) AS likely FROM headed)"""


def police_links(spark, folder):
    rows = B.police_lines(spark, folder).select("seq", F.from_json("value", "source_link string, source_type string, fir_no string, event_id string").alias("r"))
    link = urls.police_link(F.col("r.source_link"), F.coalesce("r.source_type", F.lit("news")), F.col("r.fir_no"), F.col("r.event_id"))
    return rows.filter("r.source_link IS NOT NULL").select("seq", link.alias("link"))


_POLICE_LINKS_SQL = """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 23 <> 0 THEN 'http://police.gov.in/r/' || o_orderkey || '?id=' || (o_orderkey % 7)
    || CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 19 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN '#' || o_orderkey || '%2F2024' ELSE '#ev%20' || o_orderkey END ELSE '' END END AS link
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 >= 2 AND o_orderkey % 43 <> 0 AND o_orderkey % 47 <> 0"""


def police_dates(spark, folder):
    o = B.table(spark, folder, "orders")
    n = F.col("o_orderkey")
    shown = F.when(n % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).when(
        n % 5 == 2, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    ).when(n % 5 == 3, F.date_format("o_orderdate", "yyyy-MM-dd'T'10:20:30.250'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-02-30"))
    return o.select("o_orderkey", times.ist_iso(times.parse_police_date(shown)).alias("at"), times.utc_iso(times.parse_feed_date(shown)).alias("feed_at"))


_LEAP_DAY = "CAST(make_date(year(o_orderdate), 2, 1) + 29 AS TIMESTAMP)"
_POLICE_DATES_SQL = f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate - INTERVAL 330 MINUTE WHEN 1 THEN o_orderdate - INTERVAL 330 MINUTE
      WHEN 2 THEN o_orderdate WHEN 3 THEN o_orderdate + INTERVAL 37230250 MILLISECOND ELSE {_LEAP_DAY} - INTERVAL 330 MINUTE END AS a,
    CASE o_orderkey % 5 WHEN 3 THEN o_orderdate + INTERVAL 37230250 MILLISECOND WHEN 4 THEN {_LEAP_DAY} ELSE o_orderdate END AS b FROM orders)
  SELECT o_orderkey, {B.iso_sql('a')} AS at, strftime(b, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS feed_at FROM t"""


def numbers(spark, folder):
    e = B.table(spark, folder, "events")
    n = F.col("event_id")
    shown = F.when(n % 6 == 0, "NaN").when(n % 6 == 1, "Infinity").when(n % 6 == 2, "1e999").when(n % 6 == 3, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(n % 6 == 4, "").otherwise(
        F.concat(F.lit("-"), F.col("user_id").cast("string"), F.lit("e-1"))
    )
    return e.select("event_id", number(shown).alias("number"))


def title_tokens(spark, folder):
    d = B.documents(spark, folder).withColumn("t", tokens.title_tokens(F.col("text")))
    return d.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("words"))


_STOP = ", ".join(B.quote(w) for w in TITLE_STOP_WORDS)


def tokens_sql(column: str) -> str:
    words = f"string_split(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    stem = "CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-3] WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END"
    return f"list_sort(list_distinct(list_transform(list_filter({words}, lambda w: length(w) >= 3 AND w NOT IN ({_STOP})), lambda w: {stem})))"


def normal_names(spark, folder):
    d = B.documents(spark, folder).withColumn("name", names.normalize_name(F.col("text")))
    return d.select("doc_id", F.length("name").alias("n"), F.md5("name").alias("name"))


def normal_sql(column: str) -> str:
    out = f"regexp_replace(strip_accents(lower({column})), '\\bp\\.\\s*s\\.?(\\s|$)', ' ', 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\b(police station|police post|police chowki|thana|ps)\\b', ' ', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def place_phrases(spark, folder):
    d = B.documents(spark, folder)
    return d.select("doc_id", names.place_phrase(F.col("text")).alias("phrase"))


def place_phrase_ctes(source: str) -> str:
    """CTEs that end in ``pp_first`` (doc_id, phrase): word by word over the phrases of the first 1,500 characters."""
    vague = "regexp_replace(lower(w), '[^a-z0-9_]', '', 'g') IN (" + ", ".join(B.quote(w) for w in NOT_PLACES) + ")"
    pattern = r"\b(?:in|at|near|from|of)\s+([A-Z][a-zA-Z''.-]+(?:\s+[A-Z][a-zA-Z''.-]+){0,3})"
    found = f"regexp_extract_all(substr(text, 1, 1500), '{pattern}', 1)"
    return f"""pp_phrases AS (SELECT doc_id, unnest({found}) AS phrase, generate_subscripts({found}, 1) AS pos FROM {source}),
      pp_words AS (SELECT doc_id, pos, regexp_split_to_array(phrase, '\\s+') AS ws FROM pp_phrases),
      pp_kept AS (SELECT doc_id, pos, ws, list_transform(ws, lambda w: NOT ({vague})) AS good FROM pp_words),
      pp_cut AS (SELECT doc_id, pos, regexp_replace(array_to_string(ws[1:len(good) + 1 - list_position(list_reverse(good), true)], ' '), '[.,]+$', '') AS phrase FROM pp_kept WHERE good[1]),
      pp_first AS (SELECT doc_id, first(phrase ORDER BY pos) AS phrase FROM pp_cut WHERE length(phrase) >= 4 GROUP BY 1)"""


def page_keywords(spark, folder):
    joined = F.concat_ws(",", F.lit(" crime "), F.regexp_replace("url", r"[/:]+", " , "))
    return B.table(spark, folder, "pages").select("page_id", F.array_join(text.split_keywords(joined), "|").alias("keywords"))


def document_similarity(spark, folder):
    """Jaccard similarity of neighbouring documents' word sets."""
    d = B.spread(B.table(spark, folder, "documents")).select("doc_id", tokens.title_tokens(F.col("text")).alias("a"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(other, "doc_id").select("doc_id", F.round(tokens.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


def word_order(spark, folder):
    """Rarest word of each document's set, as the similarity join orders them."""
    d = B.spread(B.table(spark, folder, "documents")).select(
        F.col("doc_id").alias("node"), F.col("lang").alias("city"), F.lit(0).alias("bucket"), F.lit(0).alias("first_at"), F.lit(0).alias("last_at"),
        tokens.title_tokens(F.col("text")).alias("tokens"),
    )
    return order_words(d).select(F.col("node").alias("doc_id"), "k", F.element_at("tokens", 1).alias("rarest"))


D = f"WITH {B.DOCUMENTS_SQL}"
QUERIES = {
    "classify_documents": (classify_documents, f"{D} SELECT doc_id, {classify_sql('text')} AS category, {classify_raw_sql('text')} AS phrase FROM docs"),
    "classify_titles": (classify_titles, f"WITH {B.REPORTS_SQL} SELECT id, category, {classify_sql('title')} AS found, {classify_raw_sql('title')} AS phrase FROM reports"),
    "report_groups": (report_groups, f"""WITH {B.REPORTS_SQL} SELECT id, {_GROUP_SQL} AS "group" FROM reports"""),
    "scrub_documents": (scrub_documents, f"{D}, c AS (SELECT doc_id, {scrub_sql('text')} AS clean FROM docs) SELECT doc_id, CAST(length(clean) AS INTEGER) AS n, md5(clean) AS clean FROM c"),
    "clean_documents": (clean_documents, f"{D}, c AS (SELECT doc_id, {scrub_sql('text')} AS clean FROM docs) SELECT doc_id, {clean_description_sql('clean')} AS description FROM c"),
    "clean_reports": (clean_reports, f"""WITH {B.REPORTS_SQL}, c AS (SELECT id, {clean_title_sql('title')} AS title, coalesce({scrub_sql('description')}, '') AS clean FROM reports)
      SELECT id, title, {clean_description_sql('clean')} AS description FROM c"""),
    "incident_times": (incident_times, _INCIDENT_SQL),
    "canonical_links": (canonical_links, f"WITH {B.CANDIDATES_SQL}, c AS (SELECT seq, url, {_CANON} AS link FROM candidates) SELECT seq, link, substr(sha1(link), 1, 12) AS id, {_SLUG} AS words FROM c"),
    "likely_incidents": (likely_incidents, f"WITH {B.CANDIDATES_SQL}, {LIKELY_SQL} SELECT seq, likely FROM judged"),
    "police_links": (police_links, _POLICE_LINKS_SQL),
    "police_dates": (police_dates, _POLICE_DATES_SQL),
    "numbers": (numbers, "SELECT event_id, CASE event_id % 6 WHEN 3 THEN value WHEN 5 THEN CAST('-' || user_id || 'e-1' AS DOUBLE) END AS number FROM events"),
    "title_tokens": (title_tokens, f"{D}, t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM docs) SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS words FROM t"),
    "normal_names": (normal_names, f"{D}, c AS (SELECT doc_id, {normal_sql('text')} AS name FROM docs) SELECT doc_id, CAST(length(name) AS INTEGER) AS n, md5(name) AS name FROM c"),
    "place_phrases": (place_phrases, f"{D}, {place_phrase_ctes('docs')} SELECT d.doc_id, f.phrase FROM docs d LEFT JOIN pp_first f USING (doc_id)"),
    "page_keywords": (page_keywords, """SELECT page_id, array_to_string(list_filter(list_transform(string_split(' crime ,' || regexp_replace(url, '[/:]+', ' , ', 'g'), ','), lambda w: trim(w)), lambda w: w <> ''), '|') AS keywords FROM pages"""),
    "document_similarity": (document_similarity, f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS a FROM documents), p AS (SELECT t.doc_id, t.a, o.a AS b, len(list_intersect(t.a, o.a)) AS n FROM t JOIN t o ON o.doc_id = t.doc_id + 1)
      SELECT doc_id, CAST(round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE n / (len(a) + len(b) - n) END, 6) AS DOUBLE) AS similarity FROM p"""),
    "word_order": (word_order, f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS a FROM documents), w AS (SELECT doc_id, unnest(a) AS w FROM t), f AS (SELECT w, count(*) AS n FROM w GROUP BY 1)
      SELECT doc_id, CAST(count(*) AS INTEGER) AS k, first(w.w ORDER BY n, w.w) AS rarest FROM w JOIN f ON f.w = w.w GROUP BY 1"""),
}
