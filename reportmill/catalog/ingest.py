"""Ingest queries: selection, sampling, upserts, grouping, police rows and places, with their SQL forms."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from reportmill.catalog import bindings as B
from reportmill.catalog.reads import _d
from reportmill.catalog.texts import (
    LIKELY_SQL, _CANON, classify_raw_sql, classify_sql, clean_description_sql, clean_title_sql, normal_sql, scrub_sql, tokens_sql,
)
from reportmill.config import CATEGORY_IDS, CITIES, CITY_IDS, GENERIC_OFFICE_WORDS, SOURCE_TYPES, STOP_NAMES
from reportmill.functions.times import window_start
from reportmill.functions.urls import canonical_url
from reportmill.operators.duplicates import best_duplicates
from reportmill.operators.eligibility import eligibility_stats, eligible
from reportmill.operators.enrich import enrich_articles
from reportmill.operators.events import assign_events
from reportmill.operators.places import geocode_misses, match_places, name_index, resolve_locations
from reportmill.operators.police import locate_police_reports, map_police_rows, reject_counts
from reportmill.operators.sampling import sample_evenly, sample_with_refill
from reportmill.operators.upsert import merge_counts, merge_reports, upsert
from reportmill.plans.collect import collect
from reportmill.plans.incremental import merge_into, read_store, report_store
from reportmill.plans.ingest_rows import run_log_entry
from reportmill.plans.merge_police import merge_police
from reportmill.plans.reprocess import rederive, reprocess
from reportmill.schemas import REPORT
from reportmill.session import scratch_dir
from reportmill.sources.gazetteer import build_gazetteer
from reportmill.sources.geocode_store import GeocodeStore
from reportmill.sources.tables import parse_police_lines

CUTOFF = window_start(B.NOW)
_REPORT = [c.split()[0] for c in REPORT.split(",")]
_CUTOFF_SQL = f"TIMESTAMP '{CUTOFF:%Y-%m-%d %H:%M:%S}'"
_NOW_SQL = f"TIMESTAMP '{B.NOW:%Y-%m-%d %H:%M:%S}'"


# --- selection -------------------------------------------------------------------------------


def _stored_links(spark, folder):
    """Links that are stored already: pages whose number is a multiple of another page's count by seven."""
    pages = B.table(spark, folder, "pages").select(F.col("page_id"), "url")
    multiples = pages.select((F.col("page_id") * 7).alias("page_id"))
    return pages.join(multiples, "page_id").select(canonical_url(F.col("url")).alias("source_link"))


_STORED_SQL = f"stored AS (SELECT {_CANON} AS source_link FROM pages WHERE page_id IN (SELECT page_id * 7 FROM pages))"
_SCREENED_SQL = f"""{B.CANDIDATES_SQL}, {LIKELY_SQL}, {_STORED_SQL},
  screened AS (SELECT *, CASE WHEN published_at IS NULL THEN 'undated' WHEN published_at < {_CUTOFF_SQL} OR published_at > {_NOW_SQL} THEN 'out_of_window'
    WHEN link IS NULL OR NOT likely THEN 'prefiltered' END AS reason FROM judged),
  firsts AS (SELECT * FROM screened WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY source, link ORDER BY seq) = 1)"""


def eligible_candidates(spark, folder):
    found = eligible(B.candidates(spark, folder), _stored_links(spark, folder), CUTOFF, B.NOW)
    return found.select("seq", "source", "url", "city")


def eligibility_counts(spark, folder):
    return eligibility_stats(B.candidates(spark, folder), _stored_links(spark, folder), CUTOFF, B.NOW)


_STATS_SQL = f"""WITH {_SCREENED_SQL}, per AS (SELECT source, count(*) AS discovered, count(*) FILTER (reason = 'undated') AS undated,
    count(*) FILTER (reason = 'out_of_window') AS out_of_window, count(*) FILTER (reason = 'prefiltered') AS prefiltered, count(*) FILTER (reason IS NULL) AS passed FROM screened GROUP BY 1),
  f AS (SELECT source, count(*) AS links, count(*) FILTER (link IN (SELECT source_link FROM stored)) AS existing FROM firsts GROUP BY 1)
SELECT p.source, discovered, undated, out_of_window, prefiltered, passed - coalesce(links, 0) AS duplicates, coalesce(existing, 0) AS existing, coalesce(links - existing, 0) AS eligible
FROM per p LEFT JOIN f USING (source)"""


# --- sampling --------------------------------------------------------------------------------

_GROUPS = ["city", "source_type"]


def _pool(spark, folder):
    number = F.substring("id", 2, 20).cast("long")
    return B.reports(spark, folder).select(*_GROUPS, "id", "published_datetime", number.alias("seq"))


def even_sample(spark, folder):
    return sample_evenly(_pool(spark, folder), _GROUPS, 25, "published_datetime", "seq").select(*_GROUPS, "id")


def _outcome(picks):
    return picks.withColumn("outcome", F.when(F.col("seq") % 3 == 0, "stored").otherwise("rejected"))


def refill_sample(spark, folder):
    tried = sample_with_refill(_pool(spark, folder), _GROUPS, 20, "published_datetime", "seq", _outcome)
    return tried.select(*_GROUPS, "id", "outcome", "round")


_POOL_SQL = f"{B.REPORTS_SQL}, pool AS (SELECT city, source_type, id, published_datetime AS t, CAST(substr(id, 2) AS BIGINT) AS seq FROM reports)"


def _sample_sql(source: str, n: str) -> str:
    """Rows of ``source`` (city, source_type, t, seq, and n where that is a column) that an even sample takes."""
    return f"""(SELECT * FROM (SELECT *, {n} AS want, count(*) OVER (PARTITION BY city, source_type) AS size,
      row_number() OVER (PARTITION BY city, source_type ORDER BY t, seq) - 1 AS rank FROM {source})
    WHERE size <= want OR (want = 1 AND rank = (size - 1) // 2)
      OR (want > 1 AND list_contains(list_transform(range(want), lambda i: CAST(floor(i * (CAST(size - 1 AS DOUBLE) / (want - 1)) + 0.5e0) AS BIGINT)), rank)))"""


def _refill_sql() -> str:
    parts = [_POOL_SQL, "rest1 AS (SELECT *, 20 AS n FROM pool)"]
    for r in range(1, 5):
        parts.append(f"pick{r} AS (SELECT city, source_type, id, t, seq, {r} AS round FROM {_sample_sql(f'rest{r}', 'n')})")
        picked = " UNION ALL ".join(f"SELECT * FROM pick{k}" for k in range(1, r + 1))
        parts.append(f"tried{r} AS ({picked})")
        parts.append(
            f"""rest{r + 1} AS (SELECT p.*, CAST(20 - coalesce(s.k, 0) AS BIGINT) AS n FROM pool p LEFT JOIN (SELECT city, source_type, count(*) AS k FROM tried{r} WHERE seq % 3 = 0 GROUP BY ALL) s USING (city, source_type)
            WHERE 20 - coalesce(s.k, 0) > 0 AND p.seq NOT IN (SELECT seq FROM tried{r}))"""
        )
    return "WITH " + ", ".join(parts) + " SELECT city, source_type, id, CASE WHEN seq % 3 = 0 THEN 'stored' ELSE 'rejected' END AS outcome, round FROM tried4"


# --- upsert and grouping ----------------------------------------------------------------------


def _fresh(spark, folder):
    """Re-sent reports: every event again under link number event_id // 2 * 3, so links repeat, some stored and some new."""
    i = F.substring("id", 2, 20).cast("long")
    k = F.floor(i / 2).cast("long") * 3
    rows = B.reports(spark, folder)
    return rows.withColumns(
        {
            "seq": i,
            "id": F.concat(F.lit("f"), i.cast("string")),
            "source_link": F.concat(F.lit("https://n"), (k % 9).cast("string"), F.lit(".in/a/"), k.cast("string")),
            "title": F.concat(F.lit("Update: "), "title"),
        }
    )


_COLUMNS_SQL = "id, city, title, category, police_station, incident_datetime, published_datetime, source_link"
_UPSERT_SQL = f"""{B.REPORTS_SQL}, numbered AS (SELECT *, CAST(substr(id, 2) AS BIGINT) AS i FROM reports),
  fresh AS (SELECT * REPLACE ('f' || i AS id, 'https://n' || ((i // 2 * 3) % 9) || '.in/a/' || (i // 2 * 3) AS source_link, 'Update: ' || title AS title) FROM numbered),
  both_ AS (SELECT {_COLUMNS_SQL}, 1 AS age, 0 AS o FROM reports UNION ALL SELECT {_COLUMNS_SQL}, 0, -i FROM fresh),
  merged AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY source_link ORDER BY age, o) = 1)"""


def upserted_reports(spark, folder):
    return upsert(B.reports(spark, folder), _fresh(spark, folder)).select("source_link", "id", "event_id", "title")


def upsert_counts(spark, folder):
    return merge_counts(B.reports(spark, folder), _fresh(spark, folder))


def merged_reports(spark, folder):
    return merge_reports(B.reports(spark, folder), _fresh(spark, folder)).select("id", "event_id")


def report_events(spark, folder):
    return assign_events(B.reports(spark, folder)).select("id", "event_id")


def _page_headlines(spark, folder):
    """One headline for each page, worded like those of the reports."""
    p, n = B.table(spark, folder, "pages"), F.col("page_id")
    words = [B.pick([a for a, _ in B.ACTIONS], n * 7), F.lit(" near "), B.pick(B.PLACES, n), F.when(n % 3 != 0, F.concat(F.lit(" ward"), (n % 50).cast("string"))), F.when(n % 4 == 0, F.concat(F.lit(" beat"), (n % 40).cast("string")))]
    return p.select(n, F.concat(*[F.coalesce(w, F.lit("")) for w in words]).alias("title"), F.timestamp_seconds(F.lit(1_704_067_200) + n % 30 * 86_400 + n % 24 * 3600).alias("published_at"))


def duplicates_of_pages(spark, folder):
    """The best duplicate of each page's headline among all reports."""
    found = best_duplicates(_page_headlines(spark, folder), B.reports(spark, folder), "page_id")
    return found.select("page_id", "duplicate", F.round("score", 6).alias("score"))


_DUPLICATES_SQL = f"""WITH {B.REPORTS_SQL},
  c AS MATERIALIZED (SELECT page_id, p, {tokens_sql('title')} AS t FROM (SELECT page_id, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 30 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) AS p,
    {B.pick_sql([a for a, _ in B.ACTIONS], 'page_id * 7')} || ' near ' || {B.pick_sql(B.PLACES, 'page_id')} || CASE WHEN page_id % 3 <> 0 THEN ' ward' || (page_id % 50) ELSE '' END
      || CASE WHEN page_id % 4 = 0 THEN ' beat' || (page_id % 40) ELSE '' END AS title FROM pages)),
  n AS MATERIALIZED (SELECT id, published_datetime AS p, {tokens_sql('title')} AS t FROM reports),
  scored AS (SELECT page_id, id, n.p AS told, len(list_intersect(c.t, n.t)) AS shared, len(c.t) + len(n.t) AS total FROM c JOIN n ON n.p BETWEEN c.p - INTERVAL 2 DAY AND c.p + INTERVAL 2 DAY)
  SELECT page_id, id AS duplicate, round(shared / (total - shared), 6) AS score FROM scored WHERE 2 * shared >= total - shared
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY shared / (total - shared) DESC, told, id) = 1"""


def _lines(spark, folder):
    """Every line of every document as a headline."""
    d = B.spread(B.table(spark, folder, "documents"))
    lines = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("at", "title"))
    return lines.select(
        F.format_string("%08d-%06d", "doc_id", "at").alias("id"), F.lit("").alias("event_id"), F.col("lang").alias("city"), "title",
        F.lit("other").alias("category"), F.lit(None).cast("string").alias("police_station"), F.lit(None).cast("timestamp").alias("incident_datetime"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("published_datetime"),
    )


def line_events(spark, folder):
    return assign_events(_lines(spark, folder)).select("id", "event_id")


def _headlines(spark, folder):
    """One report for each document, headed by its first line; in the second round every tenth document by its last line."""
    d = B.spread(B.table(spark, folder, "documents"))
    n, lines = F.col("doc_id"), F.split("text", "\n")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + n * 3600)
    named = F.format_string("d%08d", n)
    values = {
        "id": named, "event_id": named, "city": F.col("lang"), "category": F.concat(F.lit("c"), (n % 6).cast("string")), "source_link": F.concat(F.lit("https://d.in/"), n.cast("string")),
        "incident_datetime": at - F.make_dt_interval(days=(n % 5).cast("int")), "published_datetime": at, "police_station": F.when(n % 4 == 1, F.col("source")), "seq": n,
    }
    rows = d.filter("text IS NOT NULL").select("doc_id", lines.alias("lines"), *[v.alias(c) for c, v in values.items()])
    again = rows.filter(n % 10 == 0).select("*", F.element_at("lines", -1).alias("title"), F.lit(2).alias("batch"))
    rows = rows.select("*", F.col("lines")[0].alias("title"), (n % 2).cast("int").alias("batch")).unionByName(again)
    kinds = dict(f.split() for f in REPORT.split(", "))
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()], "seq", "batch")


def incremental_reports(spark, folder):
    """Reports merged in two batches, and then every tenth again under another title."""
    store = report_store(spark, f"{scratch_dir(spark)}/batches-{uuid.uuid4().hex}")
    fresh = _headlines(spark, folder).checkpoint()
    for number in range(3):
        merge_into(store, fresh.filter(F.col("batch") == number).drop("batch"))
    return read_store(store).select("id", "event_id")


_HEADLINES_SQL = """heads AS (SELECT format('d{:08d}', doc_id) AS id, lang AS city, CASE WHEN doc_id % 10 = 0 THEN string_split(text, chr(10))[-1] ELSE string_split(text, chr(10))[1] END AS title,
    'c' || (doc_id % 6) AS category, CASE WHEN doc_id % 4 = 1 THEN source END AS police_station, TIMESTAMP '1970-01-01' + to_seconds(1700000000 + doc_id * 3600) AS published_datetime,
    TIMESTAMP '1970-01-01' + to_seconds(1700000000 + doc_id * 3600) - to_days(CAST(doc_id % 5 AS INTEGER)) AS incident_datetime FROM documents WHERE text IS NOT NULL)"""


_LINES_SQL = """lines AS (SELECT format('{:08d}-{:06d}', doc_id, pos - 1) AS id, lang AS city, line AS title, 'other' AS category, CAST(NULL AS VARCHAR) AS police_station,
    CAST(NULL AS TIMESTAMP) AS incident_datetime, TIMESTAMP '1970-01-01' + to_seconds(1700000000 + doc_id * 3600) AS published_datetime
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""


def events_sql(prefix: str, source: str) -> str:
    """All pairs compared, then labels spread until nothing changes."""
    return f"""WITH RECURSIVE {prefix},
  n AS MATERIALIZED (SELECT id, city, published_datetime AS p, {tokens_sql('title')} AS t, category, police_station AS s, CAST(incident_datetime + INTERVAL 330 MINUTE AS DATE) AS d FROM {source}),
  alike AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.city = b.city AND a.id < b.id AND b.p BETWEEN a.p - INTERVAL 2 DAY AND a.p + INTERVAL 2 DAY
    AND len(a.t) <= 2 * len(b.t) AND len(b.t) <= 2 * len(a.t) WHERE 3 * len(list_intersect(a.t, b.t)) >= len(a.t) + len(b.t) AND len(a.t) > 0),
  same_station AS (SELECT min(id) OVER (PARTITION BY city, s, category, d) AS a, id AS b FROM n WHERE s IS NOT NULL AND d IS NOT NULL),
  pairs AS (SELECT a, b FROM alike UNION SELECT a, b FROM same_station WHERE a <> b),
  e AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  cc(id, l) USING KEY (id) AS (SELECT id, id FROM n UNION
    SELECT e.b, min(x.l) FROM cc x JOIN e ON e.a = x.id JOIN recurring.cc cur ON cur.id = e.b WHERE x.l < cur.l GROUP BY e.b),
  leaders AS (SELECT c.l, first(n.id ORDER BY n.p, n.id) AS event_id FROM cc c JOIN n USING (id) GROUP BY c.l)
SELECT c.id, leaders.event_id FROM cc c JOIN leaders USING (l)"""


# --- police ----------------------------------------------------------------------------------


def _police(spark, folder):
    return parse_police_lines(B.police_lines(spark, folder))


def police_rows(spark, folder):
    m = map_police_rows(_police(spark, folder), B.NOW)
    ok = F.col("reason").isNull()
    shown = m.withColumns({"incident": B.iso("incident_datetime"), "published": B.iso("published_datetime")})
    kept = ["city", "title", "category", "category_raw", "source_name", "source_type", "source_link", "incident", "incident_datetime_precision", "published",
            "location_text", "police_station", "lat", "lng", "geo_precision", "description", "needs_geo"]
    return shown.select("seq", "reason", *[F.when(ok, F.col(c)).alias(c) for c in kept])


def police_rejects(spark, folder):
    return reject_counts(map_police_rows(_police(spark, folder), B.NOW))


_N = "o_orderkey"
_TITLE = f"CASE WHEN {_N} % 17 <> 0 THEN {B.pick_sql([a for a, _ in B.ACTIONS], _N)} || ' by ' || c_name END"
_RAW = f"CASE WHEN {_N} % 9 = 2 THEN 'Snatching of chain' END"
_CAT = f"CASE {_N} % 9 WHEN 0 THEN 'robbery' WHEN 1 THEN 'theft cases' END"
_POLICE_SQL = f"""lines AS (SELECT {_N} AS n, *, {B.pick_sql([*CITY_IDS, 'mumbai'], _N)} AS city, {_TITLE} AS title0, {_CAT} AS cat0, {_RAW} AS raw0,
    {_N} % 4 IN (0, 1) AS has_mention, CASE WHEN {_N} % 4 IN (0, 1) AND {_N} % 6 <> 0 THEN 'https://Police.gov.in/list?y=' || ({_N} % 30) END AS m_url,
    TIMESTAMP '2024-01-01' + to_days(CAST({_N} % 28 AS INTEGER)) - INTERVAL 330 MINUTE AS m_pub,
    CASE WHEN {_N} % 19 = 0 THEN 'rumour' WHEN {_N} % 2 = 0 THEN {B.pick_sql(('police_press_release', 'police_detection_report'), f'{_N} // 2')} END AS type0
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE {_N} % 43 = 0 OR {_N} % 47 <> 0),
  staged AS (SELECT *, coalesce(type0, CASE WHEN has_mention AND n % 5 = 0 THEN 'police_fir_list' END, 'police_press_release') AS type1,
    CASE WHEN n % 4 >= 2 THEN CASE WHEN n % 23 = 0 THEN 'nowhere' ELSE 'http://police.gov.in/r/' || n || '?id=' || (n % 7) END ELSE m_url END AS link0,
    CASE WHEN n % 8 = 0 THEN '#' || n || '%2F2024' ELSE '#ev%20' || n END AS tail,
    coalesce(CASE n % 5 WHEN 1 THEN TIMESTAMP '2023-11-01' + to_days(CAST(n % 28 AS INTEGER)) - INTERVAL 330 MINUTE WHEN 2 THEN TIMESTAMP '2024-01-02 03:04:05' END,
      CASE WHEN has_mention THEN m_pub END,
      CASE WHEN n % 7 <> 0 THEN CASE WHEN n % 29 = 0 THEN TIMESTAMP '2022-01-01' ELSE TIMESTAMP '2024-01-05' END - INTERVAL 330 MINUTE END) AS pub,
    CASE WHEN n % 3 = 1 THEN CAST(make_date(2023, month(o_orderdate), 1) AS TIMESTAMP) + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)) - INTERVAL 330 MINUTE END AS inc,
    coalesce(cat0, '') || ' ' || coalesce(raw0, '') || ' ' || coalesce(title0, '') AS about,
    CASE WHEN n % 3 <> 0 THEN CASE WHEN n % 31 = 0 THEN 1.5e0 ELSE {B.pick_sql([c.lat for c in CITIES] + [19.0], 'n')} + (n % 50) * 1e-3 END END AS lat0,
    CASE WHEN n % 3 <> 0 AND n % 37 <> 0 THEN {B.pick_sql([c.lng for c in CITIES] + [72.0], 'n')} + (n % 50) * 1e-3 END AS lng0 FROM lines),
  judged AS (SELECT *, lat0 IS NOT NULL AND lng0 IS NOT NULL AS point, CASE WHEN n % 43 = 0 THEN 'invalid JSON' WHEN n % 41 = 0 THEN 'not a crime incident' WHEN city = 'mumbai' THEN 'unknown city mumbai'
    WHEN type1 = 'rumour' THEN 'unknown source_type rumour' WHEN link0 IS NULL THEN 'no source_link' WHEN link0 = 'nowhere' THEN 'bad source_link nowhere' WHEN title0 IS NULL THEN 'no title'
    WHEN pub IS NULL THEN 'no published_datetime' WHEN pub < {_CUTOFF_SQL} THEN 'older than the 6-month window' WHEN n % 31 = 0 AND n % 3 <> 0 AND n % 37 <> 0 THEN 'out of area' END AS reason FROM staged)"""


def _ok_sql(value: str, name: str) -> str:
    return f"CASE WHEN reason IS NULL THEN {value} END AS {name}"


_POLICE_ROWS_SQL = f"""WITH {_POLICE_SQL} SELECT n AS seq, reason, {_ok_sql('city', 'city')}, {_ok_sql('title0', 'title')},
  {_ok_sql(f"CASE WHEN cat0 = 'robbery' THEN cat0 ELSE {classify_sql('about')} END", 'category')}, {_ok_sql(f"coalesce(raw0, {classify_raw_sql('about')})", 'category_raw')},
  {_ok_sql("CASE WHEN has_mention THEN 'Desk ' || c_nationkey ELSE 'Police' END", 'source_name')}, {_ok_sql('type1', 'source_type')},
  {_ok_sql("replace(link0, 'Police', 'police') || tail", 'source_link')}, {_ok_sql(B.iso_sql('inc'), 'incident')},
  {_ok_sql("CASE WHEN inc IS NULL THEN 'unknown' ELSE CASE n % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'date' ELSE 'unknown' END END", 'incident_datetime_precision')}, {_ok_sql(B.iso_sql('pub'), 'published')},
  {_ok_sql(f"CASE WHEN n % 3 = 1 THEN {B.pick_sql(B.PLACES, 'n')} END", 'location_text')}, {_ok_sql(f"CASE WHEN n % 6 < 2 THEN {B.pick_sql(B.PLACES, 'n')} END", 'police_station')},
  {_ok_sql('CASE WHEN point THEN lat0 ELSE 0 END', 'lat')}, {_ok_sql('CASE WHEN point THEN lng0 ELSE 0 END', 'lng')},
  {_ok_sql("CASE WHEN point THEN CASE (n // 2) % 4 WHEN 0 THEN 'address' WHEN 1 THEN 'city' ELSE 'locality' END ELSE 'city' END", 'geo_precision')},
  {_ok_sql("CASE WHEN n % 3 = 0 THEN 'Priority ' || o_orderpriority || ', done' END", 'description')}, {_ok_sql('NOT point', 'needs_geo')} FROM judged"""


def _gaz(spark, folder):
    return B.gazetteer(spark, folder), B.geocodes(spark, folder)


def police_located(spark, folder):
    placed = locate_police_reports(map_police_rows(_police(spark, folder), B.NOW), *_gaz(spark, folder))
    kept = placed.filter("reason IS NULL")
    return kept.select("seq", "city", "location_text", "police_station", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "geo_precision")


def police_merge_counts(spark, folder):
    gazetteer, geocodes = _gaz(spark, folder)
    mapped = locate_police_reports(map_police_rows(_police(spark, folder), B.NOW), gazetteer, geocodes)
    return merge_counts(B.reports(spark, folder), mapped.filter("reason IS NULL"))


def police_merge(spark, folder):
    gazetteer, geocodes = _gaz(spark, folder)
    return merge_police(_police(spark, folder), B.reports(spark, folder), gazetteer, geocodes, B.NOW).merged.select("id", "event_id", "source_link")


# --- places ----------------------------------------------------------------------------------


def place_matches(spark, folder):
    rows = B.place_texts(spark, folder)
    found = match_places(rows, B.gazetteer(spark, folder), "doc_id")
    return found.select("doc_id", F.col("by_location.name").alias("by_location"), F.col("by_text.name").alias("by_text"), F.col("by_text.kind").alias("kind"))


_ALIASES = " OR ".join(f"(city = '{c.id}' AND gram IN ({', '.join(B.quote(a) for a in c.aliases)}))" for c in CITIES)
_STOPS = ", ".join(B.quote(w) for w in STOP_NAMES)
_INDEX_SQL = f"""{B.GAZETTEER_SQL}, normed AS (SELECT *, {normal_sql('name')} AS gram FROM gazetteer),
  usable AS (SELECT * FROM normed WHERE length(gram) >= 4 AND gram NOT IN ({_STOPS}) AND NOT ({_ALIASES})
    AND NOT (kind = 'police_station' AND regexp_matches(lower(name), '\\b({GENERIC_OFFICE_WORDS})\\b'))),
  stations AS (SELECT city, gram, min(position) AS position, first(name ORDER BY position) AS name, first(lat ORDER BY position) AS lat, first(lng ORDER BY position) AS lng FROM usable WHERE kind = 'police_station' GROUP BY ALL),
  names AS (SELECT city, gram, min(position) AS position, first(name ORDER BY kind = 'police_station', position) AS name, first(kind ORDER BY kind = 'police_station', position) AS kind,
    first(lat ORDER BY kind = 'police_station', position) AS lat, first(lng ORDER BY kind = 'police_station', position) AS lng FROM usable GROUP BY ALL)"""


def place_index(spark, folder):
    index = name_index(B.gazetteer(spark, folder))
    return index.select("city", "use", "gram", "position", F.col("entry.name").alias("name"), F.col("entry.kind").alias("kind"))


# Every name is looked for in every text; phrases before police words are taken apart word by word.
_PS = r"([A-Z][A-Za-z.''-]*(?:\s+[A-Z][A-Za-z.''-]*){0,3})\s+(?:police station|police post|PS)\b"


def _match_sql(names: str, stations: str) -> str:
    """The best hit of each look; ``names`` and ``stations`` are the parts of a text that are searched."""
    return f"""{_INDEX_SQL}, {B.PLACE_TEXTS_SQL},
  hays AS MATERIALIZED (SELECT doc_id, city, 0 AS look, 0 AS hay, location_text AS raw, {normal_sql('location_text')} AS h FROM place_texts WHERE location_text IS NOT NULL
    UNION ALL SELECT doc_id, city, 1, 0, title, {normal_sql('title')} FROM place_texts
    UNION ALL SELECT doc_id, city, 1, 1, keywords, {normal_sql('keywords')} FROM place_texts
    UNION ALL SELECT doc_id, city, 1, 2, {names}, {normal_sql(names)} FROM place_texts),
  station_hays AS (SELECT doc_id, city, look, hay, raw FROM hays WHERE look = 0 OR hay = 0 UNION ALL SELECT doc_id, city, 1, 1, {stations} FROM place_texts),
  phrases AS (SELECT doc_id, city, look, hay, generate_subscripts(regexp_extract_all(raw, '{_PS}', 1), 1) AS m, unnest(regexp_extract_all(raw, '{_PS}', 1)) AS phrase FROM station_hays),
  tails AS (SELECT *, unnest(range(1, 9)) AS i, string_split({normal_sql('phrase')}, ' ') AS ws FROM phrases),
  station_hits AS (SELECT t.doc_id, t.look, 0 AS use, t.hay, t.m, t.i, 0 AS n, 0 AS position, s.name, 'police_station' AS kind, s.lat, s.lng FROM tails t JOIN stations s
    ON s.city = t.city AND t.i <= len(t.ws) AND s.gram = array_to_string(t.ws[t.i:], ' ')),
  name_hits AS (SELECT h.doc_id, h.look, 1 AS use, h.hay, 0 AS m, 0 AS i, -length(x.gram) AS n, x.position, x.name, x.kind, x.lat, x.lng FROM hays h JOIN names x
    ON x.city = h.city AND contains(' ' || h.h || ' ', ' ' || x.gram || ' ')),
  hits AS (SELECT * FROM station_hits UNION ALL SELECT * FROM name_hits),
  best AS MATERIALIZED (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, look ORDER BY use, hay, m, i, n, position) = 1)"""


_MATCH_SQL = _match_sql("substr(text, 1, 1500)", "substr(text, 1, 3000)")
_MATCHES_SQL = f"""WITH {_match_sql("text", "text")} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.name AS by_location, b.name AS by_text, b.kind AS kind
  FROM (SELECT * FROM best WHERE look = 0) a FULL JOIN (SELECT * FROM best WHERE look = 1) b ON a.doc_id = b.doc_id"""


def resolved_places(spark, folder):
    gazetteer, geocodes = _gaz(spark, folder)
    done = resolve_locations(B.place_texts(spark, folder), gazetteer, geocodes, "doc_id")
    return done.select(
        "doc_id", "location.location_text", "location.police_station", F.round("location.lat", 6).alias("lat"), F.round("location.lng", 6).alias("lng"),
        "location.geo_precision", "location.in_area", F.array_join("unresolved", ",").alias("unresolved"),
    )


def _resolved_sql() -> str:
    from reportmill.catalog.texts import place_phrase_ctes

    phrase = place_phrase_ctes("place_texts")
    inside = " OR ".join(f"(city = '{c.id}' AND lat BETWEEN {_d(c.min_lat)} AND {_d(c.max_lat)} AND lng BETWEEN {_d(c.min_lng)} AND {_d(c.max_lng)})" for c in CITIES)
    hav = "(pow(sin(radians(l_lat - s_lat) / 2), 2) + cos(radians(s_lat)) * cos(radians(l_lat)) * pow(sin(radians(l_lng - s_lng) / 2), 2))"
    center = lambda a: "CASE city " + " ".join(f"WHEN '{c.id}' THEN {_d(getattr(c, a))}" for c in CITIES) + " END"
    return f"""WITH {_MATCH_SQL}, {B.GEOCODES_SQL}, {phrase},
  x AS (SELECT p.doc_id, p.city, p.location_text, p.lat AS g_lat, p.lng AS g_lng, p.lat IS NOT NULL AS given, a.name AS an, a.kind AS ak, a.lat AS alat, a.lng AS alng,
      b.name AS bn, b.kind AS bk, b.lat AS blat, b.lng AS blng, f.phrase, p.city || '|' || lower(p.location_text) AS k1, p.city || '|' || lower(f.phrase) AS k2
    FROM place_texts p LEFT JOIN best a ON a.doc_id = p.doc_id AND a.look = 0 LEFT JOIN best b ON b.doc_id = p.doc_id AND b.look = 1 LEFT JOIN pp_first f ON f.doc_id = p.doc_id),
  y AS (SELECT x.*, NOT given AND an IS NULL AND location_text IS NOT NULL AS ask1, g1.key IS NOT NULL AS known1, g1.lat AS g1lat, g1.lng AS g1lng, g2.key IS NOT NULL AS known2, g2.lat AS g2lat, g2.lng AS g2lng
    FROM x LEFT JOIN geocodes g1 ON g1.key = k1 LEFT JOIN geocodes g2 ON g2.key = k2),
  z AS (SELECT *, CASE WHEN ak = 'police_station' THEN an WHEN bk = 'police_station' THEN bn END AS s_name, CASE WHEN ak = 'police_station' THEN alat WHEN bk = 'police_station' THEN blat END AS s_lat,
      CASE WHEN ak = 'police_station' THEN alng WHEN bk = 'police_station' THEN blng END AS s_lng,
      CASE WHEN ak = 'locality' THEN 1 WHEN ask1 AND g1lat IS NOT NULL THEN 2 WHEN bk = 'locality' THEN 3 WHEN phrase IS NOT NULL AND g2lat IS NOT NULL THEN 4 ELSE 0 END AS how FROM y),
  w AS (SELECT *, CASE how WHEN 1 THEN an WHEN 2 THEN location_text WHEN 3 THEN bn WHEN 4 THEN phrase END AS l_name, CASE how WHEN 1 THEN alat WHEN 2 THEN g1lat WHEN 3 THEN blat WHEN 4 THEN g2lat END AS l_lat,
      CASE how WHEN 1 THEN alng WHEN 2 THEN g1lng WHEN 3 THEN blng WHEN 4 THEN g2lng END AS l_lng, NOT given AND how IN (0, 4) AND phrase IS NOT NULL AS ask2 FROM z),
  v AS (SELECT *, CASE WHEN given THEN 'address' WHEN how > 0 AND (s_name IS NULL OR 12742 * asin(sqrt({hav})) <= 5) THEN 'locality' WHEN s_name IS NOT NULL THEN 'police_station' ELSE 'city' END AS geo FROM w),
  u AS (SELECT *, CASE geo WHEN 'address' THEN g_lat WHEN 'locality' THEN l_lat WHEN 'police_station' THEN s_lat ELSE {center('lat')} END AS lat,
      CASE geo WHEN 'address' THEN g_lng WHEN 'locality' THEN l_lng WHEN 'police_station' THEN s_lng ELSE {center('lng')} END AS lng FROM v)
SELECT doc_id, CASE geo WHEN 'locality' THEN l_name WHEN 'police_station' THEN s_name ELSE location_text END AS location_text, CASE WHEN geo IN ('locality', 'police_station') THEN s_name END AS police_station,
  CAST(round(lat, 6) AS DOUBLE) AS lat, CAST(round(lng, 6) AS DOUBLE) AS lng, geo AS geo_precision, geo = 'city' OR ({inside}) AS in_area,
  concat_ws(',', CASE WHEN ask1 AND NOT known1 THEN k1 END, CASE WHEN ask2 AND NOT known2 THEN k2 END) AS unresolved FROM u"""


def unresolved_places(spark, folder):
    gazetteer, geocodes = _gaz(spark, folder)
    return geocode_misses(resolve_locations(B.place_texts(spark, folder), gazetteer, geocodes, "doc_id"))


def stored_geocodes(spark, folder):
    """Geocode answers in three batches, folded after the second, then looked up for all suppliers and customers.

    Answers whose key ends in an odd digit come late; those that end in 0 are corrected; a third of the customers are known misses.
    """
    store = GeocodeStore(spark, f"{scratch_dir(spark)}/geocodes-{uuid.uuid4().hex}", 8)
    answers, last = B.geocodes(spark, folder).checkpoint(), F.substring("key", -1, 1)
    late = last.isin("1", "3", "5", "7", "9")
    store.add(answers.filter(~late))
    store.add(answers.filter(late | (last == "0")).withColumn("lat", F.when(last == "0", F.col("lat") + 1).otherwise(F.col("lat"))))
    store.fold()
    names = B.table(spark, folder, "customer").select(F.concat(F.lit("goa|"), F.lower("c_name")).alias("key"), "c_custkey")
    none = F.lit(None)
    store.add(names.filter("c_custkey % 3 = 0").select("key", none.cast("double").alias("lat"), none.cast("double").alias("lng"), none.cast("string").alias("display_name")))
    found = store.lookup(answers.select("key").unionByName(names.select("key")))
    return found.select("key", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "known")


_STORED_GEOCODES_SQL = f"""WITH {B.GEOCODES_SQL}
SELECT key, round(CASE WHEN right(key, 1) = '0' THEN lat + 1 ELSE lat END, 6) AS lat, round(lng, 6) AS lng, true AS known FROM geocodes
UNION ALL SELECT 'goa|' || lower(c_name), NULL, NULL, c_custkey % 3 = 0 FROM customer"""


def built_gazetteer(spark, folder):
    """Map elements of every part, some without names, some with marks, most twice."""
    p = B.table(spark, folder, "part")
    k = F.col("p_partkey")
    tags = F.map_filter(
        F.create_map(
            F.lit("name"), F.when(k % 10 == 3, F.concat(F.col("p_name"), F.lit(" é"))).when(k % 10 != 4, F.initcap("p_name")),
            F.lit("name:en"), F.when(k % 10 == 5, F.concat(F.lit("New "), F.initcap("p_name"))),
            F.lit("amenity"), F.when(k % 3 == 0, "police"),
        ),
        lambda _, v: v.isNotNull(),
    )
    elements = p.select(
        B.pick(CITY_IDS, F.floor(k / 7)).alias("city"), k.cast("int").alias("position"),
        F.when(k % 4 != 0, F.lit(12.0) + k * 0.000013).alias("lat"), F.when(k % 4 != 0, F.lit(77.0) + k * 0.000017).alias("lon"),
        F.when(k % 8 == 0, F.struct((F.lit(15.0) + k * 0.0001234).alias("lat"), (F.lit(73.0) + k * 0.0001234).alias("lon"))).alias("center"),
        tags.alias("tags"),
    )
    return build_gazetteer(elements)


_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_BUILT_SQL = f"""WITH el AS (SELECT p_partkey AS position, {B.pick_sql(CITY_IDS, 'p_partkey // 7')} AS city,
    CASE p_partkey % 10 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'New ' || {_NAME} ELSE {_NAME} END AS name,
    CASE WHEN p_partkey % 3 = 0 THEN 'police_station' ELSE 'locality' END AS kind,
    CASE WHEN p_partkey % 4 <> 0 THEN 12.0e0 + p_partkey * 1.3e-5 WHEN p_partkey % 8 = 0 THEN 15.0e0 + p_partkey * 1.234e-4 END AS lat,
    CASE WHEN p_partkey % 4 <> 0 THEN 77.0e0 + p_partkey * 1.7e-5 WHEN p_partkey % 8 = 0 THEN 73.0e0 + p_partkey * 1.234e-4 END AS lng FROM part)
  SELECT position, city, name, kind, floor(lat * 100000 + 0.5e0) / 100000 AS lat, floor(lng * 100000 + 0.5e0) / 100000 AS lng FROM el WHERE name IS NOT NULL AND lat IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY city, kind, lower(name) ORDER BY position) = 1"""


# --- articles --------------------------------------------------------------------------------


def _articles(spark, folder):
    """Documents as articles with a headline by row number; the whole document is the text."""
    n = F.col("doc_id")
    return B.documents(spark, folder).select(
        n.alias("seq"), F.lit("toi").alias("source"), F.concat(F.lit("http://n.in/story-"), n.cast("string"), F.lit("?x=1")).alias("url"),
        F.concat(B.pick([a for a, _ in B.ACTIONS], n), F.lit(" | Latest News Delhi")).alias("title"), "published_at",
        F.col("text").alias("description"), "text", F.array(F.lit("crime")).alias("keywords"), B.pick(CITY_IDS, n).alias("city"), F.col("source").alias("source_name"),
    )


def enriched_reports(spark, folder):
    gazetteer, geocodes = _gaz(spark, folder)
    done = enrich_articles(_articles(spark, folder), gazetteer, geocodes)
    return done.select(
        "seq", "id", "title", "category", "category_raw", "source_link", "incident_datetime_precision", B.iso("published_datetime").alias("published"), F.md5("description").alias("description")
    )


_ENRICH_SQL = f"""WITH {B.DOCUMENTS_SQL}, a AS (SELECT doc_id, text, published_at, {B.pick_sql([x for x, _ in B.ACTIONS], 'doc_id')} AS head, 'https://n.in/story-' || doc_id AS link, {scrub_sql('text')} AS clean FROM docs),
  c AS (SELECT *, head || ' | Latest News Delhi ' || text AS about FROM a)
SELECT doc_id AS seq, substr(sha1(link), 1, 12) AS id, head AS title, {classify_sql('about')} AS category, {classify_raw_sql('about')} AS category_raw, link AS source_link,
  CASE doc_id % 7 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'date' WHEN 3 THEN 'date_range' WHEN 4 THEN 'date' ELSE 'unknown' END AS incident_datetime_precision,
  {B.iso_sql('published_at')} AS published, md5({clean_description_sql('clean')}) AS description FROM c"""


def rederived_reports(spark, folder):
    """Stored reports with some stations that are offices, derived again."""
    i = F.substring("id", 2, 20).cast("long")
    rows = B.reports(spark, folder).withColumn("police_station", F.when(i % 50 == 3, "Crime Branch HQ").otherwise(F.col("police_station")))
    gazetteer, geocodes = _gaz(spark, folder)
    done = rederive(rows, gazetteer, geocodes)
    return done.select("id", "title", "category", "category_raw", "location_text", "police_station", "geo_precision", F.round("lat", 6).alias("lat"), F.md5("description").alias("description"))


_REDERIVE_SQL = f"""WITH {B.REPORTS_SQL}, c AS (SELECT *, {scrub_sql('title')} AS clean_title, nullif({scrub_sql('description')}, '') AS clean, CAST(substr(id, 2) AS BIGINT) % 50 = 3 AS office FROM reports),
  d AS (SELECT *, clean_title || ' ' || coalesce(clean, '') AS about FROM c)
SELECT id, clean_title AS title, CASE WHEN source_type = 'news' THEN {classify_sql('about')} ELSE category END AS category, CASE WHEN source_type = 'news' THEN {classify_raw_sql('about')} END AS category_raw,
  CASE WHEN NOT office THEN location_text END AS location_text, CASE WHEN NOT office THEN police_station END AS police_station, CASE WHEN office THEN 'city' ELSE geo_precision END AS geo_precision,
  CAST(round(CASE WHEN office THEN CASE city {" ".join(f"WHEN '{x.id}' THEN {_d(x.lat)}" for x in CITIES)} END ELSE lat END, 6) AS DOUBLE) AS lat, md5(clean) AS description FROM d"""


def reprocessed_events(spark, folder):
    gazetteer, geocodes = _gaz(spark, folder)
    return reprocess(B.reports(spark, folder), gazetteer, geocodes).select("id", "event_id")


def _collected(spark, folder):
    gazetteer, geocodes = _gaz(spark, folder)
    found = B.candidates(spark, folder)
    pages = B.html_pages(spark, folder)
    existing = B.reports(spark, folder)
    return collect(found, pages, existing, gazetteer, geocodes, B.NOW, 15)


def collected_reports(spark, folder):
    return _collected(spark, folder).merged.select("id", "event_id", "source_link")


def collection_log(spark, folder):
    stats = _collected(spark, folder).stats
    return run_log_entry(stats, "backfill", B.NOW - timedelta(minutes=5), B.NOW)


QUERIES = {
    "eligible_candidates": (eligible_candidates, f"WITH {_SCREENED_SQL} SELECT seq, source, link AS url, city FROM firsts WHERE link NOT IN (SELECT source_link FROM stored)"),
    "eligibility_counts": (eligibility_counts, _STATS_SQL),
    "even_sample": (even_sample, f"WITH {_POOL_SQL} SELECT city, source_type, id FROM {_sample_sql('pool', '25')}"),
    "refill_sample": (refill_sample, _refill_sql()),
    "upserted_reports": (upserted_reports, f"WITH {_UPSERT_SQL} SELECT source_link, id, id AS event_id, title FROM merged"),
    "upsert_counts": (upsert_counts, f"WITH {_UPSERT_SQL} SELECT count(*) AS merged, count(*) FILTER (source_link NOT IN (SELECT source_link FROM reports)) AS inserted, count(*) FILTER (source_link IN (SELECT source_link FROM reports)) AS updated FROM fresh"),
    "report_events": (report_events, events_sql(B.REPORTS_SQL, "reports")),
    "line_events": (line_events, events_sql(_LINES_SQL, "lines")),
    "merged_reports": (merged_reports, events_sql(_UPSERT_SQL, "merged")),
    "incremental_reports": (incremental_reports, events_sql(_HEADLINES_SQL, "heads")),
    "duplicates_of_pages": (duplicates_of_pages, _DUPLICATES_SQL),
    "police_rows": (police_rows, _POLICE_ROWS_SQL),
    "police_rejects": (police_rejects, f"WITH {_POLICE_SQL} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1"),
    "police_located": (police_located, None),
    "police_merge_counts": (police_merge_counts, None),
    "police_merge": (police_merge, None),
    "place_index": (place_index, f"WITH {_INDEX_SQL} SELECT city, 0 AS use, gram, position, name, 'police_station' AS kind FROM stations UNION ALL SELECT city, 1, gram, position, name, kind FROM names"),
    "place_matches": (place_matches, _MATCHES_SQL),
    "resolved_places": (resolved_places, _resolved_sql()),
    "unresolved_places": (unresolved_places, f"SELECT DISTINCT unnest(string_split(unresolved, ',')) AS key FROM ({_resolved_sql()}) WHERE unresolved <> ''"),
    "stored_geocodes": (stored_geocodes, _STORED_GEOCODES_SQL),
    "built_gazetteer": (built_gazetteer, _BUILT_SQL),
    "enriched_reports": (enriched_reports, _ENRICH_SQL),
    "rederived_reports": (rederived_reports, _REDERIVE_SQL),
    "reprocessed_events": (reprocessed_events, None),
    "collected_reports": (collected_reports, None),
    "collection_log": (collection_log, None),
}
