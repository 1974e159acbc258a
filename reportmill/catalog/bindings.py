"""Incident tables derived from the driver's tables.

Every table here is a formula over whole driver tables, written twice: as a DataFrame and as SQL text that
another engine can run. Invented driver text has no incident words, so short phrases are chosen by row number
and put around the whole text of each row.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.config import CITIES, CITY_IDS
from reportmill.functions.times import ist_iso
from reportmill.schemas import REPORT
from reportmill.session import apply_settings

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)

# Headline beginnings with the category each one falls into.
ACTIONS = (
    ("Chain snatched by bikers", "snatching"),
    ("Trader duped in online fraud", "cyber_fraud"),
    ("Flat burglary solved", "burglary_theft"),
    ("Hotel booking scam exposed", "fraud"),
    ("Cab driver assaulted", "assault"),
    ("Youth stabbed during brawl", "assault"),
    ("Pupil molested on bus", "sexual_crime"),
    ("Truck overturns", "road_accident"),
    ("Shopkeeper murdered", "murder"),
    ("Bullet found after firing", "shooting"),
    ("Child kidnapped for ransom", "kidnapping"),
    ("Jeweller robbed at gunpoint", "robbery"),
    ("Gangster held with pistol", "extortion_organised_crime"),
    ("Ganja seized", "drugs"),
    ("Two swimmers drown", "drowning"),
    ("Clerk found hanging", "unnatural_death"),
    ("Wall collapses", "public_safety"),
    ("Parade route changed", "other"),
    ("PG tenant cheated of deposit", "fraud"),
    ("Metro commuter harassed", "sexual_crime"),
    ("Villa robbery accused arrested", "robbery"),
    ("Court rejects plea over theft", "burglary_theft"),
)
PLACES = ("Green Park", "Lake View", "Old Fort", "River Side", "Hill Top", "Sun City", "Rose Garden", "Palm Beach", "Clock Tower")
SUFFIXES = ("", " | Latest News Delhi", "", " - Times of India", "", " - Hindustan Times | Latest News Goa", "")
SOURCE_NAMES = ("Morning Star", "morning star", "Evening Post", "City Police", "Times", "beacon", "Beacon")
SOURCE_TYPES = ("news", "police_press_release", "news", "police_fir_list", "news", "police_detection_report", "news")
PRECISIONS = ("city", "address", "police_station", "locality", "locality", "city", "police_station")
INCIDENT_PRECISIONS = ("unknown", "exact", "date", "date_range")


def pick(values, index: Column) -> Column:
    """Element ``index`` modulo the list length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def quote(value: object) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def pick_sql(values, index: str) -> str:
    listed = ", ".join(f"{v:.17e}" if isinstance(v, float) else quote(v) for v in values)
    return f"([{listed}])[1 + ({index}) % {len(values)}]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return apply_settings(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Gives every core a share of a table that is stored in fewer pieces than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _int_div(value: Column, by: int) -> Column:
    return F.floor(value / by).cast("long")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports: one per row of events."""
    e = spread(table(spark, folder, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    i, u = F.col("event_id"), F.col("user_id")
    case = _int_div(i, 12)
    incident = F.when(i % 4 != 0, F.timestamp_micros(F.unix_micros("ts") - (F.floor("value") % 72) * 3_600_000_000))
    staged = e.select(
        F.concat(F.lit("r"), i.cast("string")).alias("id"),
        F.concat(F.lit("e"), case.cast("string"), F.lit("-"), (i % 3).cast("string")).alias("event_id"),
        pick(CITY_IDS, i).alias("city"),
        F.concat(
            pick([a for a, _ in ACTIONS], case * 7 + i % 3), F.lit(" near "), pick(PLACES, case + u % 2), F.lit(" ward"), (case % 50).cast("string"),
            F.lit(" beat"), (u % 40).cast("string"), pick(SUFFIXES, i),
        ).alias("title"),
        pick([c for _, c in ACTIONS], case * 7 + i % 3).alias("category"),
        F.lit(None).cast("string").alias("category_raw"),
        pick(SOURCE_NAMES, u).alias("source_name"),
        pick(SOURCE_TYPES, i).alias("source_type"),
        F.concat(F.lit("https://n"), (i % 9).cast("string"), F.lit(".in/a/"), i.cast("string")).alias("source_link"),
        incident.alias("incident_datetime"),
        pick(INCIDENT_PRECISIONS, i).alias("incident_datetime_precision"),
        F.col("ts").alias("published_datetime"),
        F.when(u % 6 != 0, pick(PLACES, case + u % 2)).alias("location_text"),
        F.when(i % 5 != 1, F.concat(pick(PLACES, u), F.lit(" PS"))).alias("police_station"),
        (pick([c.min_lat for c in CITIES], i) + (i * 7919 % 1000) / 1000 * pick([c.max_lat - c.min_lat for c in CITIES], i)).alias("lat"),
        (pick([c.min_lng for c in CITIES], i) + (i * 104729 % 1000) / 1000 * pick([c.max_lng - c.min_lng for c in CITIES], i)).alias("lng"),
        pick(PRECISIONS, i).alias("geo_precision"),
        F.when(
            i % 11 != 0,
            F.concat(
                F.lit("A "), (i % 50 + 20).cast("string"), F.lit("-year-old resident s/o R. Kumar, r/o H.No. "), u.cast("string"),
                F.lit("/B, reported the "), "event_type", F.lit(" , aged about "), (i % 60 + 10).cast("string"),
                F.when(u % 8 == 0, F.lit(" at a guest house.")).when(u % 8 == 1, F.lit(" in a taxi.")).otherwise(F.lit(".")),
            ),
        ).alias("description"),
    )
    columns = [c.split()[0] for c in REPORT.split(",")]
    return staged.withColumn("effective_at", F.coalesce("incident_datetime", "published_datetime")).select(*columns)


REPORTS_SQL = f"""reports AS (
  SELECT r.*, coalesce(incident_datetime, published_datetime) AS effective_at FROM (
  SELECT 'r' || event_id AS id, 'e' || (event_id // 12) || '-' || (event_id % 3) AS event_id,
    {pick_sql(CITY_IDS, 'event_id')} AS city,
    {pick_sql([a for a, _ in ACTIONS], '(event_id // 12) * 7 + event_id % 3')} || ' near ' || {pick_sql(PLACES, 'event_id // 12 + user_id % 2')}
      || ' ward' || ((event_id // 12) % 50) || ' beat' || (user_id % 40) || {pick_sql(SUFFIXES, 'event_id')} AS title,
    {pick_sql([c for _, c in ACTIONS], '(event_id // 12) * 7 + event_id % 3')} AS category,
    CAST(NULL AS VARCHAR) AS category_raw,
    {pick_sql(SOURCE_NAMES, 'user_id')} AS source_name, {pick_sql(SOURCE_TYPES, 'event_id')} AS source_type,
    'https://n' || (event_id % 9) || '.in/a/' || event_id AS source_link,
    CASE WHEN event_id % 4 <> 0 THEN ts - to_hours(CAST(floor(value) AS INTEGER) % 72) END AS incident_datetime,
    {pick_sql(INCIDENT_PRECISIONS, 'event_id')} AS incident_datetime_precision,
    ts AS published_datetime,
    CASE WHEN user_id % 6 <> 0 THEN {pick_sql(PLACES, 'event_id // 12 + user_id % 2')} END AS location_text,
    CASE WHEN event_id % 5 <> 1 THEN {pick_sql(PLACES, 'user_id')} || ' PS' END AS police_station,
    {pick_sql([c.min_lat for c in CITIES], 'event_id')} + (event_id * 7919 % 1000) / 1000.0e0 * {pick_sql([c.max_lat - c.min_lat for c in CITIES], 'event_id')} AS lat,
    {pick_sql([c.min_lng for c in CITIES], 'event_id')} + (event_id * 104729 % 1000) / 1000.0e0 * {pick_sql([c.max_lng - c.min_lng for c in CITIES], 'event_id')} AS lng,
    {pick_sql(PRECISIONS, 'event_id')} AS geo_precision,
    CASE WHEN event_id % 11 <> 0 THEN 'A ' || (event_id % 50 + 20) || '-year-old resident s/o R. Kumar, r/o H.No. ' || user_id
      || '/B, reported the ' || event_type || ' , aged about ' || (event_id % 60 + 10)
      || CASE user_id % 8 WHEN 0 THEN ' at a guest house.' WHEN 1 THEN ' in a taxi.' ELSE '.' END END AS description
  FROM events) r)"""

# Sentences put before and after the whole text of a document.
LEADS = (
    "The theft took place on Monday at 11.30 pm, the owner said. ",
    "She was robbed yesterday near Green Park Extension at 9 a.m. ",
    "The body was recovered on {d}th January. ",
    "In the intervening night of {d}/{e} two men broke into a shop at Lake View. ",
    "A 34-year-old trader s/o Mohan K. Lal, r/o H.No. 12/B-{d}, was duped today. ",
    "He was aged about thirty-four and lived at house no {d} , Old Fort. ",
    "No reports came in. ",
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a lead sentence before the whole text: doc_id, lang, source, text, day, lead, published_at."""
    d = spread(table(spark, folder, "documents"))
    day = (F.col("doc_id") % 27 + 1).cast("int")
    lead = F.replace(
        F.replace(pick(LEADS, F.col("doc_id")), F.lit("{d}"), day.cast("string")), F.lit("{e}"), (day + 1).cast("string")
    )
    return d.select(
        "doc_id", "lang", "source", F.concat(lead, "text").alias("text"), F.col("text").alias("body"), day.alias("day"),
        F.timestamp_seconds(F.lit(1_706_000_000) + F.col("doc_id") * 3600 % 500_000).alias("published_at"),
    )


DOCUMENTS_SQL = f"""docs AS (
  SELECT doc_id, lang, source, replace(replace({pick_sql(LEADS, 'doc_id')}, '{{d}}', CAST(doc_id % 27 + 1 AS VARCHAR)), '{{e}}', CAST(doc_id % 27 + 2 AS VARCHAR)) || text AS text,
    text AS body, CAST(doc_id % 27 + 1 AS INTEGER) AS day,
    TIMESTAMP '1970-01-01' + to_seconds(1706000000 + doc_id * 3600 % 500000) AS published_at
  FROM documents)"""

NAME_ENDS = ("Nagar", "Vihar", "Enclave", "Colony", "Bagh", "Ganj", "Puri", "Kunj", "Layout", "Halli", "Vaddo", "Circle")


def _place_name(key: Column) -> Column:
    return F.concat(F.initcap("p_name"), F.lit(" "), pick(NAME_ENDS, key))


def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """Gazetteer: one entry per part."""
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        k.cast("int").alias("position"),
        pick(CITY_IDS, k).alias("city"),
        _place_name(k).alias("name"),
        F.when(k % 4 == 1, "police_station").otherwise("locality").alias("kind"),
        (pick([c.lat for c in CITIES], k) + (k % 41 - 20) * 0.004).alias("lat"),
        (pick([c.lng for c in CITIES], k) + (k % 37 - 18) * 0.004).alias("lng"),
    )


_NAME_SQL = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
GAZETTEER_SQL = f"""gazetteer AS (
  SELECT p_partkey AS position, {pick_sql(CITY_IDS, 'p_partkey')} AS city,
    {_NAME_SQL} || ' ' || {pick_sql(NAME_ENDS, 'p_partkey')} AS name,
    CASE WHEN p_partkey % 4 = 1 THEN 'police_station' ELSE 'locality' END AS kind,
    {pick_sql([c.lat for c in CITIES], 'p_partkey')} + (p_partkey % 41 - 20) * 4e-3 AS lat,
    {pick_sql([c.lng for c in CITIES], 'p_partkey')} + (p_partkey % 37 - 18) * 4e-3 AS lng
  FROM part)"""


def place_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Location inputs: documents that mention gazetteer-like names in different fields."""
    d, parts = spread(table(spark, folder, "documents")), table(spark, folder, "part")
    n = F.col("doc_id")
    total = parts.agg(F.count("*")).scalar()
    names = parts.select(F.col("p_partkey").alias("_k"), _place_name(F.col("p_partkey")).alias("_name"))
    joined = d.withColumn("_k", n * 13 % total).join(names, "_k")
    name = F.col("_name")
    return joined.select(
        n.alias("doc_id"),
        pick(CITY_IDS, n).alias("city"),
        F.when(n % 8 == 0, F.concat(F.lit("Theft near "), name)).when(n % 8 == 1, F.concat(F.lit("Case at "), name, F.lit(" police station"))).otherwise("Theft in flat").alias("title"),
        F.when(n % 8 == 2, F.array(name, F.lit("crime"))).otherwise(F.array(F.lit("crime"))).alias("keywords"),
        F.when(n % 8 == 3, F.concat(F.lit("Robbed in "), name, F.lit(". "), "text"))
        .when(n % 8 == 4, F.concat(F.lit("Team of the "), name, F.lit(" PS went to Quiet Corner. "), "text"))
        .when(n % 8 == 5, F.concat(F.lit("He lived in Quiet Corner for long. "), "text"))
        .otherwise(F.col("text")).alias("text"),
        F.when(n % 8 == 6, name).when(n % 16 == 5, "Unknown Spot").when(n % 16 == 7, "Known Spot").alias("location_text"),
        F.when(n % 32 == 8, F.lit(28.5)).alias("lat"),
        F.when(n % 32 == 8, F.lit(77.1)).alias("lng"),
    )


PLACE_TEXTS_SQL = f"""place_texts AS (
  SELECT doc_id, {pick_sql(CITY_IDS, 'doc_id')} AS city, p.name,
    CASE doc_id % 8 WHEN 0 THEN 'Theft near ' || p.name WHEN 1 THEN 'Case at ' || p.name || ' police station' ELSE 'Theft in flat' END AS title,
    CASE WHEN doc_id % 8 = 2 THEN p.name || ' , crime' ELSE 'crime' END AS keywords,
    CASE doc_id % 8 WHEN 3 THEN 'Robbed in ' || p.name || '. ' || text WHEN 4 THEN 'Team of the ' || p.name || ' PS went to Quiet Corner. ' || text
      WHEN 5 THEN 'He lived in Quiet Corner for long. ' || text ELSE text END AS text,
    CASE WHEN doc_id % 8 = 6 THEN p.name WHEN doc_id % 16 = 5 THEN 'Unknown Spot' WHEN doc_id % 16 = 7 THEN 'Known Spot' END AS location_text,
    CASE WHEN doc_id % 32 = 8 THEN 28.5e0 END AS lat, CASE WHEN doc_id % 32 = 8 THEN 77.1e0 END AS lng
  FROM documents d JOIN (SELECT position, name FROM gazetteer) p ON p.position = d.doc_id * 13 % (SELECT count(*) FROM part))"""


def geocodes(spark: SparkSession, folder: str) -> DataFrame:
    """Geocode table: one known spot per supplier, of which a few are asked for; 'quiet corner' is a known miss in goa."""
    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    key = F.when(k < 3, F.concat(pick(CITY_IDS, k), F.lit("|known spot"))).when(k == 3, "goa|quiet corner").when(k == 4, "delhi|quiet corner").otherwise(
        F.concat(pick(CITY_IDS, k), F.lit("|"), F.lower("s_name"))
    )
    hit = k != 3
    return s.select(
        key.alias("key"),
        F.when(hit, pick([c.lat for c in CITIES], F.when(k == 4, 0).otherwise(k)) + 0.01).alias("lat"),
        F.when(hit, pick([c.lng for c in CITIES], F.when(k == 4, 0).otherwise(k)) + 0.01).alias("lng"),
        F.when(hit, F.col("s_name")).alias("display_name"),
    )


GEOCODES_SQL = f"""geocodes AS (
  SELECT CASE WHEN s_suppkey < 3 THEN {pick_sql(CITY_IDS, 's_suppkey')} || '|known spot' WHEN s_suppkey = 3 THEN 'goa|quiet corner'
    WHEN s_suppkey = 4 THEN 'delhi|quiet corner' ELSE {pick_sql(CITY_IDS, 's_suppkey')} || '|' || lower(s_name) END AS key,
    CASE WHEN s_suppkey <> 3 THEN {pick_sql([c.lat for c in CITIES], 'CASE WHEN s_suppkey = 4 THEN 0 ELSE s_suppkey END')} + 1e-2 END AS lat,
    CASE WHEN s_suppkey <> 3 THEN {pick_sql([c.lng for c in CITIES], 'CASE WHEN s_suppkey = 4 THEN 0 ELSE s_suppkey END')} + 1e-2 END AS lng
  FROM supplier)"""

PAGE_CITIES = CITY_IDS
PAGE_SOURCES = ("toi", "ht", "dh")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates: every page twice, the second time under a variant of its address."""
    p = table(spark, folder, "pages")
    n = F.col("page_id")
    base = p.select(
        (n * 2).alias("seq"), "url", n.alias("n")
    ).unionByName(p.select((n * 2 + 1).alias("seq"), F.concat(F.regexp_replace("url", "^https?", "http"), F.lit("?copy=1")).alias("url"), n.alias("n")))
    i = F.col("n")
    return base.select(
        "seq",
        pick(PAGE_SOURCES, i).alias("source"),
        F.when(i % 10 == 7, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/chain-snatched-near-market-"), i.cast("string"), F.lit(".html"))).when(i % 50 == 9, "not an address").otherwise(F.col("url")).alias("url"),
        F.when(i % 10 == 7, "  ").otherwise(F.concat(pick([a for a, _ in ACTIONS], i), F.lit(" in "), pick(PLACES, i))).alias("title"),
        F.when(i % 13 != 5, F.timestamp_seconds(F.lit(1_706_659_200) - i * 86_400 % (220 * 86_400))).alias("published_at"),
        pick(PAGE_CITIES, i).alias("city"),
        F.lit(None).cast("struct<url:string,title:string,published_at:timestamp,description:string,text:string,keywords:array<string>,city:string,source_name:string>").alias("article"),
    )


CANDIDATES_SQL = f"""candidates AS (
  SELECT seq, {pick_sql(PAGE_SOURCES, 'n')} AS source,
    CASE WHEN n % 10 = 7 THEN regexp_replace(url, '[?#].*$', '') || '/chain-snatched-near-market-' || n || '.html' WHEN n % 50 = 9 THEN 'not an address' ELSE url END AS url,
    CASE WHEN n % 10 = 7 THEN '  ' ELSE {pick_sql([a for a, _ in ACTIONS], 'n')} || ' in ' || {pick_sql(PLACES, 'n')} END AS title,
    CASE WHEN n % 13 <> 5 THEN TIMESTAMP '1970-01-01' + to_seconds(1706659200 - n * 86400 % (220 * 86400)) END AS published_at,
    {pick_sql(PAGE_CITIES, 'n')} AS city
  FROM (SELECT page_id * 2 AS seq, url, page_id AS n FROM pages
        UNION ALL SELECT page_id * 2 + 1, regexp_replace(url, '^https?', 'http') || '?copy=1', page_id FROM pages))"""


def police_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Police JSON lines: one per order and customer, with every kind of gap and reject; some lines are broken."""
    # Spread before the lines are built, which is the work; counting the partitions of the join would run it.
    o, c = spread(table(spark, folder, "orders")), table(spark, folder, "customer")
    joined = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")
    n = F.col("o_orderkey")
    mention = F.struct(
        F.concat(F.lit("Desk "), F.col("c_nationkey").cast("string")).alias("source_name"),
        F.when(n % 5 == 0, "police_fir_list").alias("source_type"),
        F.when(n % 6 != 0, F.concat(F.lit("https://Police.gov.in/list?y="), (n % 30).cast("string"))).alias("url"),
        F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("published_at"),
    )
    city = pick([*CITY_IDS, "mumbai"], n)
    has_point = n % 3 != 0
    row = F.struct(
        F.concat(F.lit("ev "), n.cast("string")).alias("event_id"),
        city.alias("city"),
        F.when(n % 17 != 0, F.concat(pick([a for a, _ in ACTIONS], n), F.lit(" by "), "c_name")).alias("title"),
        F.when(n % 9 == 0, "robbery").when(n % 9 == 1, "theft cases").alias("category"),
        F.when(n % 9 == 2, "Snatching of chain").alias("category_raw"),
        F.when(n % 4 == 0, F.array(mention, mention)).when(n % 4 == 1, F.array(mention)).alias("mentions"),
        F.when(n % 19 == 0, "rumour").when(n % 2 == 0, pick(("police_press_release", "police_detection_report"), _int_div(n, 2))).alias("source_type"),
        F.when(n % 4 >= 2, F.when(n % 23 == 0, "nowhere").otherwise(F.concat(F.lit("http://police.gov.in/r/"), n.cast("string"), F.lit("?id="), (n % 7).cast("string"), F.lit("#top")))).alias("source_link"),
        F.when(n % 3 == 1, F.date_format("o_orderdate", "2023-MM-dd HH:mm")).alias("incident_datetime"),
        pick(("exact", "approx", "odd", None), n).alias("incident_datetime_precision"),
        F.when(n % 5 == 1, F.concat(F.lit("2023-11-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))).when(n % 5 == 2, "2024-01-02T03:04:05Z").when(n % 5 == 3, "soon").alias("published_datetime"),
        F.when(n % 7 != 0, F.when(n % 29 == 0, "2022-01-01").otherwise("2024-01-05")).alias("fir_datetime"),
        F.when(n % 3 == 1, pick(PLACES, n)).alias("location_text"),
        F.when(n % 6 < 2, F.concat(pick(PLACES, n), F.lit(" s/o x"))).alias("police_station"),
        F.when(has_point, F.when(n % 31 == 0, F.lit("1.5")).otherwise((pick([c_.lat for c_ in CITIES] + [19.0], n) + (n % 50) * 0.001).cast("string"))).alias("lat"),
        F.when(has_point, F.when(n % 37 == 0, F.lit("NaN")).otherwise((pick([c_.lng for c_ in CITIES] + [72.0], n) + (n % 50) * 0.001).cast("string"))).alias("lng"),
        pick(("address", "district", None, "weird"), _int_div(n, 2)).alias("geo_precision"),
        F.when(n % 3 == 0, F.concat(F.lit("Priority "), "o_orderpriority", F.lit(" , aged 40 , done"))).alias("description"),
        F.when(n % 8 == 0, F.concat(n.cast("string"), F.lit("/2024"))).alias("fir_no"),
        F.when(n % 41 == 0, F.lit(False)).alias("is_crime_incident"),
    )
    line = F.when(n % 43 == 0, F.lit("{broken")).when(n % 47 == 0, F.lit("  ")).otherwise(F.to_json(row))
    return joined.select(n.alias("seq"), line.alias("value"))


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages: the whole HTML, a third with JSON-LD, a third with meta tags, a third as it is."""
    p = table(spark, folder, "pages")
    n = F.col("page_id")
    ld = F.concat(
        F.lit('<head><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["NewsArticle"],"headline":"Theft &amp; loss '),
        n.cast("string"),
        F.lit('","datePublished":"2024-01-'), F.lpad((n % 28 + 1).cast("string"), 2, "0"),
        F.lit('T10:00:00+05:30","keywords":"crime, city ,,","description":"About <b>'), n.cast("string"), F.lit('</b>"}]}</script>'),
    )
    meta = F.concat(
        F.lit('<head><meta property="og:title" content=" Report '), n.cast("string"),
        F.lit(' "><meta name="description" content="Short &lt;text&gt;"><meta property="article:published_time" content="Mon, '),
        F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(' Jan 2024 10:00:00 +0530"><meta name="news_keywords" content="a,b">'),
    )
    body = F.when(n % 3 == 0, F.replace("html", F.lit("<head>"), ld)).when(n % 3 == 1, F.replace("html", F.lit("<head>"), meta)).otherwise(F.col("html"))
    return p.select(
        n.alias("page_id"), "url", pick(PAGE_CITIES, n).alias("city"), F.lit("Daily").alias("source_name"),
        F.when(n % 20 == 19, 404).otherwise(200).alias("status"), F.lit("html").alias("format"), body.alias("body"),
        F.lit("fallback").alias("fallback_title"),
        F.when(n % 6 == 2, F.timestamp_seconds(F.lit(1_704_067_200) + n * 60)).alias("fallback_published_at"),
    )


def iso(column: str) -> Column:
    return ist_iso(F.col(column))


def iso_sql(column: str) -> str:
    return f"strftime({column} + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30'"
