"""Explicit schemas as DDL text; nothing in the library infers one."""


def _struct(spec: str) -> str:
    return " ".join(spec.split())


# The stored report. Times are instants; IST text appears only at the JSON edge.
# effective_at = incident time when one was given (null when that text was not a date),
# else published time, so range filters reach the Parquet scan.
REPORT = _struct(
    """id string, event_id string, city string, title string, category string, category_raw string,
       source_name string, source_type string, source_link string,
       incident_datetime timestamp, incident_datetime_precision string, published_datetime timestamp,
       location_text string, police_station string, lat double, lng double, geo_precision string,
       description string, effective_at timestamp"""
)

# The same record as exchanged in JSON files (ISO-8601 text with +05:30).
REPORT_JSON = _struct(
    """id string, event_id string, city string, title string, category string, category_raw string,
       source_name string, source_type string, source_link string,
       incident_datetime string, incident_datetime_precision string, published_datetime string,
       location_text string, police_station string, lat double, lng double, geo_precision string,
       description string"""
)

ARTICLE = _struct(
    """url string, title string, published_at timestamp, description string, text string,
       keywords array<string>, city string, source_name string"""
)

CANDIDATE = _struct(
    """seq bigint, source string, url string, title string, published_at timestamp, city string,
       article struct<url string, title string, published_at timestamp, description string, text string,
                      keywords array<string>, city string, source_name string>"""
)

POLICE_ROW = _struct(
    """event_id string, city string, title string, category string, category_raw string,
       legal_sections array<string>, source_link string,
       mentions array<struct<source_name string, source_type string, url string, published_at string>>,
       source_type string, source_name string, incident_datetime string, incident_datetime_precision string,
       published_datetime string, fir_datetime string, location_text string, police_station string,
       district string, lat string, lng string, geo_precision string, description string, fir_no string,
       is_crime_incident boolean"""
)

GAZETTEER = _struct("position int, city string, name string, kind string, lat double, lng double")

GEOCODE = _struct("key string, lat double, lng double, display_name string")

LANDED = _struct("source string, url string, city string, status int, format string, body string, seq bigint")

REPORT_COLUMNS = [field.split()[0] for field in REPORT_JSON.split(",")]
