"""Addresses: canonical form, headline words, report ids, police links.

Only http(s) addresses are handled; anything else counts as unusable. Host names are not
converted to punycode and dot segments are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportmill.functions.patterns import let, trimmed

# scheme, user info, host, port, path, query, fragment
_URL = r"^(?i:(https?)):[/\\]*((?:[^/\\?#@]*@)?)([^/\\?#:@\s<>^|%\[\]]+)(?::(\d*))?([/\\][^?#]*)?(\?[^#]*)?(#.*)?\z"
_PATH_UNSAFE = r"[^\x21-\x7e]|[\"<>`{}^]"
_QUERY_UNSAFE = r"[^\x21-\x7e]|[\"<>']"


_NAMES = ("scheme", "user", "host", "port", "path", "query")


def _tidy(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")


def _with_parts(url: Column, body) -> Column:
    """``body`` of the parsed address (a struct); null when it cannot be used."""

    def split(text: Column) -> Column:
        parts = F.struct(*[F.regexp_extract(text, _URL, i + 1).alias(n) for i, n in enumerate(_NAMES)])
        return F.when(text.rlike(_URL), let(parts, body))

    return let(_tidy(url), split)


def is_http_url(url: Column) -> Column:
    return F.coalesce(_tidy(url).rlike(_URL), F.lit(False))


def _percent(text: Column, unsafe: str) -> Column:
    """Percent-encodes the characters a URL serialiser would; plain text passes untouched."""
    encoded = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c),
        ),
        "",
    )
    return F.when(text.rlike(unsafe), encoded).otherwise(text)


def _path(p: Column) -> Column:
    """Path with a leading slash ('/' when the address has none)."""
    return let(
        F.replace(p["path"], F.lit("\\"), F.lit("/")),
        lambda raw: F.when(raw == "", F.lit("/")).otherwise(_percent(raw, _PATH_UNSAFE)),
    )


def _authority(p: Column, dropped_ports: Column) -> Column:
    port = F.when((p["port"] == "") | F.array_contains(dropped_ports, p["port"]), F.lit("")).otherwise(
        F.concat(F.lit(":"), p["port"])
    )
    return F.concat(p["user"], F.lower(p["host"]), port)


def _ports(p: Column, http: tuple[str, ...]) -> Column:
    """Ports that go unsaid: the scheme's default."""
    return F.when(F.lower(p["scheme"]) == "http", F.array(*map(F.lit, http))).otherwise(F.array(F.lit("443")))


def canonical_url(url: Column) -> Column:
    """https, lower-case host, no query or fragment, one trailing slash dropped; null when unusable."""

    def build(p: Column) -> Column:
        short = let(_path(p), lambda path: F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/\z", "")))
        return F.concat(F.lit("https://"), _authority(p, _ports(p, ("80", "443"))), short)

    return _with_parts(url, build)


def report_id(link: Column) -> Column:
    """First 12 hex digits of the SHA-1 of a link."""
    return F.substring(F.sha1(link), 1, 12)


def _slug_segment(p: Column) -> Column:
    def choose(parts: Column) -> Column:
        marker = F.array_position(parts, "articleshow")
        dashed = F.filter(parts, lambda s: s.contains("-"))
        longest = F.array_max(
            F.transform(dashed, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s")))
        )
        before = F.try_element_at(parts, (marker - 1).cast("int"))
        return F.when(marker > 1, before).otherwise(F.coalesce(longest["s"], F.lit("")))

    return let(F.filter(F.split(_path(p), "/"), lambda s: s != ""), choose)


def _decoded(segment: Column) -> Column:
    """Percent-decoding that keeps '+'; null for broken escapes."""
    return let(
        F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))),
        lambda out: F.when(~out.contains("\ufffd") | segment.rlike("(?i)%EF%BF%BD"), out),
    )


def _headline(segment: Column) -> Column:
    out = F.regexp_replace(segment, r"(?i)\.(html?|cms)\z", "")
    out = F.regexp_replace(out, r"-\d{5,}\z", "")
    return trimmed(F.replace(out, F.lit("-"), F.lit(" ")))


def slug_title(url: Column) -> Column:
    """Headline words of an address; null when the address or its escapes are broken."""
    return _with_parts(url, lambda p: _headline(let(_slug_segment(p), _decoded)))


def slug_title_lenient(url: Column) -> Column:
    """As above, but '' for a broken address and the raw words for broken escapes."""
    words = _with_parts(url, lambda p: _headline(let(_slug_segment(p), lambda s: F.coalesce(_decoded(s), s))))
    return F.coalesce(words, F.lit(""))


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def police_link(url: Column, source_type: Column, fir_no: Column, event_id: Column) -> Column:
    """Stored link of a police row: query kept, the incident number as fragment; null when unusable."""
    key = F.when(source_type != "news", F.coalesce(fir_no, event_id))
    fragment = F.when(F.coalesce(key, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit("#"), encode_component(trimmed(key)))
    )
    base = _with_parts(
        url,
        lambda p: F.concat(
            F.lower(p["scheme"]), F.lit("://"), _authority(p, _ports(p, ("80",))), _path(p), _percent(p["query"], _QUERY_UNSAFE)
        ),
    )
    return F.concat(base, fragment)
