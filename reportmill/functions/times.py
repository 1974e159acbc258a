"""Instants and Indian Standard Time. Sessions must run in UTC (see session.apply_settings).

Calendar arithmetic works on day numbers, so impossible days roll over (30 February is 1 or
2 March) instead of raising, and nothing depends on ANSI mode.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportmill.config import WINDOW_DAYS
from reportmill.functions.patterns import let, portable, trimmed, whole_words, word_start

IST_SECONDS = 19_800
DAY_SECONDS = 86_400

# Names in calendar order.
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def window_start(now: datetime) -> datetime:
    return now - timedelta(days=WINDOW_DAYS)


def instant(moment: datetime) -> Column:
    """Literal instant; a naive datetime is taken as UTC."""
    text = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    if moment.utcoffset():
        text = (moment - moment.utcoffset()).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(f"{text}Z").cast("timestamp")


def to_ist(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "+05:30")


def ist_iso(ts: Column) -> Column:
    return F.date_format(to_ist(ts), "yyyy-MM-dd'T'HH:mm:ss'+05:30'")


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ist_day(ts: Column) -> Column:
    return F.to_date(to_ist(ts))


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date; ``day`` may run past the month's end."""

    def count(ym: Column) -> Column:
        y, m = ym["y"], ym["m"]
        leap = F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
        return (y * 365 + leap + F.floor((m * 153 + 2) / 5) + day - 1 - 719_468).cast("long")

    shifted = F.struct(
        (year - F.when(month <= 2, 1).otherwise(0)).alias("y"),
        F.when(month > 2, month - 3).otherwise(month + 9).alias("m"),
    )
    return let(shifted, count)


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros.cast("long"))


_ISO = portable(r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6})\d*)?)?(?:\s*([Zz]|[+-]\d{2}:?\d{2}))?)?$")
_RFC = portable(
    r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?,?\s+(\d{4})(?:\s+(\d{2}):(\d{2})(?::(\d{2}))?)?"
    r"(?:\s*(GMT|UTC|UT|Z|EST|EDT|CST|CDT|MST|MDT|PST|PDT|[+-]\d{2}:?\d{2}))?$"
)
# Zone names of RFC 822 dates, in minutes east of Greenwich.
_ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def _offset_minutes(zone: Column, default: Column) -> Column:
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = _int(F.substring(digits, 1, 2)) * 60 + _int(F.substring(digits, 3, 2))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in _ZONES.items() for x in kv]), F.upper(zone))
    return (
        F.when(zone == "", default)
        .when(zone.startswith("-"), -minutes)
        .when(zone.startswith("+"), minutes)
        .otherwise(named)
    )


def _instant_of(y: Column, m: Column, d: Column, hh: Column, mm: Column, ss: Column, frac: Column, offset: Column) -> Column:
    zero = F.lit(0)
    fields = F.struct(
        _int(y).alias("y"), _int(m).alias("m"), _int(d).alias("d"),
        F.coalesce(_int(hh), zero).alias("h"), F.coalesce(_int(mm), zero).alias("mi"), F.coalesce(_int(ss), zero).alias("s"),
        F.coalesce(F.rpad(frac, 6, "0").try_cast("long"), F.lit(0).cast("long")).alias("us"), offset.alias("off"),
    )

    def build(f: Column) -> Column:
        seconds = day_number(f["y"], f["m"], f["d"]) * DAY_SECONDS + f["h"] * 3600 + f["mi"] * 60 + f["s"] - f["off"] * 60
        valid = f["m"].between(1, 12) & f["d"].between(1, 31) & (f["h"] <= 23) & (f["mi"] <= 59) & (f["s"] <= 59)
        return F.when(valid, _from_micros(seconds * 1_000_000 + f["us"]))

    return let(fields, build)


def parse_iso(text: Column, date_offset: int = 0, local_offset: int = 0) -> Column:
    """ISO date or date-time; offsets (minutes) are for text without one. Null when it is not one."""

    def read(t: Column) -> Column:
        g = [F.regexp_extract(t, _ISO, i) for i in range(9)]
        zone = F.when(g[4] == "", F.lit(date_offset)).otherwise(_offset_minutes(g[8], F.lit(local_offset)))
        return F.when(t.rlike(_ISO), _instant_of(*g[1:8], zone))

    return let(text, read)


def _parse_rfc(text: Column) -> Column:
    def read(t: Column) -> Column:
        g = [F.regexp_extract(t, _RFC, i) for i in range(8)]
        month = _month_index(g[2]).cast("string")
        zone = _offset_minutes(g[7], F.lit(0))
        return F.when(t.rlike(_RFC), _instant_of(g[3], month, g[1], g[4], g[5], g[6], F.lit(""), zone))

    return let(text, read)


def parse_feed_date(text: Column) -> Column:
    """ISO or RFC 822 date of a feed or page; null when it is neither."""
    return let(trimmed(text), lambda t: F.coalesce(parse_iso(t), _parse_rfc(t)))


def parse_police_date(text: Column) -> Column:
    """Police dates are Indian time unless they carry an offset."""
    return let(trimmed(text), lambda t: F.coalesce(parse_iso(t, 330, 330), _parse_rfc(t)))


def effective_time(incident: Column, published: Column) -> Column:
    """First non-null text decides; if it is not a date the row has no effective time."""
    return parse_iso(F.coalesce(incident, published))


# Phrases that date an incident.
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_ORDINAL = r"(?:st|nd|rd|th)?"
_EXPLICIT = portable(rf"{word_start('o')}on\s+(?:(\d{{1,2}}){_ORDINAL}\s+{_MONTH}|{_MONTH}\s+(\d{{1,2}}){_ORDINAL})\b", ignore_case=True)
_NIGHT = portable(
    rf"{word_start('n')}night\s+of\s+(\d{{1,2}}){_ORDINAL}\s*[/&-]\s*(\d{{1,2}})(?!\d){_ORDINAL}"
    rf"(?:[./-](\d{{1,2}})(?:[./-](\d{{4}}|\d{{2}}))?(?!\d)|\s+{_MONTH}(?:,?\s+(\d{{4}}))?)?",
    ignore_case=True,
)
_WEEKDAY = whole_words("|".join(WEEKDAYS))
_YESTERDAY = whole_words("yesterday|last night|previous night|intervening night")
_TODAY = whole_words("today|this morning|this afternoon|earlier in the day|tonight")
_CLOCK = portable(word_start("0-9") + r"(\d{1,2})(?:[.:](\d{2}))?\s*(a\.?m\.?|p\.?m\.?)(?=[\s,.;)]|$)", ignore_case=True)
_LEAD = 1500


def _month_index(name: Column) -> Column:
    """1-12 from a month name or its first letters; null for ''."""
    found = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(name != "", found.cast("int"))


def _night_day(phrase: Column, pub: Column) -> Column:
    """Day number of 'night of 20/21 [month [year]]', or null. ``pub`` holds day, year, month."""
    g = [F.regexp_extract(phrase, _NIGHT, i) for i in range(7)]
    year_text = F.when(g[4] != "", g[4]).otherwise(g[6])
    given = F.struct(
        _int(g[1]).alias("first"),
        _int(g[2]).alias("second"),
        F.coalesce(_int(g[3]), _month_index(g[5])).alias("month"),
        F.when(F.length(year_text) == 2, _int(year_text) + 2000).otherwise(_int(year_text)).alias("year"),
    )

    def place(n: Column) -> Column:
        future = day_number(pub["year"], F.coalesce(n["month"], pub["month"]), n["first"]) > pub["day"]
        back = F.when(future, 1).otherwise(0)
        # No month: the publication month, or the one before when that day is still to come.
        # Month but no year: this year, or last year when that day is still to come.
        wraps = pub["month"] - back < 1
        open_month = F.when(wraps, F.lit(12)).otherwise(pub["month"] - back)
        open_year = F.when(wraps, pub["year"] - 1).otherwise(pub["year"])
        return F.struct(
            F.coalesce(n["month"], open_month).alias("m"),
            F.when(n["month"].isNull(), open_year).otherwise(F.coalesce(n["year"], pub["year"] - back)).alias("y"),
            n["first"].alias("d"),
            ((n["second"] == n["first"] + 1) | (n["second"] == 1)).alias("pair"),
        )

    def check(c: Column) -> Column:
        december = c["m"] == 12
        next_month = day_number(
            F.when(december, c["y"] + 1).otherwise(c["y"]), F.when(december, F.lit(1)).otherwise(c["m"] + 1), F.lit(1)
        )
        day = day_number(c["y"], c["m"], c["d"])
        return F.when(c["pair"] & c["d"].between(1, 31) & c["m"].between(1, 12) & (day < next_month), day)

    return F.when(phrase != "", let(given, lambda n: let(place(n), check)))


def _explicit_day(phrase: Column, pub: Column) -> Column:
    """Day number of 'on 11th September' / 'on September 11', or null."""
    g = [F.regexp_extract(phrase, _EXPLICIT, i) for i in range(5)]
    given = F.struct(
        F.coalesce(_int(g[1]), _int(g[4])).alias("d"), F.coalesce(_month_index(g[2]), _month_index(g[3])).alias("m")
    )

    def place(n: Column) -> Column:
        this_year = day_number(pub["year"], n["m"], n["d"])
        last_year = day_number(pub["year"] - 1, n["m"], n["d"])
        return F.when(n["d"].between(1, 31), F.when(this_year > pub["day"], last_year).otherwise(this_year))

    return F.when(phrase != "", let(given, place))


def _clock_seconds(clock: Column) -> Column:
    """Seconds after midnight of '11.30pm', or null."""
    given = F.struct(
        _int(F.regexp_extract(clock, _CLOCK, 1)).alias("h"),
        F.coalesce(_int(F.regexp_extract(clock, _CLOCK, 2)), F.lit(0)).alias("m"),
        F.lower(F.regexp_extract(clock, _CLOCK, 3)).startswith("p").alias("pm"),
    )

    def read(t: Column) -> Column:
        hour = t["h"] % 12 + F.when(t["pm"], 12).otherwise(0)
        return F.when(t["h"].between(1, 12) & (t["m"] <= 59), hour * 3600 + t["m"] * 60)

    return F.when(clock != "", let(given, read))


def incident_time(text: Column, published: Column) -> Column:
    """struct(incident_at, precision) read from the first 1,500 characters of an article."""
    local = to_ist(published)
    found = lambda lead: F.struct(
        F.regexp_extract(lead, _NIGHT, 0).alias("night"),
        F.regexp_extract(lead, _EXPLICIT, 0).alias("explicit"),
        F.lower(F.regexp_extract(lead, _WEEKDAY, 0)).alias("weekday"),
        lead.rlike(_YESTERDAY).alias("yesterday"),
        lead.rlike(_TODAY).alias("today"),
        F.regexp_extract(lead, _CLOCK, 0).alias("clock"),
        F.struct(
            F.unix_date(F.to_date(local)).cast("long").alias("day"),
            F.year(local).alias("year"),
            F.month(local).alias("month"),
            (F.dayofweek(local) - 1).alias("weekday"),
        ).alias("pub"),
    )

    def days(f: Column) -> Column:
        target = F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), f["weekday"]) - 1
        back = F.pmod(f["pub"]["weekday"] - target, F.lit(7))
        today = f["pub"]["day"]
        return F.struct(
            _night_day(f["night"], f["pub"]).alias("night"),
            F.coalesce(
                _explicit_day(f["explicit"], f["pub"]),
                F.when(f["weekday"] != "", today - back),
                F.when(f["yesterday"], today - 1),
                F.when(f["today"], today),
            ).alias("day"),
            _clock_seconds(f["clock"]).alias("clock"),
        )

    def result(d: Column) -> Column:
        night = d["night"].isNotNull()
        seconds = F.when(night, F.lit(0)).otherwise(F.coalesce(d["clock"], F.lit(0)))
        at = F.coalesce(d["night"], d["day"]) * DAY_SECONDS - IST_SECONDS + seconds
        precision = (
            F.when(night, F.lit("date_range"))
            .when(d["day"].isNull(), F.lit("unknown"))
            .when(d["clock"].isNotNull(), F.lit("exact"))
            .otherwise(F.lit("date"))
        )
        return F.struct(_from_micros(at * 1_000_000).alias("incident_at"), precision.alias("precision"))

    empty = F.struct(F.lit(None).cast("timestamp").alias("incident_at"), F.lit("unknown").alias("precision"))
    lead = F.substring(text, 1, _LEAD)
    return F.when(text.isNull(), empty).otherwise(let(lead, lambda t: let(found(t), lambda f: let(days(f), result))))
