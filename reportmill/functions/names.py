"""Place names: normal form, police-station phrases, place phrases, distance."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reportmill.config import EARTH_RADIUS_KM, NOT_PLACES
from reportmill.functions.patterns import let, portable, word_start


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFKD", s))


# Abbreviations and words that only say "police station".
_DOTTED_PS = portable(word_start("p") + r"p\.\s*s\.?(?=\s|$)")
_POLICE_WORDS = portable(word_start("pt") + r"(?:police station|police post|police chowki|thana|ps)\b")


def normalize_ascii(text: Column) -> Column:
    """Normal form of text that is ASCII already."""
    out = F.regexp_replace(F.lower(text), _DOTTED_PS, " ")
    out = F.regexp_replace(out, "[^a-z0-9]+", " ")
    out = F.regexp_replace(out, _POLICE_WORDS, " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def normalize_name(text: Column) -> Column:
    """Lower-case ASCII words without marks or police words.

    Only text with non-ASCII characters goes through Python (Spark has no NFKD function); the
    rest passes the worker as null.
    """
    plain = F.coalesce(_decomposed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    return normalize_ascii(F.regexp_replace(plain, r"[\u0300-\u036f]", ""))


# A capitalised phrase before a police word; one after a preposition of place.
_STATION_PHRASE = portable(r"([A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){0,3})\s+(?:police station|police post|PS)\b")
_PLACE_PHRASE = portable(word_start("afino") + r"(?:in|at|near|from|of)\s+([A-Z][a-zA-Z'.-]+(?:\s+[A-Z][a-zA-Z'.-]+){0,3})")


def station_phrases(text: Column) -> Column:
    """Capitalised phrases that stand before a police-station word, in order."""
    return F.regexp_extract_all(text, F.lit(_STATION_PHRASE), F.lit(1))


def place_phrase(text: Column) -> Column:
    """First usable capitalised phrase after in/at/near/from/of in the first 1,500 characters."""
    phrases = F.regexp_extract_all(F.substring(text, 1, 1500), F.lit(_PLACE_PHRASE), F.lit(1))

    def vague(word: Column) -> Column:
        return F.regexp_replace(F.lower(word), "[^A-Za-z0-9_]", "").isin(*NOT_PLACES)

    def usable(words: Column) -> Column:
        keep = F.array_max(F.transform(words, lambda w, i: F.when(~vague(w), i + 1).otherwise(0)))
        joined = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), keep), " "), r"[.,]+\z", "")
        return F.when(~vague(F.element_at(words, 1)), let(joined, lambda p: F.when(F.length(p) >= 4, p)))

    usable_phrases = F.transform(phrases, lambda p: let(F.split(p, portable(r"\s+")), usable))
    return F.try_element_at(F.filter(usable_phrases, lambda p: p.isNotNull()), F.lit(1))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    d_lat, d_lng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lng / 2), 2)
    return F.asin(F.sqrt(h)) * (2 * EARTH_RADIUS_KM)
