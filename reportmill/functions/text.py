"""Row-local text rules: category, display group, personal-data removal, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportmill.config import ARREST_WORDS, EXCLUDE_WORDS, MAX_DESCRIPTION, TAXONOMY, Taxonomy
from reportmill.functions.patterns import let, portable, trimmed, whole_words, word_start
from reportmill.functions.urls import slug_title_lenient


def classify(text: Column, taxonomy: Taxonomy = TAXONOMY) -> Column:
    """Id of the first rule that matches, else the fallback category."""
    rules = [F.when(text.rlike(whole_words(c.words)), F.lit(c.id)) for c in taxonomy.categories if c.words]
    return F.coalesce(*rules, F.lit(taxonomy.fallback))


def classify_raw(text: Column, taxonomy: Taxonomy = TAXONOMY) -> Column:
    """The phrase that decided the category, lower-cased; null when no rule matched."""
    rules = [F.nullif(F.regexp_extract(text, whole_words(c.words), 0), F.lit("")) for c in taxonomy.categories if c.words]
    return F.lower(F.coalesce(*rules))


def classified(text: Column, taxonomy: Taxonomy = TAXONOMY) -> Column:
    """(category, phrase) in one pass over the rules: each runs once and only until one matches."""

    def hit(identifier: str, words) -> Column:
        found = F.regexp_extract(text, whole_words(words), 0)
        return let(found, lambda p: F.when(p != "", F.struct(F.lit(identifier).alias("category"), F.lower(p).alias("phrase"))))

    none = F.struct(F.lit(taxonomy.fallback).alias("category"), F.lit(None).cast("string").alias("phrase"))
    return F.coalesce(*[hit(c.id, c.words) for c in taxonomy.categories if c.words], none)


def base_group(category: Column, taxonomy: Taxonomy = TAXONOMY) -> Column:
    pairs = [F.lit(x) for item in taxonomy.base_group().items() for x in item]
    return F.element_at(F.create_map(*pairs), category)


def group_of(category: Column, title: Column, description: Column, taxonomy: Taxonomy = TAXONOMY) -> Column:
    """Display group; keyword overrides apply only to the overridable base groups."""
    base = base_group(category, taxonomy)
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    may_override = base.isin(*taxonomy.overridable)
    chain = [F.when(may_override & text.rlike(whole_words(words)), F.lit(group)) for group, words in taxonomy.overrides]
    return F.coalesce(*chain, base)


# Personal-data patterns, applied in this order.
_NUMBER_WORD = (
    r"(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen"
    r"|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)"
    r"(?:-(?:one|two|three|four|five|six|seven|eight|nine))?"
)
_HOUSE = portable(word_start("h") + r"(?:h\.?\s?no\b\.?|house\s+no\b\.?)\s*(?=[\w/-]*\d)[\w/-]+", ignore_case=True)
_AGE = portable(
    rf"{word_start('0-9aefnost')}(?:aged\s+(?:about\s+)?{_NUMBER_WORD}|{_NUMBER_WORD}-(?:and-a-half-)?(?:years?|months?)-old)\b", ignore_case=True
)
# A relation clause runs to the next , . or ; but steps over the dot of a single-letter initial. The look-behind
# keeps it a flat loop: a repeated alternation would use a stack frame per character on long texts.
_RELATION = portable(word_start("sdwr") + r"[sdwr]/o\b(?:[^,.;]+(?:(?<=(?<![A-Za-z0-9_])[a-z])\.[^,.;]*)*)?", ignore_case=True)
_SPACE_RUN = portable(r"\s+")
_SPACE_BEFORE_MARK = portable(r"\s+([,.;])")
_COMMA_RUN = portable(r",(\s*,)+")


def scrub_pii(text: Column) -> Column:
    """Removes house numbers, ages and relation clauses, then tidies spaces and commas."""
    for pattern in (_HOUSE, _AGE, _RELATION):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, _SPACE_RUN, " ")
    text = F.regexp_replace(text, _SPACE_BEFORE_MARK, "$1")
    text = F.regexp_replace(text, _COMMA_RUN, ",")
    text = F.regexp_replace(text, r",([.;])", "$1")
    return trimmed(text)


# Site names that pages append to the headline; several may follow one another.
_SITE_SUFFIXES = portable(
    r"(?:\s+[|–—-]\s+(?:latest news\b.*|hindustan times|times of india|the times of india|deccan herald"
    r"|goemkarponn\b.*))+$",
    ignore_case=True,
)


def clean_title(title: Column) -> Column:
    return trimmed(F.regexp_replace(scrub_pii(title), _SITE_SUFFIXES, ""))


def clean_text(text: Column) -> Column:
    return F.nullif(scrub_pii(text), F.lit(""))


def clean_description(text: Column, limit: int = MAX_DESCRIPTION) -> Column:
    """Scrubbed text of at most ``limit`` characters, cut at a word where that keeps over 60 %."""

    def shorten(cut: Column) -> Column:
        last_space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
        kept = F.when(last_space > limit * 0.6, F.substring(cut, F.lit(1), last_space)).otherwise(cut)
        return F.concat(F.regexp_replace(kept, portable(r"[\s,;:.-]+$"), ""), F.lit("…"))

    def fit(whole: Column) -> Column:
        short = let(F.substring(whole, 1, limit - 1), shorten)
        return F.when(F.length(whole) <= limit, F.nullif(whole, F.lit(""))).otherwise(short)

    return let(scrub_pii(F.coalesce(text, F.lit(""))), fit)


def likely_incident(title: Column, url: Column, taxonomy: Taxonomy = TAXONOMY) -> Column:
    """Headline test made before a page is fetched; a blank title is replaced by the words of the address."""

    def wanted(text: Column) -> Column:
        hit = (classify(text, taxonomy) != taxonomy.fallback) | text.rlike(whole_words(ARREST_WORDS))
        return (text != "") & ~text.rlike(whole_words(EXCLUDE_WORDS)) & hit

    has_title = F.coalesce(title.rlike(portable(r"[^\s]")), F.lit(False))
    return let(F.when(has_title, title).otherwise(slug_title_lenient(url)), wanted)


def split_keywords(joined: Column) -> Column:
    """Comma list → trimmed non-empty words."""
    return keyword_list(F.split(F.coalesce(joined, F.lit("")), ","))


def keyword_list(words: Column) -> Column:
    return F.filter(F.transform(words, trimmed), lambda w: w != "")


def label_of(identifier: Column) -> Column:
    """Words of an id with capitals, for display."""
    spaced = trimmed(F.regexp_replace(identifier, "[_-]+", " "))
    titled = F.array_join(
        F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "
    )
    return F.when(F.coalesce(identifier, F.lit("")) == "", F.lit("Uncategorized")).otherwise(titled)
