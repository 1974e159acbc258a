import re

import pytest
from pyspark.sql import functions as F

from reportmill.catalog import bindings as B
from reportmill.catalog.texts import classify_documents
from reportmill.config import TAXONOMY
from reportmill.functions import names, patterns, times
from reportmill.functions import text as T
from reportmill.functions.patterns import portable, trimmed
from reportmill.sources.tables import parse_police_lines

TITLES = [
    ("Tutor accused of molesting pupil in Rohini", "sexual_crime"),
    ("Truck overturns on flyover, driver hurt", "road_accident"),
    ("Shopkeeper strangled by nephew", "murder"),
    ("Gunshot heard outside gym", "shooting"),
    ("Toddler abducted from bus stop", "kidnapping"),
    ("Digital arrest: retired clerk loses savings", "cyber_fraud"),
    ("Jeweller looted of gold bars", "robbery"),
    ("Chain-snatchers strike at dawn", "snatching"),
    ("Guard thrashed by drunk youths", "assault"),
    ("Trader gets extortion call", "extortion_organised_crime"),
    ("Agent duped buyers over plots", "fraud"),
    ("Ganja worth lakhs seized", "drugs"),
    ("Pickpockets active in fair", "burglary_theft"),
    ("Two boys drown in quarry", "drowning"),
    ("Student found hanging in room", "unnatural_death"),
    ("Wall collapses after storm", "public_safety"),
    ("Traffic diverted for parade", "other"),
]


def test_each_rule_decides_its_own_title(evaluate):
    assert evaluate(T.classify, [(t,) for t, _ in TITLES], "t string") == [c for _, c in TITLES]


def test_rules_are_ordered_and_need_whole_words(evaluate):
    rows = [("Rape accused killed in crash",), ("Man killed in crash",), ("cyberfraud ring",), ("scrapes",), (None,), ("émurder",)]
    assert evaluate(T.classify, rows, "t string") == ["sexual_crime", "road_accident", "cyber_fraud", "other", "other", "murder"]
    assert evaluate(T.classify_raw, rows, "t string") == ["rape", "crash", "cyberfraud", None, None, "murder"]


def test_groups(evaluate):
    rows = [
        ("fraud", "Hotel booking trick", None, "stay"),
        ("fraud", "Deal gone wrong", "paid a cab driver", "transport"),
        ("murder", "Hotel guest killed", None, "violent"),
        ("assault", "Hotel cab row", None, "stay"),
        ("assault", "Othello lodger trained", None, "harassment"),
        ("drugs", "Taxi driver with ganja", None, None),
        ("road_accident", "Hotel van", None, "transport"),
        ("nonsense", "x", None, None),
    ]
    got = evaluate(T.group_of, [r[:3] for r in rows], "c string, t string, d string")
    assert got == [r[3] for r in rows]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Ravi Kumar s/o Mohan Lal, r/o Lane 4, was held", "Ravi Kumar, was held"),
        ("a 34-year-old trader, aged about 34, fled", "a trader, fled"),
        ("a two-and-a-half-year-old child", "a two-and-a-half-year-old child".replace("two-and-a-half-year-old ", "")),
        ("lives at H.No. 12/B-4 , Rohini", "lives at, Rohini"),
        ("house no 7 in lane", "in lane"),
        ("Asha d/o R. K. Menon. Police said", "Asha. Police said"),
        ("s/o. Ravi left", "s/o. Ravi left".replace("s/o", "").strip()),
        ("twenty-five-year-old man", "man"),
        ("no house number here", "no house number here"),
        ("", ""),
    ],
)
def test_scrub(evaluate, raw, clean):
    assert evaluate(T.scrub_pii, [(raw,)], "t string") == [clean]


def test_scrub_survives_long_clauses(evaluate):
    body = "word " * 8000
    assert evaluate(T.scrub_pii, [(f"A s/o {body}, end",)], "t string") == ["A, end"]


def test_titles_lose_site_names(evaluate):
    rows = [
        ("Theft in flat - Hindustan Times | Latest News Delhi", "Theft in flat"),
        ("Theft | Times of India - Deccan Herald", "Theft"),
        ("Hindustan Times", "Hindustan Times"),
        ("Brawl - Times of India - more", "Brawl - Times of India - more"),
        ("Loot – Goemkarponn Desk", "Loot"),
    ]
    assert evaluate(T.clean_title, [r[:1] for r in rows], "t string") == [r[1] for r in rows]


def test_descriptions_are_cut_at_words(evaluate):
    words = ("alpha " * 60).strip()
    out = evaluate(T.clean_description, [(words,), ("x" * 400,), ("  ",), (None,), ("short.",)], "t string")
    assert out[0] == ("alpha " * 49).strip() + "…" and len(out[0]) <= 300
    assert out[1] == "x" * 299 + "…"
    assert out[2:] == [None, None, "short."]


def test_prefilter(evaluate):
    rows = [
        ("Two held with pistol", "https://n.in/a", True),
        ("Court rejects plea of robber", "https://n.in/a", False),
        ("  ", "https://n.in/city/goa/chain-snatchers-held-in-panaji/articleshow/123456.cms", True),
        (None, "https://n.in/city/goa/beach-festival-opens/articleshow/123456.cms", False),
        ("", "not an address", False),
        ("Parade today", "https://n.in/a", False),
        (None, "https://n.in/robbery%zz-in-town", True),
    ]
    assert evaluate(T.likely_incident, [r[:2] for r in rows], "t string, u string") == [r[2] for r in rows]


def test_keywords_and_labels(evaluate):
    assert evaluate(T.split_keywords, [(" a, b ,,c ",), (None,)], "t string") == [["a", "b", "c"], []]
    assert evaluate(T.label_of, [("cyber_fraud",), ("a-b__c",), ("",), (None,)], "t string") == [
        "Cyber Fraud", "A B C", "Uncategorized", "Uncategorized",
    ]


def test_portable_spells_out_classes():
    assert portable(r"a$", True) == r"(?i)a\z"
    assert r"\b" not in portable(r"\bx[\s,]\b")


def test_another_taxonomy_and_resolver(spark):
    from datetime import datetime

    from reportmill.config import Category, Taxonomy
    from reportmill.operators.enrich import enrich_articles
    from reportmill.schemas import ARTICLE

    place = "struct<location_text:string,police_station:string,lat:double,lng:double,geo_precision:string,in_area:boolean>"

    def resolve(rows, gazetteer, geocodes, key):
        found = F.struct(F.lit("Pier").alias("location_text"), F.lit(None).cast("string").alias("police_station"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), F.lit("locality").alias("geo_precision"), F.lit(True).alias("in_area"))
        return rows.withColumn("location", found.cast(place)).withColumn("unresolved", F.array().cast("array<string>"))

    own = Taxonomy(categories=(Category("boats", None, "Boats", r"boats?|ships?"), Category("rest", None, "Rest", None)), fallback="rest")
    rows = [("http://n.in/a", "Two Boats sink", datetime(2026, 5, 1), "", "", [], "goa", "N"), ("http://n.in/b", "A robbery", datetime(2026, 5, 1), "", "", [], "goa", "N")]
    got = {r.source_link: r for r in enrich_articles(spark.createDataFrame(rows, ARTICLE), None, None, taxonomy=own, resolve=resolve).collect()}
    assert [(got[u].category, got[u].category_raw, got[u].location_text) for u in sorted(got)] == [("boats", "boats", "Pier"), ("rest", None, "Pier")]


def test_ends_are_trimmed_and_words_start_as_by_the_plain_patterns(spark):
    """F12-F18: cheaper forms of the trim and of word boundaries mean the same on odd characters."""
    odd = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    texts = [odd, f"{odd}a{odd}b{odd}", "", None, "\u200bx\u200b", "\x1cx\x85", "xH.No. 5, h no 7 éh. no. 8 _h no 9 -H NO 10", "raged about five aged about five",
             "s/o X. ws/o Y, éw/o Z; S/O q", "9-year-old a9-year-old Ten-year-old often-year-old éten-year-old", "in Goa Fort, pin Goa xat Old Fort énear Hill Top", "p. s. x ps thana chaps éps"]
    texts += [f"{w} Old Fort" for w in ("in", "at", "near", "from", "of")] + [f"{w}-year-old" for w in T._NUMBER_WORD.replace("(?:\\d+|", "").split(")")[0].split("|")]
    texts += ["H/o House no 7 h no 8", "d/o A w/o B r/o C", "on 5th May on May 5", "Night of 4/5 May at 11.30 pm", "police post police chowki police station"]
    spaces = patterns._SPACES
    plain_trim = F.regexp_replace("t", f"^[{spaces}]+|[{spaces}]+\\z", "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(trimmed(F.col("t")).alias("got"), plain_trim.alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    for pattern in (T._HOUSE, T._AGE, T._RELATION, names._DOTTED_PS, names._POLICE_WORDS, names._PLACE_PHRASE, times._CLOCK, times._NIGHT, times._EXPLICIT):
        start = re.search(r"\(\?=\[([^]]+)\]\)\(\?<!\[A-Za-z0-9_\]\)", pattern)
        slow = pattern.replace(start.group(0), patterns._EDGE)
        found = rows.select(F.regexp_replace("t", pattern, "#").alias("got"), F.regexp_replace("t", slow, "#").alias("want")).collect()
        assert [r.got for r in found] == [r.want for r in found]


def test_police_lines_are_parsed_once(spark):
    """F14-F16: the parser ran for each field that was asked for."""
    lines = spark.createDataFrame([(1, ' {"title": "a", "city": "goa"} '), (2, "{broken"), (3, "  ")], "seq long, value string")
    rows = parse_police_lines(lines).select("seq", "title", "city", "invalid")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(map(tuple, rows.collect())) == [(1, "a", "goa", False), (2, None, None, True)]


def test_documents_meet_each_rule_once(spark, tmp_path):
    """classify_documents finds category and phrase in one pass over the rules."""
    rows = [(i, "en", "src0", None if i == 3 else f"x {title}.\nmore") for i, (title, _) in enumerate(TITLES)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = classify_documents(spark, str(tmp_path))
    text = B.documents(spark, str(tmp_path)).select("doc_id", T.classify(F.col("text")).alias("category"), T.classify_raw(F.col("text")).alias("phrase"))
    assert sorted(df.collect()) == sorted(text.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract(") + plan.count("rlike(") <= sum(1 for c in TAXONOMY.categories if c.words)
