"""HTML extraction and URL rules."""

import random
import re
from html import unescape

from reportmill.llm.html_text import extract, main_text, op5_html_text
from reportmill.llm.url_rules import RULES, judge_urls

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></ul></nav><div class="cookie-notice">We use <div>cookies</div></div><!-- <article> -->
<article><h1>Title  one</h1><p>First &amp; <b>bold
text<br>here<p>Hi.</p><div class="ad">Buy</div><form><p>Name</p></form><ul><li>x</li></ul><p title="a>b">Last &lt;p&gt;</p>
<section id="comments"><article><p>Reader says so much that it is long, really long, longer than the text</p></article></section></article>
<aside><p>Side</p></aside><footer>&copy; me</footer></body>"""


def test_article_only():
    assert main_text(PAGE) == "Title one\nFirst & bold text here\nHi.\nx\nLast <p>"


def test_page_without_article_keeps_text_between_surge_and_dive():
    page = "<body><div class=menu><a href=/>Home</a></div><h1>A title</h1><p>" + "long words " * 20 + "</p><p>Short.</p><p>" + "more words " * 20 + "</p><div id='footer'>Imprint</div><p><a href=x>Next</a></p>"
    assert main_text(page) == "A title\n" + ("long words " * 20).strip() + "\nShort.\n" + ("more words " * 20).strip()


def test_page_whose_only_article_is_a_teaser():
    body = ["long words " * 20, "Short.", "more words " * 20]
    teaser = "<article><h3><a href=/other>Another story</a></h3><p>Read on</p></article>"
    for tag in ("div", "p"):
        inner = "".join(f"<{tag}>{x}</{tag}>" for x in body)
        for page in (inner + teaser, teaser + inner):
            assert main_text(f"<body><h1>A title</h1>{page}</body>").removeprefix("A title\n") == "\n".join(x.strip() for x in body)


def test_text_beside_an_article_is_judged_by_its_own_weight():
    article = "<article><h1>T</h1><p>" + "long words " * 20 + "</p></article>"
    lead = "a lead that stands before the article and is long"
    assert main_text(f"<div>{lead}</div>{article}<div>Tags</div><div><a href=x>{lead}</a></div>") == f"{lead}\nT\n" + ("long words " * 20).strip()


STORY = "".join(f"<p>Sentence number {i} of the story tells a thing or two about it.</p>" for i in range(5))
TOLD = "\n".join(f"Sentence number {i} of the story tells a thing or two about it." for i in range(5))


def test_wrappers_named_after_side_matter_are_opened():
    for name in ("content has-sidebar", "social-layout", "notice-page", "search-results", "related-work"):
        assert main_text(f'<body><nav>Home</nav><div class="{name}">{STORY}</div></body>') == TOLD
    inner = f'<div class="cookie-notice">We use cookies here, as every site does.</div><div class="promo-story">{STORY}</div>'
    assert main_text(f'<body><div class="social-layout">{inner}</div></body>') == TOLD
    # Where there is text of its own, side matter stays out, however long.
    assert main_text(f'<body>{STORY}<div class="comments"><p>{"reader talk " * 200}</p></div></body>') == TOLD
    assert main_text(f'<body><div class="ad">{"buy this " * 30}</div><article><p>Short.</p></article></body>') == "Short."


def test_an_element_without_its_end_ends_with_its_parent():
    page = f'<article>{STORY}<p class="share">Share this<p>The last words of the story come after it.</article><div class="ad">Buy'
    assert main_text(page) == TOLD + "\nThe last words of the story come after it."
    assert main_text(f"<body><div><form><label>Name</div>{STORY}</body>") == TOLD
    assert main_text(f'<body><ul><li class="share">Share<li>{TOLD.splitlines()[0]}</ul></body>') == TOLD.splitlines()[0]


def test_pages_without_marks_give_the_same_text(spark):
    """Without article, main and all classes, the windows alone find at least 95 per cent of the text."""
    total = found = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        bare = re.sub(r"</?(article|main)[^>]*>", "", re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", row.html))
        left = main_text(bare).split("\n")
        for line in main_text(row.html).split("\n"):
            total += len(line)
            if line in left:
                left.remove(line)
                found += len(line)
    assert found >= 0.95 * total


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "<", "<article>", "<script>" * 3, "<!-- open")] == [""] * 6
    assert main_text("<article>" + "<" * 20000 + "</article>") == "<" * 20000
    assert main_text('<article><p>a</p>' + '<p x="' * 3000) .startswith("a")
    assert len(main_text("<article><p>" + "word " * 200_000)) == 999_999


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>é x</p></article>", "keep"), (1, "u", "<article><p>é x</p></article>", "keep"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(pages).collect()) == [(0, "", 0), (1, "é x", 3), (1, "é x", 3)]
    assert extract(pages.limit(0)).count() == 0


def test_query_against_a_regular_expression_reading(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op5_html_text(spark, folder).collect()}
    assert got.keys() == pages.keys()
    for page_id, page in pages.items():
        inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[page_id] == "\n".join(b for b in blocks if b)


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[2], best[3] if best else default)


def test_rules_against_brute_force(spark):
    pick = random.Random(3)
    urls = [None, "", "x", "://", "http://", "http://COM/", "http://com", "http://example.com?x://net/es/", "http://www.example.com/en/1#t", "http://xexample.com/en/", "a://b://net/es/"]
    urls += ["http://" + pick.choice(["", "www.", "a.b.", "x"]) + pick.choice(["example.com", "net", "com:80", "EXAMPLE.net", "org", "com."]) + pick.choice(["", "/", "/en/", "/es/x", "/fr", "/fr/?q", "?a/en/", "#x"]) for _ in range(200)]
    rules = [*RULES, ("org", "", "block"), ("b.example.com", "/e", "block"), ("com", "/en/x/yy", "block")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, None, "clash"), (0, None, "clash")], "page_id long, url string, rule string")
    for blocks in (1, 64):
        ruled = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, action string")
        got = judge_urls(pages, ruled, blocks=blocks).collect()
        assert len(got) == len(urls) + 2
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id] if r.page_id else None, rules)
    none = judge_urls(pages, spark.createDataFrame([], "host string, path string, action string"), "block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")}
    assert judge_urls(pages.limit(0), ruled).count() == 0
