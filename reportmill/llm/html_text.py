"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block. Menus, forms and the like become runs of blank lines, and so do the borders of an
article. Elements whose class, id or role names a side matter (a sidebar, a notice, comments) are set aside with their lines; where
too little text for a surge is left without them, as when such a name stands on a wrapper of the page, the one that holds most is
opened, and so on inwards. An element without its end tag ends with its parent. On every page a line weighs as many characters as it has outside links. Sums over sliding windows of lines then rise above
the threshold at a surge point and fall to nothing at a dive point. All lines between the two are kept, short ones included.
Where <article> and <main> hold at least half of a page's characters outside links, their lines weigh SURGE more, so that short
articles are found too; lines outside them are still judged by their own weight. Where they hold less, as teasers do, they are only
borders.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.batches import packed, unpacked

WINDOW = 3
SURGE = 40

_TOKEN = re.compile(
    r"""<!--(?:(?!-->).)*+(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
# Elements whose content is not markup, elements that never hold main text, and elements that start a block.
_RAW = frozenset("script style textarea title noscript iframe template svg math object xmp noframes".split())
_ASIDE = frozenset("nav footer aside form head button select dialog menu datalist fieldset label".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main"
    " menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments disqus cookie cookies consent gdpr notice notices"
    " menu nav navbar navigation breadcrumb breadcrumbs footer pagination share sharing social related newsletter subscribe subscription signup login popup modal overlay"
    " complementary contentinfo search dialog alert".split()
)
# Elements that end where another of the given kind begins; a paragraph ends at any block.
_SINGLE = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
_HEADER_CUES = frozenset({"header", "masthead"})


def _cues(rest: str) -> set[str]:
    return {w for _, value in _ATTRIBUTE.findall(rest) for w in re.split(r"[^a-z]+", value.lower())} if "=" in rest else set()


class _Lines:
    """The blocks of a page as lines: (text, characters outside links, inside an article, side element or -1), None for a border."""

    def __init__(self, page: str):
        self.lines: list[tuple[str, int, bool, int] | None] = []
        self.sides: list[int] = []  # the side element around each side element, or -1
        self._block: list[str] = []
        self._plain = self._links = 0
        self._open: list[tuple[str, int]] = []  # open elements, with the side element they began or -1
        self._articles, self._side, self._skip = 0, -1, 0  # _skip: depth of the element that is left out, 0 for none
        raw, at = "", 0
        for token in _TOKEN.finditer(page):
            name = (token["name"] or "").lower()
            if raw:
                if token["end"] and name == raw:
                    raw, at = "", token.end()
                continue
            if token.start() > at:
                self._say(page[at : token.start()])
            at = token.end()
            if name in _RAW:
                raw = "" if token["end"] or token["rest"].endswith("/") else name
            elif name and token["end"]:
                self._end(name)
            elif name:
                self._begin(name, token["rest"])
        if not raw and at < len(page):
            self._say(page[at:])
        self._close()

    def _say(self, text: str) -> None:
        if self._skip:
            return
        text = html.unescape(text) if "&" in text else text
        self._block.append(text)
        if not self._links:
            self._plain += len(text.strip())

    def _close(self) -> None:
        text = " ".join("".join(self._block).split())
        if text:
            self.lines.append((text, self._plain, self._articles > 0, self._side))
        self._block.clear()
        self._plain = 0

    def _begin(self, name: str, rest: str) -> None:
        if name in _BLOCK:
            self._close()
            if self._open and self._open[-1][0] in _SINGLE.get(name, ("p",)):
                self._pop()
        elif name == "br":
            self._block.append(" ")
        elif name == "a":
            self._links = 1
        if name in _VOID or rest.endswith("/") and name not in _BLOCK:
            return
        self._open.append((name, -1))
        if self._skip:
            return
        if name in _ASIDE:
            self._close()
            self._skip = len(self._open)
            self._border()
        elif name in ("article", "main"):
            self._articles += 1
            self.lines.extend([None] * WINDOW)
        elif name not in ("html", "body"):
            cues = _cues(rest)
            if cues & _CUES or not self._articles and (name == "header" or cues & _HEADER_CUES):
                self._close()
                self._open[-1] = (name, len(self.sides))
                self.sides.append(self._side)
                self._side = len(self.sides) - 1
                self._border()

    def _border(self) -> None:
        if not self._articles:
            self.lines.extend([None] * WINDOW)

    def _end(self, name: str) -> None:
        if name in _BLOCK:
            self._close()
        if name == "a":
            self._links = 0
        if any(n == name for n, _ in self._open):
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        name, side = self._open[-1]
        if side >= 0 or name in ("article", "main"):
            self._close()
        self._open.pop()
        if self._skip > len(self._open):
            self._skip = 0
        elif not self._skip and name in ("article", "main"):
            self._articles -= 1
            self.lines.extend([None] * WINDOW)
        if side >= 0:
            self._side = self.sides[side]
        return name


def _opened(lines: list[tuple[str, int, bool, int] | None], sides: list[int]) -> set[int]:
    """Side elements whose lines count, with -1 for lines outside all of them: from outside in, until there is text for a surge.

    Text of an article counts as enough, however short.
    """
    own = [0] * (len(sides) + 1)
    for line in lines:
        if line:
            own[line[3]] += line[1] + SURGE * line[2]  # the last place is for -1
    whole = own[:-1]
    for side in range(len(sides) - 1, -1, -1):  # an element comes after the one around it
        if sides[side] >= 0:
            whole[sides[side]] += whole[side]
    opened, held = {-1}, own[-1]
    while held < SURGE:
        shut = [s for s in range(len(sides)) if s not in opened and sides[s] in opened and whole[s]]
        if not shut:
            break
        most = max(shut, key=lambda s: (whole[s], -s))
        opened.add(most)
        held += own[most]
    return opened


def main_text(page: str | None) -> str:
    """The text between surge and dive points, blocks joined by line ends."""
    page_lines = _Lines(page or "")
    opened = _opened(page_lines.lines, page_lines.sides)
    lines = [x if x and x[3] in opened else None for x in page_lines.lines]
    inside, whole = sum(x[1] for x in lines if x and x[2]), sum(x[1] for x in lines if x)
    bonus = SURGE if 2 * inside >= whole else 0
    weights = [0 if x is None else x[1] + bonus * x[2] for x in lines]
    total = [0, *accumulate(weights)]
    sums = [total[min(len(weights), i + WINDOW)] - total[i] for i in range(len(weights))]
    kept, i = [], 0
    while i < len(lines):
        if sums[i] < SURGE or not weights[i]:
            i += 1
            continue
        while i < len(lines) and sums[i]:  # up to the dive
            if lines[i] is not None:
                kept.append(lines[i][0])
            i += 1
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (html, ...) with text (empty if the page has none) and n_chars, its code points.

    A null html is an empty page. White space within a block is one space. Other columns pass through, those called text or n_chars
    are replaced; repeated rows stay repeated.
    """
    row, names = packed(pages, ("text", "n_chars"))
    rows = pages.select(row.alias("_row"), F.col("html").alias("_html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_row", "text", "n_chars"])

    schema = T.StructType([rows.schema["_row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema).select(*unpacked(names), "text", "n_chars")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")


QUERIES = {"op5_html_text": (op5_html_text, None)}
