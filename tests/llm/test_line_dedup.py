"""Line dedup against brute force, with filters from empty to full."""

import hashlib
import random

import pytest

from reportmill.llm.line_dedup import line_dedup, line_key, op10_line_dedup

LAST = (1 << 63) - 1


def brute(rows, least=10):
    """rows: (id or None, text or None) → (text, n_lines, n_dropped) of each."""
    order = lambda i: LAST if i is None else i
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), LAST), order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == order(i)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def got(spark, rows, **options):
    frame = spark.createDataFrame([(*r, n, "x", 7) for n, r in enumerate(rows)], "doc_id long, text string, at int, n_lines string, n_dropped int")
    made = sorted(line_dedup(frame, **options).collect(), key=lambda r: r["at"])
    return [(r.text, r.n_lines, r.n_dropped) for r in made]


@pytest.mark.parametrize("bits", [1 << 10, 1 << 16, 1 << 26])
def test_equals_brute_force_however_full_the_filter(spark, bits):
    pick = random.Random(bits)
    lines = [" ".join(pick.choices(["alpha", "Beta", "gämma", "δelta", "x"], k=pick.randrange(1, 6))) for _ in range(700)]
    vary = lambda line: pick.choice([line, line.upper() if line.isascii() else line, f"  {line}\t", f"{line}\r"])
    rows = [(pick.randrange(10_000), "\n".join(vary(pick.choice(lines)) for _ in range(pick.randrange(9)))) for _ in range(300)]
    assert got(spark, rows, bits=bits) == brute(rows)


def test_odd_rows(spark):
    long_line = "word " * 100_000
    rows = [
        (5, "a shared line of text"), (3, "A SHARED line of text  "), (3, "a shared line of text"), (9, "a shared line of text\nown words of nine"),  # rows of one id
        (None, "only without an id here"), (None, "only without an id here"), (2, "only without an id here"), (None, "a shared line of text"),
        (1, None), (4, ""), (6, "\n\n"), (7, long_line), (8, long_line + "\nnot so long a line"), (8, long_line + "\nnot so long a line"),
        (20, "neun äöü1"), (21, "neun äöü1"), (22, "zehn äöü12"), (23, "zehn äöü12"), (24, "ÄÖÜ äöü 12 x"), (25, "äöü äöü 12 x"),  # 9 and 10 code points; only A-Z are lowered
        (30, "twice in here, and twice\ntwice in here, and twice"), (31, "twice in here, and twice"), (32, " no ascii blank here"), (33, "no ascii blank here"),
        (-4, "below zero comes first"), (40, "below zero comes first"),
    ]
    want = brute(rows)
    assert got(spark, rows) == want and got(spark, rows, bits=1 << 10) == want
    assert [w[2] for w in want[:4]] == [1, 0, 0, 1] and want[14][2] == want[15][2] == 0 and want[17][2] == 1


def test_a_line_of_most_documents_and_empty_tables(spark):
    rows = [(i, f"the line that all of them have\nthe {i}th line of its own") for i in range(3000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(None, None)]) == [("", 1, 0)]


def test_keys():
    assert line_key(b" \tAbC \xc3\x84 \r") == b"abc \xc3\x84"


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    made = {r.doc_id: (r.kept_sha256, r.n_lines, r.n_dropped) for r in op10_line_dedup(spark, folder).collect()}
    assert made == {i: (hashlib.sha256(t.encode()).hexdigest(), n, d) for (i, _), (t, n, d) in zip(rows, brute(rows), strict=True)}
