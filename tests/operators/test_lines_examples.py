"""Lines of a small report, and retrieval against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tributary.functions.labels import normalize_label
from tributary.operators import cells, examples, lines

REPORT = """STATEMENT OF FINANCIAL POSITION

As at 31.  2024 2023
Note 2024 2023
Revenue 1,200 (300)
Trade receivables

 450.50 12
This line says something about the year, at length, and so it is a paragraph.
CASH FLOWS
7 8"""


def test_lines_of_a_report(spark):
    docs = spark.createDataFrame([(1, REPORT), (2, None), (3, ""), (None, "Stock 5")], "id long, t string")
    got = {(r.id, r.line): (r.kind, r.label, r.amounts, r.section, r.years) for r in lines.line_candidates(docs, "id", "t").collect()}
    first = "STATEMENT OF FINANCIAL POSITION"
    long = (1, 8)
    assert got.pop(long) == ("paragraph", None, None, first, "2024 2023")
    assert got.pop((1, 2)) == ("row", "As at 31.", "2024 2023", first, None)
    assert got == {
        (1, 4): ("row", "Revenue", "1,200 (300)", first, "2024 2023"),
        (1, 7): ("amounts", "Trade receivables", "450.50 12", first, "2024 2023"),
        (1, 10): ("amounts", None, "7 8", "CASH FLOWS", "2024 2023"),
        (None, 0): ("row", "Stock", "5", None, None),
    }


def test_examples_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    make = lambda n: [(i, rng.sample(words, rng.randrange(0, 12)) + ["the"] * (i % 2)) for i in range(n)]
    rows, own = make(40), make(80)
    df = lambda x, key: spark.createDataFrame(x, f"{key} int, words array<string>")
    got = {(r.r, r.e, r.n_shared, r["rank"]) for r in examples.similar_examples(df(rows, "r"), df(own, "e"), "r", "e", 0.3, 3).collect()}
    want = set()
    for r, a in rows:
        found = sorted((-len(set(a) & set(b)), e) for e, b in own if a and len(set(a) & set(b)) * 10 >= 3 * len(a))
        want |= {(r, e, -n, k) for k, (n, e) in enumerate(found[:3], 1)}
    assert got == want and want


def test_rows_that_share_a_key_keep_apart(spark):
    docs = spark.createDataFrame([(None, "HEAD\nCash 1"), (None, "Cash 2"), (7, "OTHER\nCash 3"), (7, "Cash 4")], "id int, t string")
    got = {(r.id, r.amounts): r.section for r in lines.line_candidates(docs, "id", "t").collect()}
    assert got == {(None, "1"): "HEAD", (None, "2"): None, (7, "3"): "OTHER", (7, "4"): None}


def test_blocks_of_no_kind_and_years_in_any_column(spark):
    blocks = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a"), (2, 9, None)], "g int, at int, kind string")
    got = cells.merged(blocks, ["g"], ["at"], "kind", "at", F.lit(5)).collect()
    assert sorted((r.g, r["first"], r["last"], r.kind or "", r.n) for r in got) == [(1, 1, 1, "a", 1), (1, 2, 3, "", 2), (1, 4, 4, "a", 1), (2, 9, 9, "", 1)]
    years = spark.createDataFrame([(1, 0, 3, "2024"), (1, 0, 2, "2022"), (1, 0, 2, "2021"), (1, 1, 1, "none")], "t int, c int, line int, x string")
    assert [(r.c, r.year) for r in cells.header_years(years, ["t"], "c", "x", row="line").collect()] == [(0, 2021)]


def test_note_references_go(spark):
    cases = {"Cash (note3)": "cash", "Cash note 3.1": "cash", "Notes 12a & tax": "and tax", "( Note 4 ) Trade": "trade", "noteworthy 3": "noteworthy 3", "Banknotes 5": "banknotes 5"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", normalize_label(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == cases
