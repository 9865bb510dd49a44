"""Scalar functions, case by case."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tributary.functions import amounts, labels, similarity

CASES = {
    amounts.amount_layout: {"1,234": "1234", "(50)": "-50", "-": "0", "--": "0", "12%": None, "RM 1,000.50": "1000.5", "USD 7": "7", "-0.00": "0", "2023": "2023", "": None, "abc": None, "(1,234.500)": "-1234.5", "—": None},
    amounts.amount_native: {"—": "0", "–": "0", "USD 7": None, "RM3": "3", "12%": None},
    amounts.amount_quality: {"2023": None, "31/12/2023": None, "1,234": Decimal("1234"), "(5)": Decimal("-5")},
    amounts.amount_shadow: {"1,234": Decimal("1234"), "1,23": None, "(7)": Decimal("-7"), "x 7": None, "-3.5": Decimal("-3.5")},
    amounts.amount_align: {"12%": Decimal("12"), "-": Decimal("0"), "−45": Decimal("-45"), "(1,000)": Decimal("-1000"), "abc": None, "–": Decimal("0")},
    amounts.amount_xbrl: {"RM 1,000.50": Decimal("1000.5"), "(50)": Decimal("-50"), "$ 9": Decimal("9"), "": None},
    amounts.amount_calc: {"(1,234.5)": -1234.5, "$ 9": 9.0, "abc": None},
}


@pytest.mark.parametrize("f", CASES, ids=lambda f: f.__name__)
def test_amounts(spark, f):
    own = CASES[f]
    rows = spark.createDataFrame([(k,) for k in own], "x string").select("x", f(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == own
    assert spark.createDataFrame([(None,)], "x string").select(f(F.col("x")).alias("y")).first().y is None


def test_amount_xbrl_out(spark):
    rows = spark.createDataFrame([("1,234.50",), ("junk",), ("(3)",), (None,)], "x string").select(amounts.amount_xbrl_out(F.col("x")).alias("y")).collect()
    assert [tuple(r.y) for r in rows] == [("1234.50", "2"), ("0", "0"), ("-3", "0"), ("0", "0")]


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("y")).first().y


def test_labels(spark):
    x = F.col("x")
    assert one(spark, labels.normalize_label(x), x="Trade & other Receivables (Note 12)") == "trade and other receivables"
    assert one(spark, labels.normalize_label(x), x="P.P.E. cost") == "ppe cost"
    assert one(spark, labels.canonical_label(x, {"cash": "Cash", "cash at bank": "Bank"}), x="Total cash at bank") == "Bank"
    assert one(spark, labels.without_prefix(x), x="Less: Tax (continued)") == "Tax"
    assert one(spark, labels.camel_words(x), x="CashAndBankIFRSBalance2") == "cash and bank ifrs balance2"
    assert one(spark, labels.note_number(x), x="see Note 7(a)") == 7 and one(spark, labels.note_number(x), x="note 100") is None
    assert one(spark, labels.roman_value(x), x="MCMXCIV") == 1994 and one(spark, labels.roman_value(x), x="IIX") is None
    assert one(spark, labels.is_generic(x), x=" Total ") and not one(spark, labels.is_generic(x), x="Total tax")
    assert one(spark, labels.local_name(x), x="a:B") == "B"
    assert one(spark, labels.jaccard(labels.tokens(x), labels.tokens(F.lit("b c d"))), x="a b c") == 0.5
    assert one(spark, labels.safe_rate(F.lit(1), x), x=0) is None and one(spark, labels.safe_rate(F.lit(1), x, 0.0), x=0) == 0.0
    assert one(spark, labels.clamp(x), x=1.7) == 0.99


def test_similarity(spark):
    rows = [("Revenue", "revenue"), ("Trade receivables", "Trade receivables net"), ("cost of sales", "sales cost"), ("abc", "xyz"), (None, "a"), ("Revenue", "revenue")]
    got = similarity.label_similarity(spark.createDataFrame(rows, "l string, r string"), "l", "r").collect()
    assert len(got) == len(rows)
    by = {(r.l, r.r): (r.similarity, r.similarity_reason) for r in got}
    assert by["Revenue", "revenue"] == (1.0, "exact") and by["Trade receivables", "Trade receivables net"] == (0.82, "contains")
    assert by["cost of sales", "sales cost"][0] == pytest.approx(0.6667) and by["abc", "xyz"][0] == 0.0
    assert similarity.with_ratio(spark.createDataFrame(rows, "l string, r string"), "l", "r").count() == len(rows)
