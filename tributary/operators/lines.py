"""Text lines to candidates: what a line is, and the section, years and label that hold for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.shapes import YEAR

AMOUNT = r"\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?"
BLANK = r"^[ \t\r]*$"
YEARS = rf"^[^0-9]*{YEAR}[^0-9]+{YEAR}[^0-9]*$"
AMOUNTS = rf"^[ \t\r]*{AMOUNT}(?:[ \t]+{AMOUNT})*[ \t\r]*$"
ROW = rf"^[ \t\r]*([^\n]*?[^ \t\r])((?:[ \t]+{AMOUNT})+)[ \t\r]*$"
#: Longest line of years, heading and label, in characters.
SHORT = 60


def line_kind(line: Column) -> Column:
    """years, amounts, row (a label with amounts), heading (capitals only), label (short, no full stop) or paragraph."""
    short = F.length(line) <= SHORT
    kinds = F.when(short & line.rlike(YEARS), "years").when(line.rlike(AMOUNTS), "amounts").when(line.rlike(ROW), "row")
    kinds = kinds.when(short & line.rlike("[A-Z]") & ~line.rlike("[a-z]"), "heading")
    return kinds.when(short & ~line.rlike(r"[.!?][ \t\r]*$"), "label").otherwise("paragraph")


def line_candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, label, amounts, section, years) of every row, amounts line and paragraph; lines count from 0.

    Amounts that stand alone take the label of the line before, blank lines aside; a heading and a line of
    years hold until the next. Null texts have no lines. A window holds the lines of one row of docs, so
    rows that share a key, null too, keep apart.
    """
    rows = docs.select(key, F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    lines = rows.select(key, "_row", F.posexplode(F.split("_text", "\n")).alias("line", "x")).where(~F.col("x").rlike(BLANK))
    x, kind = F.col("x"), F.col("kind")
    own = lines.withColumn("kind", line_kind(x))
    w = Window.partitionBy("_row").orderBy("line")
    clean = F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")
    own = own.select(
        key,
        F.col("line").cast("long").alias("line"),
        "kind",
        "x",
        F.lag(F.when(kind == "label", clean)).over(w).alias("before"),
        F.last(F.when(kind == "heading", clean), ignorenulls=True).over(w).alias("section"),
        F.last(F.when(kind == "years", F.array_join(F.regexp_extract_all(x, F.lit(f"({YEAR})")), " ")), ignorenulls=True).over(w).alias("years"),
    )
    label = F.when(kind == "row", F.regexp_extract("x", ROW, 1)).when(kind == "amounts", F.col("before"))
    tail = F.when(kind == "row", F.regexp_extract("x", ROW, 2)).when(kind == "amounts", F.col("x"))
    amounts = F.array_join(F.regexp_extract_all(tail, F.lit(f"({AMOUNT})")), " ")
    kept = own.where(kind.isin("row", "amounts", "paragraph"))
    return kept.select(key, "line", "kind", label.alias("label"), amounts.alias("amounts"), "section", "years")
