"""Tables and lines of a page: cell matrices, header years, trailing amounts, merged blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.shapes import YEAR


def matrix(cells: DataFrame, keys: list[str], column: str, text: str) -> DataFrame:
    """Per row of a table, its cells in the order of their columns (the width of a table bounds a row)."""
    own = F.array_sort(F.collect_list(F.struct(F.col(column).alias("at"), F.col(text).alias("text"))))
    return cells.groupBy(*keys).agg(own.alias("x")).select(*keys, F.col("x.text").alias("cells"))


def header_years(cells: DataFrame, keys: list[str], column: str, text: str, row: str = "row") -> DataFrame:
    """(keys, column, year): the year that the first cell of a column to name one names; of cells in one row the earliest year."""
    year = F.regexp_extract(text, rf"\b({YEAR})\b", 1)
    return cells.where(year != "").groupBy(*keys, column).agg(F.min_by(year.cast("int"), F.struct(row, year)).alias("year"))


def trailing_amounts(line: Column) -> Column:
    """(label, amounts): the amounts at the end of a line, and what stands before them."""
    amount = r"\(?-?\d[\d,]*(?:\.\d+)?\)?"
    tail = F.regexp_extract(line, rf"((?:\s+{amount})+)\s*$", 1)
    return F.struct(F.trim(F.left(line, F.length(F.rtrim(line)) - F.length(F.rtrim(tail)))).alias("label"), F.regexp_extract_all(tail, F.lit(f"({amount})")).alias("amounts"))


def merged(blocks: DataFrame, keys: list[str], order: list[str], same: str, at: str, gap: Column) -> DataFrame:
    """Consecutive blocks of one kind (null is one) that are no further apart than the gap become one block."""
    w = Window.partitionBy(*keys).orderBy(*order)
    apart = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(False))
    new = ((F.row_number().over(w) == 1) | ~F.lag(same).over(w).eqNullSafe(F.col(same)) | apart).cast("int")
    own = blocks.withColumn("_new", new).withColumn("_block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*keys, "_block").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.first(same).alias(same), F.count("*").alias("n")).drop("_block")


def embedded_json(text: Column) -> Column:
    """The flat JSON object inside a text, or null."""
    found = F.regexp_extract(text, r"(\{[^{}]*\})", 1)
    return F.when(found != "", found)
