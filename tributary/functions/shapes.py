"""What a cell of a table looks like, and the years that a text names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"(?:19|20)\d{2}"


def is_percent(text: Column) -> Column:
    return F.regexp_replace(text, " ", "").rlike(r"^\(?-?\d+(\.\d+)?%\)?$")


def is_year(text: Column) -> Column:
    return F.trim(text).rlike(f"^{YEAR}$")


def is_amount_like(text: Column) -> Column:
    """Digits with thousands, a sign or brackets; neither a year nor a percentage."""
    return F.trim(text).rlike(r"^\(?-?\d[\d,]*(\.\d+)?\)?$") & ~is_year(text) & ~is_percent(text)


def year_pair(text: Column, current: Column, prior: Column) -> Column:
    """(current, prior): of two years or more the largest two; a single one replaces or precedes the current one."""
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\b({YEAR})\b")), lambda y: y.cast("int"))))
    n, largest = F.size(years), F.try_element_at(years, F.lit(-1))
    one = F.when(current.isNull() | (largest >= current), F.struct(largest.alias("current"), prior.alias("prior"))).otherwise(F.struct(current.alias("current"), largest.alias("prior")))
    return F.when(n >= 2, F.struct(largest.alias("current"), F.try_element_at(years, F.lit(-2)).alias("prior"))).when(n == 1, one).otherwise(F.struct(current.alias("current"), prior.alias("prior")))


def period_year(instant: Column, end: Column) -> Column:
    return F.year(F.coalesce(instant, end))


def period_type(instant: Column, start: Column, end: Column) -> Column:
    return F.when(instant.isNotNull(), "instant").when(start.isNotNull() & end.isNotNull(), "duration")
