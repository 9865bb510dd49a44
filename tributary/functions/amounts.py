"""Eight grammars for amounts in text. They differ on purpose: each stage has its own idea of a number.

All take and give Columns. Decimals are DECIMAL(38,6); text results keep the digits as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,6)"
#: An amount token: optional sign or parentheses, grouped or plain digits, an optional fraction.
TOKEN = r"^\(?-?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?\)?$"


def _trim(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def _plain(digits: Column) -> Column:
    """Digits without trailing zeros of a fraction, and without a bare point; -0 is 0."""
    short = F.when(digits.contains("."), F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", "")).otherwise(digits)
    return F.when(short.rlike(r"^-?0*$"), F.lit("0")).otherwise(short)


def _signed(text: Column, strip: str) -> Column:
    """A full amount with one of the given marks before it; parentheses or a leading minus negate."""
    bare = F.regexp_replace(F.regexp_replace(text, strip, ""), r"[\s,]", "")
    negative = bare.rlike(r"^\(.*\)$") | bare.startswith("-")
    digits = F.regexp_replace(bare, r"[()\-]", "")
    full = bare.rlike(r"^(-?\d+(\.\d+)?|\(-?\d+(\.\d+)?\))$")
    return F.when(full, _plain(F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits)))


def amount_layout(x: Column) -> Column:
    """Text. Dashes are zero; RM, MYR, USD and $ go; a percentage is null."""
    t = _trim(x)
    return F.when(t.isin("-", "--"), F.lit("0")).when(t.contains("%"), F.lit(None)).otherwise(_signed(t, r"(?i)\b(RM|MYR|USD)\b|(?i)RM|\$"))


def amount_native(x: Column) -> Column:
    """Text. As for layouts, but long dashes are zero too and USD stays (so it is no amount)."""
    t = _trim(x)
    return F.when(t.isin("-", "--", "–", "—"), F.lit("0")).when(t.contains("%"), F.lit(None)).otherwise(_signed(t, r"(?i)RM|MYR|\$"))


def amount_quality(x: Column) -> Column:
    """Decimal. What looks like a year or a date is null."""
    t = _trim(x)
    dated = t.rlike(r"^(19|20)\d{2}$") | t.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}$")
    return F.when(dated, F.lit(None)).otherwise(_signed(t, r"(?i)RM|MYR|USD|\$")).try_cast(DECIMAL)


def amount_shadow(x: Column) -> Column:
    """Decimal. The text must be an amount token as a whole."""
    t = _trim(x)
    digits = F.regexp_replace(t, r"[(),\-]", "")
    negative = t.startswith("(") | t.contains("-")
    return F.when(t.rlike(TOKEN), F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits)).try_cast(DECIMAL)


def amount_align(x: Column) -> Column:
    """Decimal. Every dash is a minus, then all but digits, points and the sign is dropped; a lone dash is 0."""
    t = F.regexp_replace(_trim(x), "[−‐‑‒–—]", "-")
    negative = t.rlike(r"^\(.*\)$") | t.startswith("-")
    digits = F.regexp_replace(t, r"[^0-9.]", "")
    return F.when(t == "-", F.lit("0")).otherwise(F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits)).try_cast(DECIMAL)


def amount_xbrl(x: Column) -> Column:
    """Decimal. Leading letters and $ go, (x) is -x, other characters are dropped."""
    t = F.regexp_replace(_trim(x), r"^[A-Za-z$\s]+", "")
    t = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
    return F.regexp_replace(t, r"[^0-9.\-]", "").try_cast(DECIMAL)


def amount_calc(x: Column) -> Column:
    """Double. Parentheses negate; separators, currency marks and spaces go."""
    t = F.regexp_replace(_trim(x), r"(?i)RM|MYR|USD|[$,\s]", "")
    return F.regexp_replace(t, r"^\((.*)\)$", "-$1").try_cast("double")


def amount_xbrl_out(x: Column) -> Column:
    """Struct of value and decimals, both text. What can't be parsed is a silent zero, ("0", "0")."""
    t = F.regexp_replace(F.regexp_replace(_trim(x), r"(?i)RM|MYR|USD|[$,\s]", ""), r"^\((.*)\)$", "-$1")
    good = t.rlike(r"^-?\d+(\.\d+)?$")
    decimals = F.when(good & t.contains("."), F.length(F.regexp_extract(t, r"\.(\d+)$", 1)).cast("string")).otherwise(F.lit("0"))
    return F.struct(F.when(good, t).otherwise(F.lit("0")).alias("value"), decimals.alias("decimals"))


def value_pattern(x: Column) -> Column:
    """The shape of a number: digits as 9, letters as A."""
    return F.regexp_replace(F.regexp_replace(_trim(x), r"\d", "9"), r"[A-Za-z]", "A")
