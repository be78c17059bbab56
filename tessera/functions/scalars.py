"""Scalar expressions: cleaning, lenient casts, dates and identifiers. All are built-in functions but the date fallback."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of boolean cells, in lower case, and the latest epoch second read as a date.
TRUE_WORDS, FALSE_WORDS, LAST_EPOCH = ("true", "yes", "1", "y"), ("false", "no", "0", "n"), 4102444800
_ISO = r"^\s*(\d{4}-\d{1,2}-\d{1,2})(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?\s*$"
_PLAIN = r"\A(?!0000)\d{4}-\d{2}-\d{2}\z"
#: Tried in this order: month before day, then day before month where the first is no month.
_FORMATS = ("M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def lowercase(c: Column) -> Column:
    return F.lower(c)


def uppercase(c: Column) -> Column:
    return F.upper(c)


def titlecase(c: Column) -> Column:
    """Capital after a blank, as in names."""
    return F.initcap(c)


def phone(c: Column) -> Column:
    """Without brackets, dashes, dots, plus signs and white space; other text stays."""
    return F.regexp_replace(c, r"[()\-\s.+]", "")


def boolean(c: Column) -> Column:
    """True, false, or null for any other word."""
    low = F.lower(c)
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def trim_all(c: Column) -> Column:
    return collapse(strip(c))


def native_date(c: Column) -> Column:
    """The date of a cell whose form is known: epoch seconds, ISO with or without time, then the listed forms; else null."""
    plain = F.when(c.rlike(_PLAIN), c.try_cast("date"))  # The most frequent form, without a parser of formats.
    seconds = F.when(c.rlike(r"\A\d+\.?\d*\z"), c.try_cast("double"))
    epoch = F.when(seconds.between(0, LAST_EPOCH), F.to_date(F.timestamp_seconds(seconds)))
    iso = F.regexp_extract(c, _ISO, 1)
    tries = [F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-M-d")))]
    tries += [F.to_date(F.try_to_timestamp(strip(c), F.lit(f))) for f in _FORMATS]
    return F.coalesce(plain, epoch, *tries)


def _leftover(day: dt.date):
    @F.pandas_udf("string")
    def parse(values: pd.Series) -> pd.Series:
        from dateutil import parser

        default = dt.datetime(day.year, day.month, day.day)

        def one(v):
            try:
                return parser.parse(v, default=default, dayfirst=False).strftime("%Y-%m-%d")
            except (ValueError, OverflowError):
                return v

        return values.map(one, na_action="ignore")

    return parse


def date_iso(c: Column, reference_date: dt.date = dt.date(2026, 2, 1), fallback: bool = True) -> Column:
    """The cell as ``yyyy-MM-dd``; what can't be read stays as it is.

    Forms beyond the native list go through an Arrow function, which gets nulls
    for cells already read. Parts that a date leaves out come from ``reference_date``.
    """
    found = F.date_format(native_date(c), "yyyy-MM-dd")
    if not fallback:
        return F.coalesce(found, c)
    return F.coalesce(found, _leftover(reference_date)(F.when(found.isNull() & (c != ""), c)), c)


# The names of the cleaning rules.


def lax_int(c: Column) -> Column:
    """A whole number, written with or without a zero fraction; else null."""
    d = c.try_cast("double")
    return F.coalesce(strip(c).try_cast("bigint"), F.when(d == F.floor(d), d.try_cast("bigint")))


def rounded_int(c: Column) -> Column:
    """The nearest whole number of a numeric cell, halves away from zero; else null."""
    return F.round(c.try_cast("double")).try_cast("int")


def safe_float(c: Column) -> Column:
    return c.try_cast("double")


def safe_int(c: Column) -> Column:
    """Cut to a whole number."""
    return c.try_cast("double").try_cast("bigint")


def safe_bool(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))


def safe_str(c: Column) -> Column:
    """Stripped; blank cells and the word null are null."""
    s = strip(c.cast("string"))
    return F.when((s != "") & (F.lower(s) != "null"), s)


def sanitize_id(c: Column) -> Column:
    """An identifier without surrounding white space, back-ticks and unprintable characters."""
    return F.regexp_replace(strip(c), r"[`\p{C}]", "")


def slug(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))


def months_between_starts(a: Column, b: Column) -> Column:
    """How many first days of a month lie between two dates."""
    return (F.year(b) * 12 + F.month(b) - F.year(a) * 12 - F.month(a)).cast("bigint")


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a).cast("bigint")


def email_or_null(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(~low.isin("n/a", "null", "none", "nan") & c.rlike(r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"), c)


def snake(c: Column) -> Column:
    s = F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))
    return F.when(s != "", s)


def unit_interval(c: Column) -> Column:
    return F.when(c.between(0, 1), c)


def not_future(c: Column, reference_date: dt.date) -> Column:
    return F.when(~F.coalesce(native_date(c) > F.lit(reference_date), F.lit(False)), c)
