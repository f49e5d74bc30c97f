"""Cleaning of text cells, Column to Column (CLN-1 to CLN-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_VALUES = ("TRUE", "Y", "YES", "1")
FALSE_VALUES = ("FALSE", "N", "NO", "0")
#: A number as text; Spark's own cast would also take '12d', 'NaN' and 'inf' (fixed value).
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"


def clean_basic(c: Column) -> Column:
    """Spaces off both ends."""
    return F.trim(c)


def clean_numeric(c: Column) -> Column:
    """Without quotes, commas and spaces; a lone dash is no value."""
    return F.nullif(F.trim(F.translate(c, '", ', "")), F.lit("-"))


def clean_date(c: Column) -> Column:
    """Tabs, line ends, no-break spaces and commas are spaces; zero-width marks go; a lone dash is no value."""
    spaced = F.translate(c, "\t\n\r\u00a0,", "     ")
    return F.nullif(F.trim(F.translate(spaced, "\ufeff\u200b\u2060", "")), F.lit("-"))


def clean_text(c: Column) -> Column:
    """Blank is no value."""
    return F.nullif(F.trim(c), F.lit(""))


def strip_to_number(c: Column) -> Column:
    """Only digits, points and dashes, as a number."""
    bare = F.regexp_replace(c, r"[^0-9.\-]", "")
    return F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast("double"))


def flag_text(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def standardize_boolean(c: Column, true_values: Sequence[str] = TRUE_VALUES, false_values: Sequence[str] = FALSE_VALUES) -> Column:
    """'1' or '0' for known spellings (blank counts as false), anything else unchanged."""
    flag = flag_text(c)
    return F.when(flag.isin([v.upper() for v in true_values]), F.lit("1")).when(flag.isin([v.upper() for v in false_values] + [""]), F.lit("0")).otherwise(c)


#: Cleaners by kind, for callers that get the kind as data.
CLEANERS = {"basic": clean_basic, "numeric": clean_numeric, "date": clean_date, "text": clean_text}


def cleaner(kind: str):
    if kind not in CLEANERS:
        raise ValueError(f"unknown cleaner {kind!r}; one of {sorted(CLEANERS)}")
    return CLEANERS[kind]
