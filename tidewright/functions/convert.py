"""Safe conversion of text to types (CNV-1 to CNV-7); what doesn't convert is NULL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import LINEAGE, FileTypeSpec
from .clean import INTEGER_PATTERN, NUMBER_PATTERN, clean_date, clean_numeric

#: Date styles: (shape of the date part, Spark pattern, two-digit year) (fixed values).
STYLES = {
    103: (r"^\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy", False),
    104: (r"^\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy", False),
    105: (r"^\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy", False),
    5: (r"^\d{1,2}-\d{1,2}-\d{2}(?!\d)", "d-M-yy", True),
    3: (r"^\d{1,2}/\d{1,2}/\d{2}(?!\d)", "d/M/yy", True),
    4: (r"^\d{1,2}\.\d{1,2}\.\d{2}(?!\d)", "d.M.yy", True),
    121: (r"^\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d", False),
    101: (r"^\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy", False),
    102: (r"^\d{1,2}\.\d{1,2}\.\d{4}", "M.d.yyyy", False),
    110: (r"^\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy", False),
}
#: Order in which styles are tried: everything accepted, and the narrow order of a strict load (fixed values).
LADDERS = {"UK": (103, 104, 105, 5, 3, 4, 121, 101), "US": (101, 102, 110, 121, 103)}
STRICT_LADDERS = {"UK": (103, 121, 101), "US": (101, 121, 103)}
TIME_SUFFIX = "[ H:mm[:ss[.SSS]]]"
#: Two-digit years above this belong to the century before.
PIVOT = 2049


def parse_style(c: Column, style: int) -> Column:
    """The cleaned text ``c`` in one style; a cheap look at its shape spares most parses."""
    shape, pattern, short = STYLES[style]
    at = F.try_to_timestamp(c, F.lit(pattern + TIME_SUFFIX)).cast("timestamp_ntz")
    if short:
        at = F.when(F.year(at) > PIVOT, at - F.make_interval(F.lit(100))).otherwise(at)
    return F.when(c.rlike(shape), at)


def to_datetime(c: Column, date_format: str = "UK", strict: bool = False) -> Column:
    """First style of the ladder that parses the cleaned text.

    The cleaned text is bound once (the single element of an array): spelled out in
    each style, it made code too large to be compiled and four times slower.
    """
    ladder = (STRICT_LADDERS if strict else LADDERS)[date_format]
    return F.get(F.transform(F.array(clean_date(c)), lambda v: F.coalesce(*[parse_style(v, s) for s in ladder])), F.lit(0))


def to_date(c: Column, date_format: str = "UK", strict: bool = False) -> Column:
    return to_datetime(c, date_format, strict).cast("date")


def to_int(c: Column) -> Column:
    cleaned = clean_numeric(c)
    return F.when(cleaned.rlike(INTEGER_PATTERN), cleaned.try_cast("int"))


def to_float(c: Column) -> Column:
    cleaned = clean_numeric(c)
    return F.when(cleaned.rlike(NUMBER_PATTERN), cleaned.try_cast("double"))


def to_text(c: Column) -> Column:
    return c


def convert(c: Column, kind: str, date_format: str = "UK", strict: bool = False) -> Column:
    """By declared type."""
    if kind == "INT":
        return to_int(c)
    if kind == "FLOAT":
        return to_float(c)
    if kind == "DATE":
        return to_date(c, date_format, strict)
    if kind == "DATETIME":
        return to_datetime(c, date_format, strict)
    return to_text(c)


def typed_select(df: DataFrame, spec: FileTypeSpec, strict: bool = False) -> DataFrame:
    """Staged text to the spec's types in one projection; lineage columns pass through.

    Other columns are dropped, whatever their names; a missing declared one is an error.
    """
    columns = [convert(F.col(f"`{c}`"), spec.type_of(c), spec.date_format, strict).alias(c) for c in spec.targets]
    return df.select(*columns, *[F.col(f.name) for f in LINEAGE if f.name in df.columns])


@F.pandas_udf(T.TimestampNTZType())
def _free_form_day_first(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda v: _free_form(v, True))


@F.pandas_udf(T.TimestampNTZType())
def _free_form_month_first(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda v: _free_form(v, False))


def _free_form(value: str | None, day_first: bool):
    from dateutil import parser

    try:
        return pd.Timestamp(parser.parse(value, dayfirst=day_first).replace(tzinfo=None)) if value and value.strip() else pd.NaT
    except (ValueError, OverflowError):
        return pd.NaT


def parse_dates_leniently(df: DataFrame, column: str, out: str, day_first: bool = True, free_form: bool = True) -> DataFrame:
    """``out``: the column by the ladder, else by the grammar of ``dates``, else by free-form parsing.

    The last only if ``free_form``: distinct leftovers go through Python and come back by
    an equi-join.  Blank or unreadable text is NULL.
    """
    from .dates import lenient_datetime

    known = F.coalesce(to_datetime(F.col(column), "UK" if day_first else "US"), lenient_datetime(F.col(column), day_first))
    if not free_form:
        return df.withColumn(out, known)
    rows = df.withColumn("_known", known).withColumn("_left", F.when(F.col("_known").isNull(), F.nullif(F.trim(F.col(column)), F.lit(""))))
    parse = _free_form_day_first if day_first else _free_form_month_first
    found = rows.where(F.col("_left").isNotNull()).select("_left").distinct().withColumn("_found", parse("_left")).where(F.col("_found").isNotNull())
    return rows.join(found, "_left", "left").withColumn(out, F.coalesce("_known", "_found")).drop("_known", "_left", "_found")
