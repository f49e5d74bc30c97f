"""Free-form dates by a grammar of their parts, and what a column says about the order of day and month (CNV-6, VAL-16).

A shape is a pattern whose groups are named parts; each is compiled to one column
expression.  Shapes of two numbers before a year are read by the order in use, and the
other way round where only that makes a date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .convert import PIVOT

#: Month and weekday names (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_SHORT = " ".join(m[:3] for m in MONTHS)
_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + r"|sept)\.?"
_DAY, _YEAR, _SHORT_YEAR, _SEP = r"(\d{1,2})", r"(\d{4})", r"(\d{4}|\d{2})", r"[/. -]"
_TIME = r"(?:[ t](\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)? ?(am|pm)?(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?)?$"
#: Shapes: the parts in the order of their groups, and the pattern before the time of day.
SHAPES: tuple[tuple[str, str], ...] = (
    ("ymd", f"^{_YEAR}{_SEP}{_DAY}{_SEP}{_DAY}"),
    ("nny", f"^{_DAY}{_SEP}{_DAY}{_SEP}{_SHORT_YEAR}"),
    ("dby", f"^{_DAY}{_SEP}?{_MONTH}{_SEP}?{_SHORT_YEAR}"),
    ("bdy", f"^{_MONTH}{_SEP}?{_DAY}{_SEP}{_SHORT_YEAR}"),
    ("ybd", f"^{_YEAR}{_SEP}?{_MONTH}{_SEP}?{_DAY}"),
    ("ymd", r"^(\d{4})(\d{2})(\d{2})"),
)
FORMATS = {"UK": True, "US": False}


def tidy_date(c: Column) -> Column:
    """Lower case, commas as spaces, without weekdays and the ending of ordinals, runs of white space as one space."""
    days = "|".join(f"{d[:3]}(?:{d[3:]})?" for d in WEEKDAYS)
    plain = F.regexp_replace(F.translate(F.lower(c), ",", " "), r"(?<=\d)(?:st|nd|rd|th)\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b(?:{days})\b\.?", ""), r"\s+", " "))


def _year(text: Column) -> Column:
    n = text.cast("int")
    full = F.when(n + 2000 > PIVOT, n + 1900).otherwise(n + 2000)
    return F.when(F.length(text) == 4, n).otherwise(full)


def _at(c: Column, parts: str, pattern: str, day_first: Column) -> Column:
    """The moment that a text of this shape names, NULL for one of another shape or without such a day or time."""
    whole = pattern + _TIME
    group = lambda i: F.regexp_extract(c, whole, i)
    number = lambda text: F.coalesce(F.nullif(text, F.lit("")).cast("int"), F.lit(0))
    found = {p: group(i + 1) for i, p in enumerate(parts) if p != "n"}
    year = _year(found["y"])
    half, hour = group(7), number(group(4))
    clock = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    make = lambda month, day: F.try_make_timestamp_ntz(year, month, day, clock, number(group(5)), F.coalesce(F.nullif(group(6), F.lit("")).cast("decimal(16,6)"), F.lit(0)))
    if parts == "nny":
        a, b = group(1).cast("int"), group(2).cast("int")
        first, second = make(b, a), make(a, b)
        moment = F.when(day_first, F.coalesce(first, second)).otherwise(F.coalesce(second, first))
    else:
        month = number(found["m"]) if "m" in found else (F.floor(F.instr(F.lit(_SHORT), F.left(found["b"], F.lit(3))) / 4) + 1).cast("int")
        moment = make(month, number(found["d"]))
    return F.when(c.rlike(whole), moment)


def lenient_datetime(c: Column, day_first: Column | bool = True) -> Column:
    """The moment that free-form text names; NULL if blank or of no shape.  The tidied text is bound once."""
    order = day_first if isinstance(day_first, Column) else F.lit(day_first)
    return F.get(F.transform(F.array(tidy_date(c)), lambda v: F.coalesce(*[_at(v, parts, pattern, order) for parts, pattern in SHAPES])), F.lit(0))


def date_order(df: DataFrame, columns: Sequence[str], date_format: str = "UK") -> DataFrame:
    """``column, day_first, month_first, date_format_used``: by the values that only one order can read, in one aggregation.

    More values that begin with a day make UK, more that begin with a month US; without
    evidence, or with as much for either, it is the declared format.
    """
    pattern = SHAPES[1][1]
    aggs = []
    for i, c in enumerate(columns):
        text = tidy_date(F.col(f"`{c}`"))
        a, b = (F.try_to_number(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit("99")) for k in (1, 2))
        aggs += [F.count_if((a > 12) & (a <= 31) & b.between(1, 12)).alias(f"{i}d"), F.count_if((b > 12) & (b <= 31) & a.between(1, 12)).alias(f"{i}m")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{i}d").alias("day_first"), F.col(f"{i}m").alias("month_first")) for i, c in enumerate(columns)])
    used = F.when(F.col("day_first") > F.col("month_first"), "UK").when(F.col("day_first") < F.col("month_first"), "US").otherwise(date_format)
    return df.agg(*aggs).select(F.inline(rows)).withColumn("date_format_used", used)
