"""Validation of staged text (VAL-*): all checks of a table in one aggregation.

A check names a column and a condition for bad cells.  ``issues`` counts them all
in a single pass with partial aggregation, so that only one row per task (and
group) is shuffled.  Examples come from a second pass over bad cells, cut to a few
per check before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.clean import FALSE_VALUES, TRUE_VALUES, clean_date, clean_numeric, flag_text
from ..functions.convert import LADDERS, parse_style, to_datetime, to_float, to_int
from ..functions.dates import date_order, lenient_datetime
from ..plans.paths import written
from ..plans.spec import FileTypeSpec

#: Shares of bad cells, in percent: above the first an issue, above the second a warning (fixed values).
ISSUE_ABOVE, WARNING_ABOVE = 10.0, 1.0
#: Expressions in one aggregation; more are split, for code generation's sake.
CHECKS_IN_ONE = 200


@dataclass(frozen=True)
class Check:
    kind: str
    column: str
    bad: Column
    value: Column | None = None  # what examples show; the column by default

    @property
    def shown(self) -> Column:
        return F.col(f"`{self.column}`") if self.value is None else self.value


def _of(c: str) -> Column:
    return F.col(f"`{c}`")


def percentage(bad: Column, total: Column) -> Column:
    """round(bad / total * 100, 2), 0 without rows."""
    return F.when(total > 0, F.round(bad / F.nullif(total, F.lit(0)) * 100, 2)).otherwise(F.lit(0.0))


def severity(p: Column) -> Column:
    return F.when(p > ISSUE_ABOVE, "issue").when(p > WARNING_ABOVE, "warning").otherwise("ignored")


# -- the checks ------------------------------------------------------------------


def numeric(c: str) -> Check:
    cleaned = clean_numeric(_of(c))
    return Check("numeric_validation", c, (cleaned != "") & to_float(_of(c)).isNull())


def numeric_range(c: str, least: float | None = None, most: float | None = None) -> Check:
    """Castable cells outside the bounds; without bounds nothing is bad."""
    n = to_float(_of(c))
    out = F.lit(False)
    if least is not None:
        out = out | (n < least)
    if most is not None:
        out = out | (n > most)
    return Check("numeric_range_validation", c, F.coalesce(out, F.lit(False)))


def dates(c: str, date_format: str = "UK") -> Check:
    cleaned = clean_date(_of(c))
    return Check("date_validation", c, F.nullif(cleaned, F.lit("")).isNotNull() & to_datetime(_of(c), date_format).isNull())


def lenient_dates(c: str, day_first: Column | bool = True) -> Check:
    """Cells with text that no shape of a date reads."""
    return Check("date_validation", c, F.nullif(F.trim(_of(c)), F.lit("")).isNotNull() & F.coalesce(to_datetime(_of(c)), lenient_datetime(_of(c), day_first)).isNull())


def date_range(c: str, least: str | None = None, most: str | None = None, date_format: str = "UK") -> Check:
    """Cells of the primary style outside the bounds (ISO dates)."""
    d = parse_style(clean_date(_of(c)), LADDERS[date_format][0])
    out = F.lit(False)
    if least is not None:
        out = out | (d < F.lit(least).cast("timestamp_ntz"))
    if most is not None:
        out = out | (d > F.lit(most).cast("timestamp_ntz"))
    return Check("date_range_validation", c, F.coalesce(out, F.lit(False)))


def boolean(c: str, true_values: Sequence[str] | None = None, false_values: Sequence[str] | None = None) -> Check:
    known = [*(true_values or TRUE_VALUES), *(false_values or FALSE_VALUES), ""]
    kind = "boolean_validation" if true_values is None and false_values is None else "custom_boolean_validation"
    return Check(kind, c, ~flag_text(_of(c)).isin([v.upper() for v in known]))


def pattern_to_regex(pattern: str) -> str:
    """A search pattern with % and _ wildcards and [classes], as a regular expression for the whole text."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 1) if ch == "[" else -1
        if end > 0:
            out, i = out + pattern[i : end + 1].replace("\\", "\\\\"), end
        else:
            out += {"%": ".*", "_": "."}.get(ch, "\\" + ch if ch in ".^$*+?{}\\|()[]" else ch)
        i += 1
    return f"(?s)^{out}$"


def pattern(c: str, like: str) -> Check:
    """Cells with text that doesn't match; trailing spaces don't count.

    A pattern without % and _ has to match somewhere from its own start to its end.
    """
    text = F.rtrim(_of(c))
    return Check("string_pattern_validation", c, (F.trim(_of(c)) != "") & ~text.rlike(pattern_to_regex(like)))


def required(c: str) -> Check:
    return Check("string_not_empty_validation", c, F.coalesce(F.trim(_of(c)), F.lit("")) == "")


def too_long(c: str, limit: int) -> Check:
    return Check("string_length_validation", c, F.coalesce(F.length(_of(c)) > limit, F.lit(False)), F.left(_of(c), F.lit(50)))


def null_cell(c: str) -> Check:
    return Check("null_share", c, _of(c).isNull())


def checks_for(spec: FileTypeSpec) -> list[Check]:
    """Numeric columns, then date columns, in the spec's order."""
    return [numeric(c) for c in spec.of_type("INT", "FLOAT")] + [dates(c, spec.date_format) for c in spec.of_type("DATE", "DATETIME")]


# -- the engine ------------------------------------------------------------------


def issues(df: DataFrame, checks: Sequence[Check], by: Sequence[str] = ()) -> DataFrame:
    """One row per check (and group): ``validation_type, column, total, error_count, percentage, severity``.

    Checks without bad cells are included with 0.  An empty table gives one row per
    check with total 0 (none per group if ``by`` is given).
    """
    parts = []
    for at in range(0, len(checks), CHECKS_IN_ONE):
        own = checks[at : at + CHECKS_IN_ONE]
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(k.bad).alias(f"_{i}") for i, k in enumerate(own)])
        rows = F.array(*[F.struct(F.lit(k.kind).alias("validation_type"), F.lit(k.column).alias("column"), F.col(f"_{i}").alias("error_count")) for i, k in enumerate(own)])
        parts.append(counts.select(*by, "total", F.inline(rows)))
    out = reduce(DataFrame.unionByName, parts)
    p = percentage(F.col("error_count"), F.col("total"))
    return out.select(*by, "validation_type", "column", "total", "error_count", p.alias("percentage")).withColumn("severity", severity(F.col("percentage")))


def bad_cells(df: DataFrame, checks: Sequence[Check], keep: Sequence[str] = ()) -> DataFrame:
    """Bad cells in long form: ``validation_type, column, value`` and the columns in ``keep``."""
    cells = F.array(*[F.struct(F.lit(k.kind).alias("validation_type"), F.lit(k.column).alias("column"), k.shown.cast("string").alias("value"), k.bad.alias("_bad")) for k in checks])
    return df.select(*keep, F.inline(cells)).where("_bad").drop("_bad")


def examples(df: DataFrame, checks: Sequence[Check], n: int = 3) -> DataFrame:
    """The first ``n`` distinct bad values of each check in order of value: ``validation_type, column, rank, value``."""
    distinct = bad_cells(df, checks).distinct()
    order = W.partitionBy("validation_type", "column").orderBy(F.col("value").asc_nulls_first())
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def with_examples(found: DataFrame, shown: DataFrame) -> DataFrame:
    """Issue rows with ``examples`` (an array in order of value)."""
    lists = shown.groupBy("validation_type", "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("examples"))
    return found.join(lists, ["validation_type", "column"], "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def gate(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether a table (or each group) may load: no issue and at least one row."""
    out = found.groupBy(*by).agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.count_if(F.col("severity") == "issue").alias("issues"), F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    return out.withColumn("is_valid", (F.col("issues") == 0) & (F.col("total") > 0))


def summary(found: DataFrame) -> DataFrame:
    """The gate with one line of text, and how many checks passed."""
    passed = F.count_if(F.col("severity") == "ignored")
    out = found.agg(F.count(F.lit(1)).alias("checks"), passed.alias("passed"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.count_if(F.col("severity") == "issue").alias("issues"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = out.withColumn("is_valid", (F.col("issues") == 0) & (F.col("total") > 0))
    text = F.concat(F.when(F.col("is_valid"), "valid").otherwise("invalid"), F.lit(": "), F.col("issues").cast("string"), F.lit(" issues, "), F.col("warnings").cast("string"), F.lit(" warnings"))
    rate = F.when(F.col("checks") > 0, F.round(F.col("passed") / F.nullif(F.col("checks"), F.lit(0)) * 100, 1)).otherwise(0.0)
    return out.withColumn("success_rate", rate).withColumn("summary", text)


def single_kind(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Report of one kind of check: valid only without a single bad cell."""
    found = issues(df, checks)
    bad = F.col("error_count") > 0
    return found.groupBy("validation_type").agg(F.count(F.lit(1)).alias("columns_checked"), F.count_if(bad).alias("columns_with_issues"), (F.count_if(bad) == 0).alias("is_valid"))


def load_loss(df: DataFrame, spec: FileTypeSpec) -> DataFrame:
    """Cells that pass validation but load as NULL, such as 12.5 in an INT column, by column."""
    cells = [Check("load_loss", c, to_float(_of(c)).isNotNull() & to_int(_of(c)).isNull()) for c in spec.of_type("INT")]
    return issues(df, cells)


def problem_columns(df: DataFrame, spec: FileTypeSpec, n: int = 5) -> DataFrame:
    """The first ``n`` columns of the spec with failed conversions: position, declared type, bad cells, up to three examples."""
    checks = checks_for(spec)
    where = F.create_map(*[x for i, c in enumerate(spec.targets) for x in (F.lit(c), F.struct(F.lit(i).alias("position"), F.lit(spec.type_of(c)).alias("expected_type")))])
    found = issues(df, checks).where("error_count > 0").withColumn("at", where[F.col("column")])
    found = with_examples(found, examples(df, checks))
    return found.select(F.col("at.position").alias("position"), "column", F.col("at.expected_type").alias("expected_type"), "error_count", "examples").orderBy("position").limit(n)


# -- reports of their own shape ----------------------------------------------------


def boolean_distribution(df: DataFrame, c: str) -> DataFrame:
    """``value, n, share, class``: each spelling with its share in percent; the window sees grouped rows only."""
    value = F.coalesce(F.nullif(F.trim(_of(c)), F.lit("")), F.lit("NULL/EMPTY"))
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upper = F.upper("value")
    kind = F.when(upper.isin(list(TRUE_VALUES)), "true").when(upper.isin([*FALSE_VALUES, "NULL/EMPTY"]), "false").otherwise("invalid")
    return counts.select("value", "n", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy()), 2).alias("share"), kind.alias("class"))


def string_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, total, non_null, empty, nulls, min_length, max_length, avg_length``; trailing spaces don't count, NULL is length 0."""
    aggs = []
    for i, c in enumerate(columns):
        n = F.coalesce(F.length(F.rtrim(_of(c))), F.lit(0))
        aggs += [F.count(_of(c)).alias(f"{i}a"), F.count_if(F.trim(_of(c)) == "").alias(f"{i}b"), F.min(n).alias(f"{i}c"), F.max(n).alias(f"{i}d"), F.round(F.avg(n), 2).alias(f"{i}e")]
    row = lambda i, c: F.struct(F.lit(c).alias("column"), F.col(f"{i}a").alias("non_null"), F.col(f"{i}b").alias("empty"), (F.col("total") - F.col(f"{i}a")).alias("nulls"), F.col(f"{i}c").cast("long").alias("min_length"), F.col(f"{i}d").cast("long").alias("max_length"), F.col(f"{i}e").alias("avg_length"))
    return df.agg(F.count(F.lit(1)).alias("total"), *aggs).select("total", F.inline(F.array(*[row(i, c) for i, c in enumerate(columns)])))


def high_null_share(df: DataFrame, columns: Sequence[str], other: DataFrame | None = None, above: float = 50.0) -> DataFrame:
    """``column, error_count, percentage``: columns with more than ``above`` percent NULL and no other bad cell.

    ``other``: rows of ``issues``; columns with bad cells there have a better reason already.
    """
    found = issues(df, [null_cell(c) for c in columns]).where(F.col("percentage") > above)
    if other is not None:
        found = found.join(other.where("error_count > 0").select("column").distinct(), "column", "left_anti")
    return found.select("column", "error_count", "percentage")


def comprehensive(found: DataFrame, schema_warnings: DataFrame) -> DataFrame:
    """The summary with schema findings (``severity``): ``overall_valid`` needs a valid table without schema warnings, ``can_proceed`` only a valid one."""
    extra = schema_warnings.agg(F.count_if(F.col("severity") == "warning").alias("schema_warnings"))
    out = summary(found).join(extra, F.lit(True))  # one row each
    return out.withColumn("overall_valid", F.col("is_valid") & (F.col("schema_warnings") == 0)).withColumn("can_proceed", F.col("is_valid"))


def string_lengths(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``column, max_allowed, too_long, longest``."""
    aggs = [x for i, (c, n) in enumerate(limits.items()) for x in (F.count_if(too_long(c, n).bad).alias(f"{i}a"), F.coalesce(F.max(F.length(_of(c))), F.lit(0)).alias(f"{i}b"))]
    row = lambda i, c, n: F.struct(F.lit(c).alias("column"), F.lit(n).cast("long").alias("max_allowed"), F.col(f"{i}a").alias("too_long"), F.col(f"{i}b").cast("long").alias("longest"))
    return df.agg(*aggs).select(F.inline(F.array(*[row(i, c, n) for i, (c, n) in enumerate(limits.items())])))


def duplicated_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, duplicated``: non-null values that occur more than once; values are counted before the shuffle."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _of(c).cast("string").alias("value")) for c in columns]))).where("value is not null")
    per = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("column").agg(F.count_if(F.col("n") > 1).alias("duplicated"))


def null_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, non_null, all_null`` of every column."""
    row = lambda i, c: F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("non_null"), (F.col(f"_{i}") == 0).alias("all_null"))
    return df.agg(*[F.count(_of(c)).alias(f"_{i}") for i, c in enumerate(columns)]).select(F.inline(F.array(*[row(i, c) for i, c in enumerate(columns)])))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``_row_num`` from 1 in the order of ``order``, without one task that holds all rows.

    Rows are range-partitioned and sorted; each partition's offset is the count of
    those before it, a table of one row per partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("_row_num", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def numbered_by_scan(scan: DataFrame, file: Column | str = "_metadata.file_path", start: Column | str = "_metadata.file_block_start", in_file: bool = True) -> DataFrame:
    """``_row_num`` from 1 in the order of the files' rows, while they are scanned: no row is shuffled.

    ``scan`` reads files and nothing else; ``in_file`` numbers each file by itself, else
    one after another by path.  A first pass counts the rows of each range of a file
    (only the columns needed for that are read), the counts before a range are a prefix
    sum over one row a range, and within a range rows come in order.
    """
    marked = scan.withColumns({"_file": F.col(file) if isinstance(file, str) else file, "_start": F.col(start) if isinstance(start, str) else start, "_id": F.monotonically_increasing_id()})
    per = marked.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    order = W.partitionBy("_file").orderBy("_start") if in_file else W.orderBy("_file", "_start")
    offsets = written(per, "row-counts").select("_file", "_start", (F.sum("_n").over(order) - F.col("_n") - F.col("_first") + 1).alias("_shift"))
    return marked.join(F.broadcast(offsets), ["_file", "_start"]).withColumn("_row_num", F.col("_id") + F.col("_shift")).drop("_file", "_start", "_id", "_shift")


def detail(df: DataFrame, checks: Sequence[Check], row: str, values: int = 5, rows: int = 10) -> DataFrame:
    """Per check: bad cells, percentage, the first distinct bad values, the first bad rows as a sheet numbers them (header is 1)."""
    found = issues(df, checks)
    shown = with_examples(found, examples(df, checks, values))
    order = W.partitionBy("validation_type", "column").orderBy(row)
    cells = bad_cells(df, checks, [row]).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= rows)
    lines = cells.groupBy("validation_type", "column").agg(F.sort_array(F.collect_list(F.col(row) + 1)).alias("sheet_rows"))
    return shown.join(lines, ["validation_type", "column"], "left").withColumn("sheet_rows", F.coalesce("sheet_rows", F.array().cast("array<long>")))


def date_detail(df: DataFrame, columns: Sequence[str], row: str, date_format: str = "UK", values: int = 5, rows: int = 10) -> DataFrame:
    """``detail`` of free-form dates with ``date_format_used``, the order of day and month that each column's values show."""
    order = date_order(df, columns, date_format)
    return detail(df, [lenient_dates(c) for c in columns], row, values, rows).join(F.broadcast(order.select("column", "date_format_used")), "column")  # one row for each column


def single_kind_dates(df: DataFrame, columns: Sequence[str], date_format: str = "UK") -> DataFrame:
    """``single_kind`` of date columns with ``date_format_used``: the order that most of them show, the declared one if as many show either."""
    order = date_order(df, columns, date_format).agg(F.count_if(F.col("date_format_used") == "UK").alias("uk"), F.count_if(F.col("date_format_used") == "US").alias("us"))
    used = F.when(F.col("uk") > F.col("us"), "UK").when(F.col("uk") < F.col("us"), "US").otherwise(date_format)
    return single_kind(df, [lenient_dates(c) for c in columns]).join(order.select(used.alias("date_format_used")), F.lit(True))  # one row each


def date_debug(df: DataFrame, c: str, n: int = 5) -> DataFrame:
    """The first bad cells by value with the cleaned text and what each style of the day-first ladder makes of it."""
    cleaned = clean_date(_of(c))
    bad = df.where(dates(c).bad).select(_of(c).alias("raw"), cleaned.alias("cleaned"))
    return bad.orderBy("raw").limit(n).select("raw", "cleaned", *[parse_style(F.col("cleaned"), s).alias(f"style_{s}") for s in LADDERS["UK"]])


def issue_lines(found: DataFrame) -> DataFrame:
    """Issues and warnings as text, one line each."""
    line = F.format_string("%s: %s has %d bad of %d (%s%%)", F.upper("severity"), F.col("column"), F.col("error_count"), F.col("total"), F.format_number("percentage", 2))
    return found.where("severity <> 'ignored'").select("column", line.alias("line"))
