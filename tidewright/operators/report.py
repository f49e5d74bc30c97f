"""Load reports, file checks and column profiles (RPT-*, PRF-1)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGE_FILE = 100 * 1024 * 1024


def load_summary(results: DataFrame) -> DataFrame:
    """Per file type and over all ('ALL'): files, successes, failures, seconds, success rate in percent.

    Without files there is one row, 'ALL' with zeros.
    """
    ok = F.count_if(F.col("status") == "success")
    n = F.count(F.lit(1))
    aggs = [n.alias("files"), ok.alias("successes"), (n - ok).alias("failures"), F.round(F.coalesce(F.sum("elapsed_s"), F.lit(0.0)), 3).alias("elapsed_s"), F.when(n > 0, F.round(ok / F.nullif(n, F.lit(0)) * 100, 1)).otherwise(0.0).alias("success_rate")]
    return results.groupBy("file_type").agg(*aggs).unionByName(results.agg(*aggs).withColumn("file_type", F.lit("ALL")))


def rows_per_file(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """``filename, file_type, size_mb, rows``: files without rows show 0."""
    counts = rows.groupBy(F.col("_source_file").alias("filename")).agg(F.count(F.lit(1)).alias("rows"))
    joined = inventory.join(counts, "filename", "left")
    return joined.select("filename", "file_type", F.round(F.col("size_bytes") / (1024 * 1024), 2).alias("size_mb"), F.coalesce("rows", F.lit(0)).alias("rows"))


def file_precheck(inventory: DataFrame, missing: DataFrame, expected_type: str | None = None, large: int | None = LARGE_FILE) -> DataFrame:
    """``path, problem, severity``: empty files and missing columns are issues; large, undetected or unexpected files warnings.

    ``large``: more bytes than that are a warning; with None no size is.
    """
    problems = F.array(
        F.when(F.coalesce("size_bytes", F.lit(0)) == 0, F.struct(F.lit("empty").alias("problem"), F.lit("issue").alias("severity"))),
        F.when(F.col("size_bytes") > F.lit(large), F.struct(F.lit("large").alias("problem"), F.lit("warning").alias("severity"))),
        F.when(F.col("file_type").isNull(), F.struct(F.lit("undetected").alias("problem"), F.lit("warning").alias("severity"))),
        F.when(F.col("file_type") != F.lit(expected_type), F.struct(F.lit("type_mismatch").alias("problem"), F.lit("warning").alias("severity"))),
    )
    own = inventory.select("path", F.inline(F.array_compact(problems)))
    lacking = missing.where("problem = 'missing'").select("path", F.concat(F.lit("missing_column:"), F.col("column")).alias("problem"), F.lit("issue").alias("severity"))
    return own.unionByName(lacking)


def files_by_extension(files: DataFrame) -> DataFrame:
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    return files.groupBy(F.when(extension.isin(".xlsx", ".xls", ".csv"), extension).otherwise("unsupported").alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """``column, non_null, distinct_values, low_cardinality, least, most``; low is below half distinct.

    By default one pass with sketches.  ``exact`` counts distinct values through one
    shuffle of (column, value), counted before it is sent.
    """
    columns = list(columns or df.columns)
    numbers = {f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")}
    value = lambda c, f: f(F.col(f"`{c}`")).cast("double") if c in numbers else F.lit(None).cast("double")
    aggs = [x for i, c in enumerate(columns) for x in (F.count(F.col(f"`{c}`")).alias(f"{i}n"), value(c, F.min).alias(f"{i}a"), value(c, F.max).alias(f"{i}b"), (F.lit(0).cast("long") if exact else F.approx_count_distinct(F.col(f"`{c}`"))).alias(f"{i}d"))]
    out = df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{i}n").alias("non_null"), F.col(f"{i}d").alias("distinct_values"), F.col(f"{i}a").alias("least"), F.col(f"{i}b").alias("most")) for i, c in enumerate(columns)])))
    if exact:
        cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))).where("value is not null").distinct()
        out = out.drop("distinct_values").join(cells.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")), "column", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    low = F.coalesce(F.col("distinct_values") / F.nullif(F.col("non_null"), F.lit(0)) < 0.5, F.lit(False))
    return out.select("column", "non_null", "distinct_values", low.alias("low_cardinality"), "least", "most")


def archive_plan(files: DataFrame, day: str, stamp: str) -> DataFrame:
    """``path, destination``: a folder for the day beside the file; a name taken twice that day gets the time."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    folder = F.regexp_replace("path", r"[^/\\]*$", "")
    taken = F.coalesce(F.col("taken"), F.lit(False))
    stamped = F.concat(F.regexp_replace(name, r"(\.[^.]*)?$", ""), F.lit(f"_{stamp}"), F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.select("path", F.concat(folder, F.lit(f"{day}/"), F.when(taken, stamped).otherwise(name)).alias("destination"))


def combined(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
