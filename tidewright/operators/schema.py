"""Schema inference, comparison and lineage (SCH-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import INTEGER_PATTERN, NUMBER_PATTERN
from ..functions.convert import to_date
from ..plans.spec import FileTypeSpec
from ..sources.files import source_file
from .load import HASH, key_hash

#: Families of types: within one a column is altered, across two the table is recreated (fixed values).
FAMILIES = {"int": "NUMERIC", "bigint": "NUMERIC", "smallint": "NUMERIC", "tinyint": "NUMERIC", "float": "NUMERIC", "double": "NUMERIC", "decimal": "NUMERIC", "date": "DATETIME", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME", "string": "STRING", "varchar": "STRING", "char": "STRING"}
#: Names for one and the same type (fixed values).
SAME = {"timestamp": "timestamp_ntz", "varchar": "string", "char": "string"}


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, sample: int | None = None, find_dates: bool = False, date_format: str = "UK") -> DataFrame:
    """``column, non_blank, inferred`` for text columns in one aggregation, over all rows or the first ``sample``.

    All true/false is INT, all whole numbers INT, all numbers FLOAT, else text (or,
    with ``find_dates``, DATETIME if every value parses); a column without values is
    text.
    """
    columns = list(columns or df.columns)
    rows = df.select(columns) if sample is None else df.select(columns).limit(sample)
    aggs = []
    for i, c in enumerate(columns):
        v = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        aggs += [F.count(v).alias(f"{i}n"), F.count_if(v.rlike(INTEGER_PATTERN)).alias(f"{i}i"), F.count_if(v.rlike(NUMBER_PATTERN)).alias(f"{i}f"), F.count_if(F.lower(v).isin("true", "false")).alias(f"{i}b")]
        aggs.append((F.count(to_date(v, date_format)) if find_dates else F.lit(-1).cast("long")).alias(f"{i}d"))
    n = lambda i, k: F.col(f"{i}{k}")
    kind = lambda i: F.when(n(i, "n") == 0, "NVARCHAR(MAX)").when((n(i, "b") == n(i, "n")) | (n(i, "i") == n(i, "n")), "INT").when(n(i, "f") == n(i, "n"), "FLOAT").when(n(i, "d") == n(i, "n"), "DATETIME").otherwise("NVARCHAR(MAX)")
    return rows.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), n(i, "n").alias("non_blank"), kind(i).alias("inferred")) for i, c in enumerate(columns)])))


def spec_from(inferred: DataFrame, name: str) -> FileTypeSpec:
    """A new spec with an identity mapping; one row per column reaches the driver."""
    types = {r["column"]: r["inferred"] for r in inferred.select("column", "inferred").collect()}
    return FileTypeSpec(name, {c: c for c in types}, types)


def _family(name: str) -> str:
    return FAMILIES.get(name.split("(")[0], "OTHER")


def _plain(name: str) -> str:
    base = name.split("(")[0]
    return SAME.get(base, name)


def schema_diff(spark: SparkSession, existing: T.StructType, required: T.StructType) -> DataFrame:
    """``column, existing, required, action``: none, alter (same family), recreate, add or drop."""
    old, new = ({f.name: f.dataType.simpleString() for f in s if not f.name.startswith("_")} for s in (existing, required))
    rows = []
    for c in sorted({*old, *new}):
        a, b = old.get(c), new.get(c)
        if a is None or b is None:
            action = "add" if a is None else "drop"
        elif _plain(a) == _plain(b):
            action = "none"
        else:
            action = "alter" if _family(a) == _family(b) else "recreate"
        rows.append((c, a, b, action))
    return spark.createDataFrame(rows, "column string, existing string, required string, action string")


def needs_recreate(diff: DataFrame) -> bool:
    """A changed set of columns or a change across families."""
    return diff.where(F.col("action").isin("add", "drop", "recreate")).limit(1).count() > 0


def schema_warnings(diff: DataFrame) -> DataFrame:
    """Differences as warnings: a column the table lacks, and one whose type differs."""
    kind = F.when(F.col("action") == "add", "schema_missing_column").when(F.col("action").isin("alter", "recreate"), "schema_mismatch")
    return diff.select(kind.alias("validation_type"), "column", F.when(F.col("action") == "add", "warning").otherwise("info").alias("severity")).where("validation_type is not null")


def add_lineage(df: DataFrame, batch_id: str, loaded_at: str, source_file: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The five lineage columns; ``loaded_at`` is fixed once per run, the file is the base name.

    Without ``source_file`` it is the file that a row was read from.
    """
    at = F.lit(loaded_at).cast("timestamp_ntz")
    file = source_file() if source_file is None else F.regexp_extract(F.lit(source_file), r"([^/\\]*)$", 1)
    return df.select("*", at.alias("_loaded_at"), at.alias("_created_at"), file.alias("_source_file"), F.lit(batch_id).alias("_batch_id"), (key_hash(keys) if keys else F.lit(None).cast("binary")).alias(HASH))
