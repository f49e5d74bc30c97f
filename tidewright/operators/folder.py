"""From a folder of files to typed tables: discover, detect, rename, stage, validate, load (STR-1, UPS-9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.convert import typed_select
from ..plans.paths import shared_path, written
from ..plans.spec import LINEAGE, FileTypeSpec, spec_rows
from ..sources.files import EXTENSIONS, discover_files, headers_of, peek_headers, read_csv_strings, read_excel_strings
from .load import HASH, VersionedTable, key_guard, key_hash, newest_file_wins, write_staging
from .names import detect_file_type, target_names
from .validate import checks_for, gate, issues

PLAN = "path string, filename string, size_bytes long, mtime timestamp, file_type string, header_row int, problem string, file string, encoding string, header array<string>"
_PLANNED = Row(*[c.split()[0] for c in PLAN.split(", ")])
REPORT = "path string, filename string, file_type string, status string, problem string, rows long"


def plan_files(spark: SparkSession, paths: str | Sequence[str], specs: Sequence[FileTypeSpec]) -> DataFrame:
    """``plan`` as a table."""
    return spark.createDataFrame(plan(spark, paths, specs), PLAN)


def plan(spark: SparkSession, paths: str | Sequence[str], specs: Sequence[FileTypeSpec]) -> list[Row]:
    """What each file is, and why it can't be loaded: one row per file, held by the driver.

    Problems: ``unsupported`` (no reader for .xls), ``empty``, ``unreadable:<error>``,
    ``undetected`` (no header row matches a type), ``missing_column:<name>`` and
    ``duplicate_column:<name>`` (two columns with one target).  Columns that nobody
    declared are no problem; they are not read.  The header, encoding and path of a
    planned file are carried along, so that readers don't look again.
    """
    found = discover_files(spark, paths)
    heads = written(peek_headers(spark, paths), "headers")
    broken = heads.where("error is not null").groupBy("path").agg(F.min("error").alias("error"))
    types = detect_file_type(heads.where("error is null"), spec_rows(spark, list(specs))).drop("score")
    by_name = {s.name: s for s in specs}
    rows = []
    for r in found.join(types, "path", "left").join(headers_of(heads), ["path", "header_row"], "left").join(broken, "path", "left").orderBy("path").collect():
        problem = None
        if r["extension"] == ".xls":
            problem = "unsupported"
        elif r["error"] is not None:
            problem = f"unreadable:{r['error']}"
        elif r["file_type"] is None:
            problem = "undetected"
        else:
            spec = by_name[r["file_type"]]
            own = [t for t in target_names(r["header"], spec) if t is not None]
            missing, twice = [t for t in spec.targets if t not in own], [t for t in spec.targets if own.count(t) > 1]
            if missing or twice:
                problem = f"missing_column:{missing[0]}" if missing else f"duplicate_column:{twice[0]}"
        rows.append(_PLANNED(r["path"], r["filename"], r["size_bytes"], r["mtime"], r["file_type"], r["header_row"], problem, r["file"], r["encoding"], r["header"]))
    read = {r["filename"] for r in rows}
    for url in found.inputFiles():  # Spark lists files without bytes, but makes no rows of them
        name = unquote(url.rsplit("/", 1)[-1])
        if name.lower().endswith(EXTENSIONS) and name not in read:
            rows.append(_PLANNED(unquote(url), name, 0, None, None, None, "empty", None, None, None))
    return rows


def read_files(spark: SparkSession, planned: Sequence[Row], spec: FileTypeSpec, multi_line: bool = False) -> DataFrame:
    """All rows of the planned files of one type as text under its target names, with ``_source_file`` and ``_read_error``.

    ``planned``: rows of ``plan``, at least one of this type without a problem.
    A file that breaks off while it is read has a row with ``_read_error``.
    """
    kinds: dict[tuple[int, bool], list[Row]] = {}
    for r in planned:
        if r["file_type"] == spec.name and r["problem"] is None:
            kinds.setdefault((r["header_row"], r["path"].lower().endswith(".csv")), []).append(r)
    rename = lambda names: target_names(names, spec)
    parts = []
    for (row, is_csv), own in sorted(kinds.items(), key=lambda k: k[0]):
        if is_csv:
            parts.append(read_csv_strings(spark, [], multi_line, skip_rows=row, rename=rename, heads=own, errors=True))
        else:
            parts.append(read_excel_strings(spark, [], skip_rows=row, rename=rename, heads=own, errors=True))
    return reduce(DataFrame.unionByName, parts)


def load_declared(table: VersionedTable, rows: DataFrame, spec: FileTypeSpec, batch: str | None = None, force_recreate: bool = False) -> int:
    """Typed rows into the table by the type's strategy; a ``batch`` that is in the table isn't loaded again.

    A table that lacks declared columns, or has them in another type, keeps its rows: its
    columns evolve (see ``evolved``).  Only a replacement or ``force_recreate`` starts it
    anew with the declared columns alone.
    """
    if force_recreate or spec.strategy == "replace":
        return table.version() if batch is not None and table.committed(batch) else table.replace(rows, batch)
    return table.upsert(rows, batch=batch) if spec.strategy == "upsert" and spec.keys else table.append(rows, batch)


def judge_files(staged: DataFrame, spec: FileTypeSpec) -> DataFrame:
    """``_source_file, problem, n`` of staged rows; the problem is NULL for a file that may load.

    In this order: ``unreadable:<error>`` (it broke off), ``null_keys:<rows>`` (rows
    without an upsert key, which would all replace one another), ``validation``.
    """
    rows, checks = staged.where("_read_error is null"), checks_for(spec)
    if checks:
        judged = gate(issues(rows, checks, ["_source_file"]), ["_source_file"]).select("_source_file", "is_valid", F.col("total").alias("n"))
    else:
        judged = rows.groupBy("_source_file").agg(F.lit(True).alias("is_valid"), F.count(F.lit(1)).alias("n"))
    broken = staged.where("_read_error is not null").groupBy("_source_file").agg(F.min("_read_error").alias("error"))
    judged = judged.join(broken, "_source_file", "full")
    if spec.strategy == "upsert" and spec.keys:
        judged = judged.join(key_guard(rows, spec.keys, ["_source_file"]).drop("total"), "_source_file", "left")
    else:
        judged = judged.withColumn("null_keys", F.lit(0))
    problem = F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable:"), F.col("error"))).when(F.col("null_keys") > 0, F.concat(F.lit("null_keys:"), F.col("null_keys").cast("string"))).when(~F.col("is_valid"), "validation")
    return judged.select("_source_file", problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n"))


def load_files(
    spark: SparkSession, paths: str | Sequence[str], specs: Sequence[FileTypeSpec], tables: Mapping[str, VersionedTable], batch: str,
    loaded_at: str | None = None, staging: str | None = None, multi_line: bool = False, force_recreate: bool = False,
) -> DataFrame:
    """Load all files of a folder (or list of paths) and report on each: ``path, filename, file_type, status, problem, rows``.

    A file that can't be read as its type (``plan_files``), breaks off, has rows without a
    key or fails validation (``judge_files``), or has no rows (``no_rows``), is left out
    as a whole and reported as failed; the others are loaded.  Each type's files are
    staged as text in one table, judged by file in one aggregation and loaded at once: by
    replacement all files together, by upsert for each key the rows of the newest file
    that has it.  ``batch`` names the load; sent again after a failure it leaves tables
    that have it as they are.  ``staging``: a folder for the staging tables, by default a
    new one.  File names in one call are distinct; without paths the report is empty.
    """
    if not paths:
        return spark.createDataFrame([], REPORT)
    planned = plan(spark, paths, specs)
    out = [(r["path"], r["filename"], r["file_type"], "failed", r["problem"], 0) for r in planned if r["problem"] is not None]
    for spec in specs:
        own = [r for r in planned if r["file_type"] == spec.name and r["problem"] is None]
        if not own:
            continue
        at = F.coalesce(F.lit(loaded_at).cast("timestamp_ntz"), F.current_timestamp().cast("timestamp_ntz"))
        rows = read_files(spark, own, spec, multi_line)
        rows = rows.withColumns({"_loaded_at": at, "_created_at": at, "_batch_id": F.lit(batch), HASH: key_hash(spec.keys) if spec.keys else F.lit(None).cast("binary")})
        path = shared_path(spark, spec.staging_table) if staging is None else f"{staging}/{spec.staging_table}"
        write_staging(rows, spec.targets, path, [*LINEAGE.names, "_read_error"])
        staged = spark.read.parquet(path)
        verdicts = {r["_source_file"]: (r["problem"], r["n"]) for r in judge_files(staged, spec).collect()}  # one row per file
        good = [(r["filename"], r["mtime"]) for r in own if verdicts.get(r["filename"], ("",))[0] is None]
        if good:
            good = spark.createDataFrame(good, "_source_file string, mtime timestamp")
            valid = staged.drop("_read_error").join(F.broadcast(good), "_source_file")
            if spec.strategy == "upsert" and spec.keys:
                valid = newest_file_wins(valid)
            load_declared(tables[spec.name], typed_select(valid, spec), spec, f"{batch}#{spec.name}", force_recreate)
        for r in own:
            problem, n = verdicts.get(r["filename"], ("no_rows", 0))
            out.append((r["path"], r["filename"], r["file_type"], "success" if problem is None else "failed", problem, n))
    return spark.createDataFrame(out, REPORT)
