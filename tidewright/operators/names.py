"""Column names and file-type detection from headers (NAM-*, DET-*, SCH-1)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.spec import FileTypeSpec

#: Spec names up to this number are broadcast (counted first), more are joined by shuffle.
BROADCAST_NAMES = 1_000_000
#: Header cells that one task is given.
CELLS_A_TASK = 500_000
ZERO_WIDTH = "​‌‍﻿"


def normalize_name(c: Column) -> Column:
    """Trimmed, lower case, without zero-width marks, runs of white space as one space; NULL is ''."""
    bare = F.translate(F.lower(F.coalesce(c, F.lit(""))), ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def standardize_name(c: Column) -> Column:
    """Lower case with runs of anything but letters, numbers and _ as one _, none at the ends; NULL is ''."""
    joined = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}_]+", "_")
    return F.regexp_replace(joined, r"^_+|_+$", "")


def normalized(name: str | None) -> str:
    """``normalize_name`` for names on the driver."""
    bare = (name or "").lower().translate({ord(z): None for z in ZERO_WIDTH})
    return re.sub(r"\s+", " ", bare).strip()


def standardized(name: str | None) -> str:
    out = "".join(ch if ch == "_" or unicodedata.category(ch)[0] in "LN" else "\0" for ch in (name or "").strip().lower())
    return re.sub("\0+", "_", out).strip("_")


def rename_plan(columns: Sequence[str], spec: FileTypeSpec) -> dict[str, str]:
    """Which columns get which names.

    An identity mapping restores the spelling of the spec.  Otherwise names are
    matched with sources or, if targets match more columns, with targets and turned
    back to sources.
    """
    keys, values = {normalized(k) for k in spec.columns}, {normalized(v) for v in spec.columns.values()}
    own = {normalized(c) for c in columns}
    if keys == values:
        plan = {normalized(k): k for k in spec.columns}
    elif len(own & keys) >= len(own & values):
        plan = {normalized(k): v for k, v in spec.columns.items()}
    else:
        plan = {normalized(v): k for k, v in spec.columns.items()}
    return {c: plan[normalized(c)] for c in columns if normalized(c) in plan and plan[normalized(c)] != c}


def rename_by_mapping(df: DataFrame, spec: FileTypeSpec) -> DataFrame:
    return df.withColumnsRenamed(rename_plan(df.columns, spec))


def target_names(columns: Sequence[str], spec: FileTypeSpec) -> list[str | None]:
    """The target of each column, None for one that the spec doesn't know.

    Names are matched with sources or, if targets match more columns, with targets.
    """
    keys, values = {normalized(k): v for k, v in spec.columns.items()}, {normalized(v): v for v in spec.columns.values()}
    own = {normalized(c) for c in columns}
    known = keys if len(own & keys.keys()) >= len(own & values.keys()) else values
    return [known.get(normalized(c)) for c in columns]


def threshold(n: Column) -> Column:
    """The share of names a file type must match, by its number of columns."""
    return F.when(n >= 50, F.greatest(F.lit(0.1), 5 / n)).when(n >= 20, F.greatest(F.lit(0.2), 5 / n)).otherwise(F.lit(0.3))


def _small(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.count() <= BROADCAST_NAMES else names


def by_path(headers: DataFrame) -> DataFrame:
    """Headers with each file's cells in one task; tasks grow in number with the cells, not in size."""
    return headers.repartition(1 + headers.count() // CELLS_A_TASK, "path")


def match_scores(headers: DataFrame, specs: DataFrame) -> DataFrame:
    """``path, header_row, file_type, score``: headers (``path, header_row, cell``) against spec rows, by equi-join.

    Cells are shuffled once, by path, and only those that some type knows.  Spec rows come
    from configuration; up to BROADCAST_NAMES they are broadcast, so cells stay with their files.
    """
    sides = specs.select("file_type", F.inline(F.array(F.struct(F.lit("key").alias("side"), normalize_name(F.col("source")).alias("name")), F.struct(F.lit("value").alias("side"), normalize_name(F.col("target")).alias("name"))))).distinct()
    n = sides.groupBy("file_type").agg(F.count_if(F.col("side") == "key").alias("keys"), F.count_if(F.col("side") == "value").alias("values"), F.array_sort(F.collect_set(F.when(F.col("side") == "key", F.col("name")))).alias("_k"), F.array_sort(F.collect_set(F.when(F.col("side") == "value", F.col("name")))).alias("_v"))
    n = n.withColumn("identity", F.col("_k") == F.col("_v")).drop("_k", "_v")
    sides = sides.groupBy("file_type", "name").agg(F.count_if(F.col("side") == "key").alias("key"), F.count_if(F.col("side") == "value").alias("value"))
    cells = headers.select("path", "header_row", normalize_name(F.col("cell")).alias("name")).join(_small(sides.select("name").distinct()), "name", "left_semi")
    cells = by_path(cells).select("path", "header_row", "name").distinct()
    hits = cells.join(_small(sides), "name").groupBy("path", "header_row", "file_type").agg(F.sum("key").alias("key_hits"), F.sum("value").alias("value_hits"))
    by_key = F.col("identity") | (F.col("key_hits") > F.col("value_hits"))
    out = hits.join(_small(n), "file_type")
    score = F.when(by_key, F.col("key_hits") / F.col("keys")).otherwise(F.col("value_hits") / F.col("values"))
    count = F.when(by_key, F.col("keys")).otherwise(F.col("values"))
    return out.select("path", "header_row", "file_type", score.alias("score"), threshold(count).alias("needed"))


def detect_file_type(headers: DataFrame, specs: DataFrame) -> DataFrame:
    """``path, header_row, file_type, score``: a match in the first row beats the second, then score, then name order.

    Files that match nothing are left out; ``detect_by_filename`` may take them.
    """
    best = W.partitionBy("path").orderBy("header_row", F.desc("score"), "file_type")
    found = match_scores(headers, specs).where(F.col("score") >= F.col("needed"))
    return found.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("path", "header_row", "file_type", "score")


def detect_by_filename(files: DataFrame, types: DataFrame) -> DataFrame:
    """``path, file_type``: the first type, by name, whose lower name is part of the lower file name.

    ``types`` is configuration, one short row per type, so the theta join is with a small table.
    """
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    pairs = files.select("path", name.alias("_file")).join(types.select("file_type"), F.contains(F.col("_file"), F.lower("file_type")))
    return pairs.groupBy("path").agg(F.min("file_type").alias("file_type"))


def type_from_letters(path: Column) -> Column:
    """Letters and _ of the base name without its extension; 'Unknown' if none."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    letters = F.regexp_replace(base, r"[^\p{L}_]", "")
    return F.when(letters == "", "Unknown").otherwise(letters)


def missing_extra_columns(headers: DataFrame, specs: DataFrame, types: DataFrame) -> DataFrame:
    """``path, column, problem``: declared sources that a file lacks (missing) and columns that nobody declared (extra).

    ``types``: ``path, file_type``, as detected.
    """
    wanted = types.join(_small(specs.select("file_type", F.col("source").alias("column"))), "file_type").select("path", "column", F.lit(1).alias("wanted"), F.lit(0).alias("actual"))
    actual = by_path(headers.select("path", F.col("cell").alias("column"))).join(types.select("path"), "path", "left_semi").select("path", "column", F.lit(0).alias("wanted"), F.lit(1).alias("actual"))
    sides = wanted.unionByName(actual).groupBy("path", "column").agg(F.max("wanted").alias("wanted"), F.max("actual").alias("actual"))
    return sides.where(F.col("wanted") != F.col("actual")).select("path", "column", F.when(F.col("wanted") == 1, "missing").otherwise("extra").alias("problem"))
