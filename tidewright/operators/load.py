"""Load strategies: replace, append, key-hash upsert, newest file wins (UPS-*, JON-1)."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import written

SEPARATOR, SAFE_SEPARATOR = "|", "\x1f"
HASH = "_upsert_hash"
#: Staged key hashes up to this number are broadcast to the target (16 bytes each; counted first).
BROADCAST_HASHES = 1_000_000
#: Keys of more than one in so many rows are hot; there can't be more of them than this.
HOT_SHARE = 10_000


def key_hash(keys: Sequence[str], safe: bool = False, charset: str = "UTF-8") -> Column:
    """MD5 (binary) of the trimmed keys; NULL counts as empty.

    With the default separator ('a|b', 'c') and ('a', 'b|c') hash alike; ``safe``
    uses a control character instead.
    """
    text = F.concat_ws(SAFE_SEPARATOR if safe else SEPARATOR, *[F.coalesce(F.trim(F.col(f"`{k}`").cast("string")), F.lit("")) for k in keys])
    return F.unhex(F.md5(F.encode(text, charset)))


def key_guard(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows with a NULL key (per group); a key column that isn't there is an error."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"missing key columns: {missing}")
    null = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(null).alias("null_keys"))


def not_replaced(target: DataFrame, staged: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """Target rows whose hash isn't staged; rows without a hash stay."""
    hashes = staged.select(HASH).where(F.col(HASH).isNotNull()).distinct()
    if hashes.limit(broadcast_hashes + 1).count() <= broadcast_hashes:
        hashes = F.broadcast(hashes)
    return target.join(hashes, HASH, "left_anti").select(target.columns)


def upsert(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Target rows that aren't replaced, and all staged rows (their own duplicates included).

    Columns that only one side has become NULL on the other: the schema evolves.
    """
    return not_replaced(target, staged).unionByName(staged, allowMissingColumns=True)


def append(target: DataFrame, staged: DataFrame) -> DataFrame:
    return target.unionByName(staged, allowMissingColumns=True)


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all files; a column that a file lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def newest_file_wins(rows: DataFrame, order: Sequence[str] = ("mtime", "_source_file"), valid: Column | None = None, hot_share: int = HOT_SHARE) -> DataFrame:
    """Of each key only rows of the newest valid file that has it; a file's own duplicates stay.

    The newest file of a key and its number of rows are taken before the shuffle, one
    row per task and key.  Keys that more than one in ``hot_share`` rows have (so at
    most ``hot_share`` keys) are broadcast and their rows aren't shuffled; the others
    meet their rows by a shuffle in which no key has more than that share.  Ties in time
    go to the later path.  Rows without a hash all stay and are not shuffled.
    """
    rows = rows if valid is None else rows.where(valid)
    rank = F.struct(*order)
    keyed = rows.where(F.col(HASH).isNotNull())
    newest = written(keyed.groupBy(HASH).agg(F.max(rank).alias("_newest"), F.count(F.lit(1)).alias("_n")), "newest-files")
    total = newest.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot, cold = (newest.where(c).drop("_n") for c in (F.col("_n") * hot_share > total, F.col("_n") * hot_share <= total))
    hot = F.broadcast(hot)
    met = keyed.join(hot, HASH).unionByName(keyed.join(hot.select(HASH), HASH, "left_anti").join(cold, HASH))
    return met.where(rank == F.col("_newest")).select(rows.columns).unionByName(rows.where(F.col(HASH).isNull()))


def route(inventory: DataFrame) -> DataFrame:
    """``file_type, strategy, files``; a type without a strategy is replaced."""
    return inventory.groupBy("file_type", F.coalesce("strategy", F.lit("replace")).alias("strategy")).agg(F.count(F.lit(1)).alias("files"))


#: Of two numeric types the later one holds both (fixed values).
_WIDER = ("tinyint", "smallint", "int", "bigint", "float", "double")


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the values of both: the wider number, the timestamp of a date and a timestamp, else text."""
    names = [x.simpleString() for x in (a, b)]
    if names[0] == names[1]:
        return a
    if all(n in _WIDER for n in names):
        wide = max(names, key=_WIDER.index)
        return T.DoubleType() if wide == "float" and {"int", "bigint"} & set(names) else (a, b)[names.index(wide)]
    times = {"date", "timestamp", "timestamp_ntz"}
    if set(names) <= times:
        return T.TimestampNTZType()
    return T.StringType()


def evolved(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of ``old`` in their order, then those that only ``new`` has; types that differ are widened."""
    also = {f.name: f.dataType for f in new}
    kept = [T.StructField(f.name, common_type(f.dataType, also[f.name]) if f.name in also else f.dataType) for f in old]
    return T.StructType(kept + [T.StructField(f.name, f.dataType) for f in new if f.name not in old.names])


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones NULL, others cast to the wider type."""
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


class VersionedTable:
    """Parquet folders and a log of versions, for stores without MERGE.

    Rows with a key hash lie in buckets by it (``part/_bucket=n``), rows without one in
    bucket -1.  A version writes one part: an append its own rows; an upsert the buckets
    that staged hashes fall into, made of their old rows and the staged ones, while the
    files of other buckets are neither read nor written; a replacement stands alone.
    The log has one row a version with the part, the buckets in it, those it replaces
    and the table's columns.  Columns evolve: a load may bring new ones or wider types;
    older parts stay as they are and are aligned when read.

    Parts have names of their own and the log row is written last: readers never see a
    half-written version, and a job that dies before it leaves the old version in force.
    One writer at a time.
    """

    LOG = "version long, part string, held array<int>, replaced array<int>, columns string, n_buckets int, batch string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def log(self) -> list[Row]:
        """One short row a version, oldest first."""
        try:
            found = self.spark.read.schema(self.LOG).parquet(f"{self.path}/log").orderBy("version").collect()
        except AnalysisException:
            return []
        if found:
            self.buckets = found[-1]["n_buckets"]
        return found

    def version(self) -> int:
        return max((r["version"] for r in self.log()), default=-1)

    def committed(self, batch: str) -> bool:
        """Whether a load under this name is in the table."""
        return any(r["batch"] == batch for r in self.log())

    def schema(self, log: Sequence[Row] | None = None) -> T.StructType | None:
        log = self.log() if log is None else log
        return T.StructType.fromJson(json.loads(log[-1]["columns"])) if log else None

    def folders(self, log: Sequence[Row], buckets: set[int] | None = None) -> dict[str, list[str]]:
        """The live folders, all or some buckets, by the columns that they were written with."""
        live: dict[str, tuple[str, set[int]]] = {}
        for r in log:
            if r["replaced"] is None:
                live = {}
            live = {part: (columns, held - set(r["replaced"] or ())) for part, (columns, held) in live.items()}
            live[r["part"]] = r["columns"], set(r["held"])
        out: dict[str, list[str]] = {}
        for part, (columns, held) in live.items():
            own = sorted(held if buckets is None else held & buckets)
            if own:
                out.setdefault(columns, []).extend(f"{self.path}/{part}/_bucket={b}" for b in own)
        return out

    def _read(self, log: Sequence[Row], schema: T.StructType, buckets: set[int] | None = None) -> DataFrame:
        frames = [aligned(self.spark.read.schema(T.StructType.fromJson(json.loads(columns))).parquet(*paths), schema) for columns, paths in self.folders(log, buckets).items()]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """All rows with the columns of the newest version, one scan for each set of columns that parts were written with."""
        log = self.log()
        return self._read(log, self.schema(log)) if log else None

    def _bucketed(self, df: DataFrame) -> DataFrame:
        bucket = F.when(F.col(HASH).isNotNull(), F.pmod(F.hash(HASH), F.lit(self.buckets))).otherwise(F.lit(-1)) if HASH in df.columns else F.lit(-1)
        return df.withColumn("_bucket", bucket.cast("int"))

    def _commit(self, rows: DataFrame, log: Sequence[Row], schema: T.StructType, replaced: Sequence[int] | None, batch: str | None) -> int:
        v = log[-1]["version"] + 1 if log else 0
        part = f"v{v}-{uuid.uuid4().hex}"
        rows = self._bucketed(rows)
        if HASH in rows.columns:
            rows = rows.hint("rebalance", F.col("_bucket"))  # adaptive execution splits large buckets and joins small ones
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{part}")
        try:
            files = self.spark.read.schema(schema).parquet(f"{self.path}/{part}").inputFiles()
        except AnalysisException:  # no rows, no files
            files = []
        held = sorted({int(re.search(r"/_bucket=(-?\d+)/", f)[1]) for f in files if "/_bucket=" in f})
        self.spark.createDataFrame([(v, part, held, None if replaced is None else list(replaced), schema.json(), self.buckets, batch)], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return v

    def _evolved(self, log: Sequence[Row], df: DataFrame) -> T.StructType:
        return evolved(self.schema(log), df.schema) if log else T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])

    def replace(self, df: DataFrame, batch: str | None = None) -> int:
        """The rows and their columns alone."""
        return self._commit(df, self.log(), self._evolved([], df), None, batch)

    def append(self, df: DataFrame, batch: str | None = None) -> int:
        """Only the new rows are written; a ``batch`` that is in the table is not written again."""
        log = self.log()
        if batch is not None and any(r["batch"] == batch for r in log):
            return log[-1]["version"]
        schema = self._evolved(log, df)
        return self._commit(aligned(df, schema), log, schema, [], batch)

    def upsert(self, df: DataFrame, force_recreate: bool = False, batch: str | None = None) -> int:
        """Rows of staged hashes go, the staged ones come; only their buckets are read and written."""
        log = self.log()
        if batch is not None and any(r["batch"] == batch for r in log):
            return log[-1]["version"]
        if force_recreate or not log:
            return self.replace(df, batch)
        schema = self._evolved(log, df)
        staged = aligned(df, schema)
        touched = {r[0] for r in self._bucketed(staged).select("_bucket").distinct().collect()} - {-1}  # at most one row for each bucket
        rows = not_replaced(self._read(log, schema, touched), staged).unionByName(staged)
        return self._commit(rows, log, schema, sorted(touched), batch)

    def compact(self) -> int:
        """All rows in one part, so that reads list few folders."""
        log = self.log()
        return self._commit(self._read(log, self.schema(log)), log, self.schema(log), None, None)

    def load(self, df: DataFrame, strategy: str = "replace", keys: Sequence[str] = ()) -> int:
        """By strategy; an upsert without keys appends."""
        if strategy == "upsert":
            return self.upsert(df) if keys else self.append(df)
        return self.append(df) if strategy == "append" else self.replace(df)


def write_staging(df: DataFrame, columns: Sequence[str], path: str, lineage: Sequence[str] = ("_loaded_at", "_created_at", "_source_file", "_batch_id", HASH)) -> None:
    """Recreate the staging table: declared columns as text in order, then lineage; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns], *[c for c in lineage if c in df.columns]).write.mode("overwrite").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 5000, **options: str) -> None:
    """To a database table; overwriting truncates and keeps its definition.  Needs the database's driver."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("truncate", True).option("batchsize", batch_size).options(**options).mode(mode).save()
