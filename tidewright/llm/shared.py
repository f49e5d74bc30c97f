"""The cluster's shared folder, and slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word, for Spark and DuckDB alike (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset a temporary one serves a session on one machine, as in tests;
    on a cluster executors couldn't see it, so there it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: later jobs read them and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int = 4_000_000) -> Iterator[pa.Table]:
    """Small tables, so that work arrays stay small beside a batch of long texts: up to ``rows``, and up to ``most_bytes`` of text or one text."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type)]
        size = np.zeros(batch.num_rows, np.int64)
        for c in texts:
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right"))
            n = min(rows, max(1, upto - at))
            yield pa.Table.from_batches([batch.slice(at, n)])
            at += n


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; counted, never assumed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
