"""User functions over tables (UDF-1, UDF-2)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame


def process(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps in order; Spark plans them as one query."""
    return reduce(lambda d, f: d.transform(f), steps, df)


def process_in_chunks(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on batches of rows, results concatenated; spark.sql.execution.arrow.maxRecordsPerBatch sets their size."""

    def run(batches):
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(run, schema)
