"""What a file type declares: source columns, target types, date order, load strategy."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The types a column may declare, and how Spark holds them (fixed values).
SPARK_TYPES: dict[str, T.DataType] = {
    "NVARCHAR(MAX)": T.StringType(),
    "INT": T.IntegerType(),
    "FLOAT": T.DoubleType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
}
#: Columns that every staged and final row carries beside its own (fixed values).
LINEAGE = T.StructType(
    [
        T.StructField("_loaded_at", T.TimestampNTZType()),
        T.StructField("_created_at", T.TimestampNTZType()),
        T.StructField("_source_file", T.StringType()),
        T.StructField("_batch_id", T.StringType()),
        T.StructField("_upsert_hash", T.BinaryType()),
    ]
)
STAGING_SUFFIX = "__stg"


def declared_type(name: str | None) -> str:
    """One of SPARK_TYPES: any NVARCHAR, an unknown or a missing type is unbounded text."""
    upper = (name or "").strip().upper()
    return upper if upper in SPARK_TYPES else "NVARCHAR(MAX)"


@dataclass(frozen=True)
class FileTypeSpec:
    """``columns``: source name to target name; ``dtypes``: target name to declared type."""

    name: str
    columns: Mapping[str, str]
    dtypes: Mapping[str, str] = field(default_factory=dict)
    date_format: str = "UK"
    strategy: str = "replace"
    keys: tuple[str, ...] = ()
    table: str | None = None

    @property
    def targets(self) -> list[str]:
        return list(dict.fromkeys(self.columns.values()))

    @property
    def final_table(self) -> str:
        return self.table or self.name

    @property
    def staging_table(self) -> str:
        return self.final_table + STAGING_SUFFIX

    def type_of(self, target: str) -> str:
        return declared_type(self.dtypes.get(target))

    def of_type(self, *kinds: str) -> list[str]:
        return [c for c in self.targets if self.type_of(c) in kinds]

    def schema(self, lineage: bool = True) -> T.StructType:
        fields = [T.StructField(c, SPARK_TYPES[self.type_of(c)]) for c in self.targets]
        return T.StructType(fields + (LINEAGE.fields if lineage else []))


def spec_rows(spark: SparkSession, specs: list[FileTypeSpec]) -> DataFrame:
    """Specs as rows ``(file_type, source, target)``, for joins with headers."""
    rows = [(s.name, k, v) for s in specs for k, v in s.columns.items()]
    return spark.createDataFrame(rows, "file_type string, source string, target string")
