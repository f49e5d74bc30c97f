"""Incremental folder intake as a file stream (STR-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.folder import load_files
from ..operators.load import VersionedTable
from ..plans.spec import FileTypeSpec
from ..sources.files import literal_path


def auto_ingest(spark: SparkSession, folder: str, spec: FileTypeSpec, table: VersionedTable, checkpoint: str, archive: str | None = None, loaded_at: str | None = None, report: str | None = None) -> None:
    """Load the folder's new files once and stop; a second run finds nothing new.

    The stream carries file names only; the files of a batch are detected, renamed,
    validated and loaded together.  Files that fail are left out and don't stop the
    others: their rows in ``report`` (a folder; see ``load_files``) say why.  The
    checkpoint remembers files, and the table's pointer names the batches it has, so
    a batch that is replayed after a failure changes nothing.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def load(batch: DataFrame, number: int) -> None:
        paths = [literal_path(r["path"]) for r in batch.collect()]  # one name per file
        if paths:
            done = load_files(spark, paths, [spec], {spec.name: table}, f"{checkpoint}#{number}", loaded_at)
            if report:
                done.write.mode("overwrite").parquet(f"{report}/batch={number}")

    reader.load(folder).select("path").writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
