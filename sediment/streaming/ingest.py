"""Incremental ingest: a file stream whose micro-batches are backups.

The dedup state is the store itself, not stream state, so it is unbounded without
growing memory, and a restarted query goes on from its checkpoint. A batch that
ran before is skipped or stored again without new chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sediment.config import BackupOptions
from sediment.plans.backup import backup
from sediment.sources.files import as_files
from sediment.sources.store import ChunkStore


def ingest_stream(files: DataFrame, store: ChunkStore, checkpoint: str, options: BackupOptions = BackupOptions(), available_now: bool = True) -> StreamingQuery:
    """``files``: a streaming files table."""

    def batch(rows: DataFrame, _: int) -> None:
        if rows.limit(1).count():
            backup(rows, store, options)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watch_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files below a folder, however deep, as a streaming files table named as :func:`read_files` names them."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(path)
    return as_files(raw, path)
