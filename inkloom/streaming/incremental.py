"""Incremental scans: files that were never seen, once, as a stream of micro-batches or as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkloom.operators.tables import unseen
from inkloom.sources.files import format_of, walk

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, done: DataFrame) -> DataFrame:
    """Files below a root whose path isn't among the paths done."""
    return unseen(walk(spark, root), done)


def follow(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], per_batch: int = 1000):
    """Starts a stream that hands each new file of a known format to ``handle`` in micro-batches, and ends when all that
    is there has been seen. The checkpoint remembers files, so a later call takes up where this one ended; a batch
    that failed is handed over again under the same number."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    files = files.withColumn("format", format_of("path")).where("format IS NOT NULL")
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
