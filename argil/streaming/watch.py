"""Continuous scan of a folder by Structured Streaming: each new file is scanned once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from argil import api
from argil.functions.dims import CANDIDATE_EXTENSIONS

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, recursive: bool = False, files_a_batch: int = 1000) -> DataFrame:
    """Stream of new model files; the file source remembers in its checkpoint which it has seen."""
    reader = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", "*.{" + ",".join(CANDIDATE_EXTENSIONS) + "}")
    return reader.option("recursiveFileLookup", str(recursive).lower()).option("maxFilesPerTrigger", files_a_batch).load(folder)


def watch(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, recursive: bool = False, once: bool = False) -> StreamingQuery:
    """Scan files as they come and hand each batch's reports to ``sink(reports, batch_id)``.

    A batch that is retried has the same id, so a sink that writes by id has each report once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(api.scan_binary(batch.select("path", "content")).reports(), batch_id)

    writer = arrivals(spark, folder, recursive).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
