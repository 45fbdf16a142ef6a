"""New PDF files as a stream of pages. Stateless, so every file is read once: the checkpoint knows which were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import relations

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def page_stream(spark: SparkSession, path: str, max_files: int | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Pages of the *.pdf files that come into a folder: path, page_number, object_id, text."""
    src = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.pdf")
    if max_files:
        src = src.option("maxFilesPerTrigger", max_files)
    return relations.pages(src.load(path).select("path", "content"), **options)


def ingest(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write all pages there are as Parquet, exactly once over restarts, then stop."""
    return pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(pages: DataFrame, on_pages: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call `on_pages` with the pages of each batch of files (again with the same batch number after a failure)."""
    return pages.writeStream.foreachBatch(on_pages).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
