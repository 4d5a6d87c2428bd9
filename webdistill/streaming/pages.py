"""Structured Streaming: the same kernels over unbounded tables of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from webdistill.functions.extract import Options
from webdistill.operators.pages import PageFrame

SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of pages in a folder, as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def extract_stream(pages: DataFrame, options: Options | None = None, once_per_url: bool = False, time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Pages with their extraction. With ``once_per_url`` later pages of an address go; a time column bounds what is remembered."""
    if once_per_url:
        pages = pages.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["url"]) if time_col else pages.dropDuplicates(["url"])
    return PageFrame(pages).extract(options)


def write_stream(extracted: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Append what is extracted; the checkpoint makes files exactly-once."""
    return extracted.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(extracted: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return extracted.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
