"""Streams of pages.

Conversion has no state: what needs a document's rows together runs inside
``foreachBatch``, over the micro-batch as an ordinary DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagequarry.plans.convert import convert
from pagequarry.plans.options import Options

SCHEMA = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_crawls(pages: DataFrame, time: str, keep: str = "1 day") -> DataFrame:
    """Pages without those that a url brought again within the watermark."""
    return pages.withWatermark(time, keep).dropDuplicatesWithinWatermark(["url"])


def pages_per_window(pages: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Pages and characters by host and tumbling window; later pages than ``late`` don't count."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    counted = pages.withWatermark(time, late).groupBy(F.window(time, width), host.alias("host"))
    return counted.agg(F.count("*").alias("n_pages"), F.sum(F.length("html")).alias("n_chars"))


def convert_stream(pages: DataFrame, out: str, checkpoint: str, options: Options | None = None, doc_id: str = "page_id") -> DataStreamWriter:
    """A writer that converts every micro-batch and writes it as Parquet, a folder each, so a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        convert(batch, options, doc_id=doc_id).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
