"""Row operators on streams: stateless, so they run unchanged; these helpers name the usual jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.pages import with_sentences


def page_stream(spark: SparkSession, path: str, schema: str = "page_id bigint, url string, html string", files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of pages as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sentence_stream(pages: DataFrame, html: str = "html", **options) -> DataFrame:
    """Pages with the fields of the full result; no state, no shuffle."""
    return with_sentences(pages, html, **options)


def once_per_page(pages: DataFrame, key: str = "page_id", time: str | None = None, late: str = "30 days") -> DataFrame:
    """Repeated deliveries dropped; with an event time the state is bounded by how late a delivery may be."""
    if time is None:
        return pages.dropDuplicates([key])
    return pages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def host_counts(pages: DataFrame, url: str, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Pages by host and time window; late rows within the watermark still count."""
    host = F.regexp_extract(F.col(url), r"^[a-z]+://([^/?#:]+)", 1)
    return pages.withWatermark(time, late).groupBy(F.window(time, window), host.alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def to_tables(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None):
    """A started query that appends to parquet and runs until what is there is done."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(partition) if partition else writer).start()
