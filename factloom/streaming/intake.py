"""Intake of captured pages as a stream of files.

`Trigger.AvailableNow` by default: a scheduled run takes what has arrived since
the last one and stops. Each micro-batch is the batch pipeline: pages become
sections, articles become events, and both are appended. A page that arrives
again within the watermark, by id and content, is dropped; what was appended for
a batch is found again by its number, so a batch that is repeated after a loss
replaces its own rows and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources import gazette, pages

PAGE = "page_id long, url string, html string, captured_at timestamp"


def arrivals(spark: SparkSession, folder: str, late: str = "7 days") -> DataFrame:
    """Pages of the folder's Parquet files as they come, each content of a page once within the watermark."""
    read = spark.readStream.schema(PAGE).parquet(folder)
    keyed = read.withColumn("sha256", F.sha2(F.coalesce("html", F.lit("")), 256))
    return keyed.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["page_id", "sha256"])


def facts(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, events) of pages: what one micro-batch appends."""
    sections = pages.page_sections(batch)
    articles = sections.where(F.col("type") == "ARTICLE").select(F.col("page_id").alias("article_id"), "text")
    return sections, gazette.article_events(articles).withColumnRenamed("article_id", "page_id")


def start(arriving: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append sections and events of every micro-batch under `out`, in folders by batch number."""

    def write(batch: DataFrame, number: int) -> None:
        sections, events = facts(batch)
        for name, rows in (("sections", sections), ("events", events)):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    writer = arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(arriving: DataFrame, width: str = "1 day") -> DataFrame:
    """Pages by host and window of capture, final once the watermark has passed."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return arriving.groupBy(F.window("captured_at", width), host.alias("host")).agg(F.count(F.lit(1)).alias("pages"))
