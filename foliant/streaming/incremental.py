"""Keeping a scoreboard up to date from a stream of result rows or of arriving documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.sources.keyed_table import BUCKETS, KeyedTable


def upsert_stream(rows: DataFrame, path: str, key: list[str], by: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Puts each micro-batch's last row of each key (by *by*) into the table at *path*; only buckets with such keys are rewritten.

    A batch is a version of the table, so one that runs again changes nothing; versions before the last two are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = KeyedTable(batch.sparkSession, path, key, buckets)
        kept.upsert(batch, by, number + 1)
        kept.vacuum()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS) -> DataFrame | None:
    """The table as the last batch left it; None before the first one."""
    return KeyedTable(spark, path, key, buckets).read()


def windowed_counts(rows: DataFrame, time: str, by: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by tumbling window and *by*, with a watermark for late rows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")


def new_documents(spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Extraction of PDF files as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return extract(files)
