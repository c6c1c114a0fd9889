"""Micro-batch ingest of image sidecars as a structured stream.

The file source keeps the log of files seen; the state of consumed URLs and
content hashes is a table that each micro-batch is checked against, so a
replayed batch gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import SIDECAR_SCHEMA


def sidecar_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Successful sidecars of a folder as they appear."""
    reader = spark.readStream.schema(SIDECAR_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).where("status = 'success'")


def join_captions(stream: DataFrame, captions: DataFrame) -> DataFrame:
    """Stream-static join by URL with the last caption of each URL."""
    last = captions.groupBy("url").agg(F.max_by("text", "row_no").alias("text"))
    return stream.join(last, "url")


def deduplicated(stream: DataFrame, within: str | None = None, time: str = "ts") -> DataFrame:
    """First row per content hash; with ``within`` state older than that event-time span is dropped."""
    if within is None:
        return stream.dropDuplicates(["md5"])
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(["md5"])


def first_success(batch: DataFrame, seen: DataFrame | None, pairs: bool = False) -> DataFrame:
    """A batch's rows whose URL and hash weren't seen: one per hash and one per URL, the least first.

    With ``pairs``, one per URL and hash together: a hash comes again under another URL, a URL with another hash.
    """
    if pairs:
        rows = batch if seen is None else batch.join(seen.select("url", "md5"), ["url", "md5"], "left_anti")
        return rows.groupBy("url", "md5").agg(F.min("text").alias("text"))
    rows = batch if seen is None else batch.join(seen.select("url"), "url", "left_anti").join(seen.select("md5"), "md5", "left_anti")
    rows = rows.groupBy("md5").agg(F.min_by(F.struct("url", "text"), "url").alias("r")).select("md5", "r.*")
    return rows.groupBy("url").agg(F.min_by(F.struct("md5", "text"), "md5").alias("r")).select("url", "r.*")


def run_ingest(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, pairs: bool = False) -> None:
    """Drains what the stream has now, appending rows numbered from 0 to a Parquet table partitioned by batch.

    A batch overwrites its own partition, so it may run twice; ``pairs`` as in ``first_success``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = None
        try:
            old = spark.read.schema("url string, md5 string, text string, row_idx bigint, batch bigint").parquet(path).where(F.col("batch") < batch_id)
            seen, start = old, old.agg(F.coalesce(F.max("row_idx") + 1, F.lit(0))).first()[0]
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            start = 0
        new = first_success(batch, seen, pairs)
        parts = new.withColumn("p", F.pmod(F.xxhash64("url"), F.lit(256)))
        counts = parts.groupBy("p").agg(F.count(F.lit(1)).alias("c")).withColumn("at", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        numbered = parts.join(counts.drop("c"), "p").withColumn("row_idx", F.row_number().over(Window.partitionBy("p").orderBy("url", "md5")) - 1 + F.col("at") + F.lit(start))
        numbered.select("url", "md5", "text", F.col("row_idx").cast("bigint").alias("row_idx")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if sink is not None:
            sink(new, batch_id)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events in tumbling event-time windows, with a watermark on streams. An extension for tables with a time."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
