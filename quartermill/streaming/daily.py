"""Streams of daily short volume and of amended holdings (extensions: the batch plans have no streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.promote import append_is_latest


def events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the event files that a folder gets."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder)


def first_rows(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first row of each event id within the watermark, as an insert-or-ignore would keep."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_volume(stream: DataFrame, size: str = "1 day", slide: str | None = None, delay: str = "2 days") -> DataFrame:
    """Volume by ticker and tumbling or sliding window; late rows count until the watermark passes."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    ticker = F.concat(F.lit("P"), F.lpad((F.col("user_id") % 40).cast("string"), 2, "0"))
    rows = stream.withWatermark("ts", delay).groupBy(window.alias("w"), ticker.alias("ticker"))
    short = F.when(F.col("event_type").isin("error", "purchase"), F.round(F.col("value") * 100).cast("bigint")).otherwise(0)
    return rows.agg(F.sum(short).alias("short_volume"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total_volume")).select("ticker", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "short_volume", "total_volume")


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "2 days") -> DataFrame:
    """Sessions of each user: rows no further apart than the gap."""
    rows = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return rows.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "cents")


def amend(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: list[str], checkpoint: str) -> StreamingQuery:
    """Promotes each micro-batch of amended rows: prior rows of its keys turn stale.

    ``write`` gets the new version with the batch's number; a batch that runs
    again after a failure reads the same version and writes the same number.
    """

    def promote(batch: DataFrame, number: int) -> None:
        write(append_is_latest(read(), batch, keys), number)

    return stream.writeStream.foreachBatch(promote).option("checkpointLocation", checkpoint).start()
