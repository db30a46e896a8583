"""Event-time operators on Structured Streaming, and resumable incremental reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by type in tumbling or sliding event-time windows; events later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, user: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a gap: start, end, events."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(user, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; in a stream, repeats within the watermark are suppressed and the state stays bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all that is there, then stop; the checkpoint makes the next run go on where this one ended."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def follow_files(spark: SparkSession, folder: str, schema: str, fmt: str = "json") -> DataFrame:
    """A stream of the files that appear in a folder."""
    return spark.readStream.schema(schema).format(fmt).load(folder)


def resume_log(spark: SparkSession, arrivals: DataFrame, log: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """Append-only processing with resume: of each batch, ids already accepted in the log are skipped, rejected ones tried
    again. process gives sample_id, reason (null: accepted) and payload columns."""
    from quern.sources.readers import completed_ids, not_done
    from quern.sources.writers import write_log

    def each(batch: DataFrame, _: int) -> None:
        todo = not_done(batch.dropDuplicates(["sample_id"]), completed_ids(spark, log), "sample_id")
        write_log(process(todo), "reason", log)

    run_available(arrivals, checkpoint, each)


def register_metric(spark: SparkSession, name: str, metric, kind: str = "double") -> None:
    """A metric function over pandas series, callable by name from SQL."""
    spark.udf.register(name, F.pandas_udf(metric, kind))
