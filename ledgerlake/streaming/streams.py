"""Structured Streaming: accepting bills, auditing micro-batches, following progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import mask
from ledgerlake.operators.intake import validate_lines
from ledgerlake.plans.scratch import stored


def stream_intake(spark: SparkSession, path: str, schema: str, column: str = "text", files: int = 100) -> DataFrame:
    """Bills as they arrive as JSON, with identifiers masked before anything is stored."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    return stream.withColumn(column, mask(F.col(column)))


def stream_audit(stream: DataFrame, audit: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, keys: tuple = ("bill_id", "line_no")):
    """Audit each micro-batch; valid lines go to ``target``, rejected ones aside.

    A batch writes its own folder, so a repeated batch overwrites what it wrote before. The
    source is read, and what the stream does to it is done, once: the batch is written to
    ``target``/held, and so are its valid lines without repeats, which ``audit`` gets.
    """

    def each(batch: DataFrame, number: int) -> None:
        valid, rejected = validate_lines(stored(batch, f"{target}/held/batch={number}"))
        once = stored(valid.dropDuplicates(list(keys)), f"{target}/once/batch={number}")
        audit(once).write.mode("overwrite").parquet(f"{target}/valid/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame) -> DataFrame:
    """(job, done, total, status): completions of each job and its latest status; batch and stream alike."""
    return events.groupBy("job").agg(
        F.count_if(F.col("status") == "purchase").alias("done"), F.count(F.lit(1)).alias("total"), F.max_by("status", F.struct("ts", "event_id")).alias("status")
    )


def stream_progress(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, job, done, total, status, last): progress by day of a stream of (job, status, ts, event_id).

    The watermark lets finished days go from the state; what arrives later than that for
    such a day is left out (and counted by Spark in the query's progress).
    """
    day, order = F.window("ts", "1 day").alias("day"), F.struct("ts", "event_id")
    return events.withWatermark("ts", late).groupBy(day, "job").agg(
        F.count_if(F.col("status") == "purchase").alias("done"), F.count(F.lit(1)).alias("total"), F.max_by("status", order).alias("status"), F.max(order).alias("last")
    )


def follow_progress(events: DataFrame, target: str, checkpoint: str, late: str = "1 hour"):
    """Write what changes in each micro-batch, a folder for each, so that a repeated batch overwrites what it wrote before."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream_progress(events, late).writeStream.outputMode("update").foreachBatch(each)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_progress(updates: DataFrame) -> DataFrame:
    """(job, done, total, status) from the updates (with their ``batch``): the last one of each day, and all days of a job."""
    latest = updates.groupBy("job", "day").agg(F.max_by(F.struct("done", "total", "status", "last"), "batch").alias("u"))
    return latest.groupBy("job").agg(F.sum("u.done").alias("done"), F.sum("u.total").alias("total"), F.max_by("u.status", "u.last").alias("status"))
