"""Event-time windows with a rule for late clicks: counted on time, or counted as late.

Spark's own watermark drops late rows and tells only how many groups it dropped. Here the
watermark of a batch is the greatest click time of the batches before it, less the lateness
allowed, and every click of the batch is either on time or goes to a side table, so the two
always add up to all clicks.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators import clicks as ops
from clickloom.streaming.batchlog import BatchLog
from clickloom.streaming.jobs import INTERVAL, start_query
from clickloom.streaming.tables import LateTables


def watermark(
    tops: BatchLog, spark: SparkSession, lateness_seconds: int, before: int | None = None
) -> datetime | None:
    """The watermark after all finished batches, or as a batch saw it; None if there was no click."""
    top = tops.rows(spark, before).agg(F.max("ts")).first()[0]
    return None if top is None else top - timedelta(seconds=lateness_seconds)


def apply_window_batch(
    clicks: DataFrame,
    batch_id: int,
    tables: LateTables,
    window_seconds: int,
    lateness_seconds: int,
) -> None:
    """Count a batch's clicks per window and ad, on time or late.

    A click is late if its window had ended by the watermark. The tables are read as they
    were before this batch, so trying it again has the same effect.
    """
    spark = clicks.sparkSession
    limit = watermark(tables.tops, spark, lateness_seconds, before=batch_id)
    steps = ops.clicks_per_step(clicks, window_seconds).withColumn(
        "window_end", F.col("step_start") + F.make_interval(secs=F.lit(window_seconds))
    )
    late = F.lit(False) if limit is None else F.col("window_end") <= F.lit(limit)
    counted = steps.select(
        F.to_date("step_start").alias("date"),
        F.col("step_start").alias("window_start"),
        "window_end",
        "adid",
        "click_count",
        late.alias("late"),
    ).persist()
    try:
        tables.on_time.write(counted.where("not late").drop("late"), batch_id)
        tables.late.write(counted.where("late").drop("late"), batch_id)
        tables.tops.write(clicks.agg(F.max("ts").alias("ts")).where("ts is not null"), batch_id)
    finally:
        counted.unpersist()


def start_windows(
    lines: DataFrame,
    tables: LateTables,
    checkpoint: str,
    window_seconds: int = 3600,
    lateness_seconds: int = 600,
    interval: str | None = INTERVAL,
) -> StreamingQuery:
    """Window counts over a stream of log lines, late clicks in a table of their own."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        clicks = ops.parse_ad_lines(batch).persist()
        try:
            apply_window_batch(clicks, batch_id, tables, window_seconds, lateness_seconds)
        finally:
            clicks.unpersist()

    return start_query(lines.writeStream.foreachBatch(handle), checkpoint, interval)


def closed_windows(tables: LateTables, spark: SparkSession, lateness_seconds: int) -> DataFrame:
    """Window counts that can no longer change: the watermark has passed their end."""
    limit = watermark(tables.tops, spark, lateness_seconds)
    closed = F.lit(False) if limit is None else F.col("window_end") <= F.lit(limit)
    return tables.on_time.current(spark).where(closed)


def reconciled(tables: LateTables, spark: SparkSession) -> DataFrame:
    """(window_start, window_end, adid, on_time, late) of every window and ad; none is lost."""
    keys = ["window_start", "window_end", "adid"]
    zero = F.lit(0).cast("bigint")
    sides = tables.on_time.current(spark).select(
        *keys, F.col("click_count").alias("on_time"), zero.alias("late")
    ).unionByName(
        tables.late.current(spark).select(
            *keys, zero.alias("on_time"), F.col("click_count").alias("late")
        )
    )
    return sides.groupBy(*keys).agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))
