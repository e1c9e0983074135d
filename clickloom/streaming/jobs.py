"""The ad-click streams: blacklist with running counts, click trend, sliding windows.

Every job counts a micro-batch's clicks and adds the counts to a result table, so
no click is late: there is no watermark and nothing is dropped. Lines that do not
parse are counted per batch in ``line_counts``.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from clickloom.operators import clicks as ops
from clickloom.operators import keyed
from clickloom.streaming.batchlog import BatchLog
from clickloom.streaming.tables import STEP_KEYS, AdTables

THRESHOLD = 100
INTERVAL = "5 seconds"
# The trend counts the last hour, every ten seconds.
WINDOW_SECONDS, SLIDE_SECONDS = 3600, 10


def start_query(writer: DataStreamWriter, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Start with a checkpoint, so a restart goes on where the last run stopped.

    Without an interval the query handles what is there and ends. Batch numbers
    come from the checkpoint and name the folders of the result tables, so the
    two belong together: start both anew or neither.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def _each_batch(
    lines: DataFrame, tables: AdTables, handle: Callable[[DataFrame, int], None]
) -> DataStreamWriter:
    """Parse each micro-batch once, handle its clicks, and note how many lines it had."""

    def run(batch: DataFrame, batch_id: int) -> None:
        counts = Observation()
        clicks = ops.parse_ad_lines(batch, counts).persist()
        try:
            clicks.count()
            handle(clicks, batch_id)
        finally:
            clicks.unpersist()
        seen = [(counts.get["lines"], counts.get["malformed"])]
        rows = batch.sparkSession.createDataFrame(seen, tables.line_counts.schema)
        tables.line_counts.write(rows, batch_id)

    return lines.writeStream.foreachBatch(run)


def apply_ad_batch(
    batch: DataFrame, batch_id: int, tables: AdTables, threshold: int = THRESHOLD, k: int = 3
) -> None:
    """Everything one micro-batch of clicks changes.

    Drop clicks of blacklisted users, count the rest per user and ad, blacklist
    who has reached the threshold, count per city and ad, and rank the
    provinces that were touched. The tables are read as they were before this
    batch, so trying the batch again has the same effect. Of dated tables only the
    batch's dates are read.
    """
    spark = batch.sparkSession
    blacklist = tables.blacklist.current(spark, before=batch_id)
    kept = ops.blacklist_filter(batch, blacklist).persist()
    try:
        span = tuple(kept.agg(F.min("date"), F.max("date")).first())
        by_user = ops.ad_user_click_counts(kept).persist()
        totals = _touched_totals(tables.user_clicks, by_user, batch_id, span, ops.USER_AD_KEYS)
        reached = ops.blacklist_users(ops.blacklist_candidates(totals, threshold))
        tables.blacklist.write(keyed.only_new(blacklist, reached, ["userid"]), batch_id)
        tables.user_clicks.write(by_user, batch_id)
        by_user.unpersist()

        by_city = ops.running_click_counts(kept).persist()
        totals = _touched_totals(tables.stats, by_city, batch_id, span, ("date", "province"))
        top = ops.province_top_ads(ops.province_counts(totals), k)
        tables.province_top.write(top, batch_id)
        tables.stats.write(by_city, batch_id)
        by_city.unpersist()
    finally:
        kept.unpersist()


def _touched_totals(
    log: BatchLog, new: DataFrame, batch_id: int, span: tuple, touched: tuple
) -> DataFrame:
    """Totals of the keys, or groups of keys, that the new counts touch; ``span`` has their dates."""
    if span[0] is None:
        return new
    keys = new.select(*touched).distinct()
    stored = log.rows(new.sparkSession, before=batch_id, dates=span)
    stored = stored.join(keys, list(touched), "left_semi")
    return log.fold(stored.drop("batch_id").unionByName(new))


def start_ad_flow(
    lines: DataFrame,
    tables: AdTables,
    checkpoint: str,
    threshold: int = THRESHOLD,
    interval: str | None = INTERVAL,
    k: int = 3,
) -> StreamingQuery:
    """Blacklist, running counts and province ranking over a stream of log lines."""

    def handle(clicks: DataFrame, batch_id: int) -> None:
        apply_ad_batch(clicks, batch_id, tables, threshold, k)

    return start_query(_each_batch(lines, tables, handle), checkpoint, interval)


def start_ad_trend(
    lines: DataFrame, tables: AdTables, checkpoint: str, interval: str | None = "10 seconds"
) -> StreamingQuery:
    """Clicks per minute and ad, by event time."""

    def handle(clicks: DataFrame, batch_id: int) -> None:
        tables.trend.write(ops.clicks_per_minute(clicks), batch_id)

    return start_query(_each_batch(lines, tables, handle), checkpoint, interval)


def start_ad_stat(
    lines: DataFrame, tables: AdTables, checkpoint: str, interval: str | None = INTERVAL
) -> StreamingQuery:
    """Running counts alone, without the blacklist. Days are those of the session's time zone."""

    def handle(clicks: DataFrame, batch_id: int) -> None:
        tables.stats.write(ops.running_click_counts(clicks), batch_id)

    return start_query(_each_batch(lines, tables, handle), checkpoint, interval)


def start_ad_sliding(
    lines: DataFrame,
    tables: AdTables,
    checkpoint: str,
    length_seconds: int = WINDOW_SECONDS,
    slide_seconds: int = SLIDE_SECONDS,
    interval: str | None = "10 seconds",
) -> StreamingQuery:
    """Clicks per ad in sliding windows by event time, kept as counts per step.

    A step is the largest on which all window edges fall; ``sliding_windows`` forms the
    windows when the table is read.
    """
    step = gcd(length_seconds, slide_seconds)

    def handle(clicks: DataFrame, batch_id: int) -> None:
        steps = ops.clicks_per_step(clicks, step)
        dated = steps.select(
            F.to_date("step_start").alias("date"), "step_start", "adid", "click_count"
        )
        tables.steps.write(dated.select(*STEP_KEYS, "click_count"), batch_id)

    return start_query(_each_batch(lines, tables, handle), checkpoint, interval)


def sliding_windows(
    steps: DataFrame, length_seconds: int = WINDOW_SECONDS, slide_seconds: int = SLIDE_SECONDS
) -> DataFrame:
    """Windows of the stored step counts; limit the steps first to see recent windows only."""
    return ops.windows_of_steps(steps, length_seconds, slide_seconds)
