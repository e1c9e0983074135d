"""Ad-click streams that keep their counts in Spark's state store.

The running count keeps a state row per key until the watermark has passed its day; the
de-duplication forgets a line when the watermark has passed it; the arrival trend keeps an
hour of minute counts for every ad and a timer for each. So state is bounded by the traffic
of the lateness allowed and does not grow with history. Use the RocksDB provider of
``runtime.RECOMMENDED_CONF``; the arrival trend, which cannot do without, sets it itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from clickloom.operators import clicks as ops
from clickloom.operators import gaps
from clickloom.runtime import RECOMMENDED_CONF
from clickloom.streaming.batchlog import BatchLog
from clickloom.streaming.jobs import INTERVAL, start_query

LATENESS = "2 days"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HOUR_MINUTES = 60
_MINUTE_MILLIS = 60_000


def running_state_counts(clicks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Running clicks per date, province, city and ad over a stream of clicks.

    The watermark is on the day, so a day's counts leave the state once ``lateness``
    has passed it; clicks later than that are not counted.
    """
    days = clicks.withColumn("day", F.date_trunc("day", "ts")).withWatermark("day", lateness)
    counted = days.groupBy("day", *ops.STAT_KEYS[1:]).agg(F.count(F.lit(1)).alias("click_count"))
    return counted.select(F.to_date("day").alias("date"), *ops.STAT_KEYS[1:], "click_count")


def start_ad_stat_state(
    lines: DataFrame,
    table: BatchLog,
    checkpoint: str,
    lateness: str = LATENESS,
    interval: str | None = INTERVAL,
) -> StreamingQuery:
    """Running counts kept as state; each batch writes the totals that it changed.

    ``table`` keeps the latest total of a key (``batchlog.latest``).
    """
    totals = running_state_counts(ops.parse_ad_lines(lines), lateness)
    writer = totals.writeStream.outputMode("update").foreachBatch(table.write)
    return start_query(writer, checkpoint, interval)


def start_unique_ad_stat(
    lines: DataFrame,
    table: BatchLog,
    checkpoint: str,
    lateness: str = LATENESS,
    interval: str | None = INTERVAL,
) -> StreamingQuery:
    """Counts of lines that may be delivered more than once, as after a restart further back.

    A click equal in all its columns to an earlier one is not counted again if it comes within
    ``lateness`` of it; the state forgets a click when the watermark has passed it by that.
    ``table`` adds up (``batchlog.summed``).
    """
    clicks = ops.parse_ad_lines(lines).withWatermark("ts", lateness)
    unique = clicks.dropDuplicatesWithinWatermark(["ts", "province", "city", "userid", "adid"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.write(ops.running_click_counts(batch), batch_id)

    return start_query(unique.writeStream.foreachBatch(handle), checkpoint, interval)


def start_click_sessions(
    lines: DataFrame,
    table: BatchLog,
    checkpoint: str,
    idle_seconds: int = gaps.IDLE_SECONDS,
    lateness: str = "10 minutes",
    interval: str | None = INTERVAL,
) -> StreamingQuery:
    """Sessions of users by idle time, written once the watermark has passed their end."""
    clicks = ops.parse_ad_lines(lines).withWatermark("ts", lateness)
    closed = gaps.click_sessions(clicks, idle_seconds).withColumn("date", F.to_date("start_time"))
    return start_query(
        closed.writeStream.outputMode("append").foreachBatch(table.write), checkpoint, interval
    )


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """RocksDB for queries started within, whatever the session names.

    ``transformWithState`` keeps its map and timers in column families, which Spark's default
    provider refuses. A query takes the setting over when it starts.
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, RECOMMENDED_CONF[_PROVIDER])
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _last_hour() -> StatefulProcessor:
    """The processor of the arrival trend.

    Its class is made here so that Spark's workers get it whole: the one that prepares the state
    on the driver does not find this package where only executors are told of it.
    """

    class LastHour(StatefulProcessor):
        """Clicks of an ad that arrived in the last hour, as minute counts with a timer each.

        Gives (adid, as_of, click_count, expired) for the latest arrival of a batch, and
        again, with ``expired``, whenever a minute has left the hour.
        """

        def init(self, handle) -> None:
            self.handle = handle
            self.minutes = handle.getMapState("minutes", "minute long", "clicks long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
            latest = 0
            for row in rows:
                minute = row.arrived_millis // _MINUTE_MILLIS
                latest = max(latest, row.arrived_millis)
                if self.minutes.containsKey((minute,)):
                    clicks = self.minutes.getValue((minute,))[0]
                else:
                    clicks = 0
                    self.handle.registerTimer((minute + HOUR_MINUTES) * _MINUTE_MILLIS)
                self.minutes.updateValue((minute,), (clicks + row.click_count,))
            yield self._total(key, latest, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
            millis = expiredTimerInfo.getExpiryTimeInMs()
            gone = millis // _MINUTE_MILLIS - HOUR_MINUTES
            for (minute,) in list(self.minutes.keys()):
                if minute <= gone:
                    self.minutes.removeKey((minute,))
            yield self._total(key, millis, True)

        def close(self) -> None:
            pass

        def _total(self, key, millis: int, expired: bool) -> Row:
            last = millis // _MINUTE_MILLIS
            clicks = sum(
                n for (minute,), (n,) in self.minutes.iterator() if last - HOUR_MINUTES < minute <= last
            )
            return Row(adid=key[0], as_of_millis=millis, click_count=clicks, expired=expired)

    return LastHour()


def arrival_trend(clicks: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Clicks of the last hour by arrival, for each ad that clicks arrive for or leave.

    ``clicks`` is a stream with ``adid`` and ``arrived``, the time at which the log took the
    line (Kafka's timestamp, a file's modification time), whatever time the click itself
    names. Clicks of an ad are handed to the state one row per batch row.
    """
    timed = clicks.withWatermark("arrived", lateness)
    rows = timed.select(
        "adid", "arrived", F.unix_millis("arrived").alias("arrived_millis"),
        F.lit(1).cast("bigint").alias("click_count"),
    )
    found = rows.groupBy("adid").transformWithState(
        _last_hour(),
        "adid bigint, as_of_millis bigint, click_count bigint, expired boolean",
        "Update",
        "EventTime",
    )
    return found.select(
        F.to_date(F.timestamp_millis("as_of_millis")).alias("date"),
        F.timestamp_millis("as_of_millis").alias("as_of"),
        "adid",
        "click_count",
        "expired",
    )


def start_arrival_trend(
    lines: DataFrame,
    table: BatchLog,
    checkpoint: str,
    lateness: str = "0 seconds",
    interval: str | None = "10 seconds",
) -> StreamingQuery:
    """The arrival trend of a stream of (value, arrived) lines."""
    clicks = ops.parse_ad_lines(lines, keep=("arrived",))
    trend = arrival_trend(clicks, lateness)
    with _rocksdb(lines.sparkSession):
        return start_query(
            trend.writeStream.outputMode("update").foreachBatch(table.write), checkpoint, interval
        )
