"""The result tables of the ad-click streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators import clicks as ops
from clickloom.streaming import batchlog
from clickloom.streaming.batchlog import BatchLog

_TYPES = {
    "date": T.DateType(),
    "province": T.StringType(),
    "city": T.StringType(),
    "hour": T.StringType(),
    "minute": T.StringType(),
    "step_start": T.TimestampType(),
    "userid": T.LongType(),
    "adid": T.LongType(),
    "click_count": T.LongType(),
    "lines": T.LongType(),
    "malformed": T.LongType(),
    "ts": T.TimestampType(),
    "window_start": T.TimestampType(),
    "window_end": T.TimestampType(),
    "start_time": T.TimestampType(),
    "end_time": T.TimestampType(),
    "as_of": T.TimestampType(),
    "expired": T.BooleanType(),
}
STEP_KEYS = ("date", "step_start", "adid")
WINDOW_KEYS = ("date", "window_start", "window_end", "adid")
SESSION_KEYS = ("date", "userid", "start_time", "end_time")
ARRIVAL_KEYS = ("date", "as_of", "adid", "expired")


def _schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[n]) for n in names])


@dataclass(frozen=True)
class AdTables:
    """Where each table is kept and how its batches combine.

    ``line_counts`` holds the lines and malformed lines that each batch read.
    """

    blacklist: BatchLog
    user_clicks: BatchLog
    stats: BatchLog
    province_top: BatchLog
    trend: BatchLog
    steps: BatchLog
    line_counts: BatchLog

    @classmethod
    def below(cls, path: str, compact_every: int = 100) -> AdTables:
        def log(name, keys, fold, value=("click_count",)):
            return BatchLog(
                f"{path}/{name}", _schema(*keys, *value), fold, "date" in keys, compact_every
            )

        def counts(name, keys):
            return log(name, keys, batchlog.summed(keys, "click_count"))

        return cls(
            log("ad_blacklist", ("userid",), batchlog.distinct(("userid",)), ()),
            counts("ad_user_click_count", ops.USER_AD_KEYS),
            counts("ad_stat", ops.STAT_KEYS),
            log(
                "ad_province_top3",
                ops.PROVINCE_KEYS,
                batchlog.latest_groups(("date", "province")),
            ),
            counts("ad_click_trend", ops.TREND_KEYS),
            counts("ad_click_steps", STEP_KEYS),
            log("ad_line_counts", (), batchlog.summed((), ("lines", "malformed")), ("lines", "malformed")),
        )


def _counts(path: str, keys: tuple[str, ...], fold: batchlog.Fold, compact_every: int) -> BatchLog:
    return BatchLog(path, _schema(*keys, "click_count"), fold, True, compact_every)


def state_totals(path: str, compact_every: int = 100) -> BatchLog:
    """Running totals that a stateful stream writes whenever they change."""
    keys = ops.STAT_KEYS
    return _counts(path, keys, batchlog.latest(keys, "click_count"), compact_every)


def unique_totals(path: str, compact_every: int = 100) -> BatchLog:
    keys = ops.STAT_KEYS
    return _counts(path, keys, batchlog.summed(keys, "click_count"), compact_every)


def closed_sessions(path: str, compact_every: int = 100) -> BatchLog:
    return _counts(path, SESSION_KEYS, batchlog.latest(SESSION_KEYS, "click_count"), compact_every)


def arrival_totals(path: str, compact_every: int = 100) -> BatchLog:
    return _counts(path, ARRIVAL_KEYS, batchlog.latest(ARRIVAL_KEYS, "click_count"), compact_every)


@dataclass(frozen=True)
class LateTables:
    """Window counts on time and late, and the greatest click time of each batch."""

    on_time: BatchLog
    late: BatchLog
    tops: BatchLog

    @classmethod
    def below(cls, path: str, compact_every: int = 100) -> LateTables:
        fold = batchlog.summed(WINDOW_KEYS, "click_count")
        top = lambda rows: rows.agg(F.max("ts").alias("ts"))
        return cls(
            _counts(f"{path}/on_time", WINDOW_KEYS, fold, compact_every),
            _counts(f"{path}/late", WINDOW_KEYS, fold, compact_every),
            BatchLog(f"{path}/tops", _schema("ts"), top, False, compact_every),
        )
