"""Ad clicks: parsing, blacklist, running counts, province ranking, trend.

These work on batches. The streaming jobs apply the same functions, and
``clicks_per_minute`` and ``running_click_counts`` also take a stream.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

USER_AD_KEYS = ("date", "userid", "adid")
STAT_KEYS = ("date", "province", "city", "adid")
PROVINCE_KEYS = ("date", "province", "adid")
TREND_KEYS = ("date", "hour", "minute", "adid")

# Epoch milliseconds of the first and last representable instant
# (years 1 to 9999).
_MIN_MILLIS = -62135596800000
_MAX_MILLIS = 253402300799999


def _fields(lines: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Column, list[Column]]:
    """Lines split once, the test for a whole line, and the click's columns.

    The split goes through ``explode``: as a plain column it would be merged
    into the test and into every field, and run once for each.
    """
    parts = lines.select(*keep, F.explode(F.array(F.split("value", " ", 5))).alias("parts"))
    province, city = F.get("parts", F.lit(1)), F.get("parts", F.lit(2))
    millis = F.get("parts", F.lit(0)).try_cast("bigint")
    userid = F.get("parts", F.lit(3)).try_cast("bigint")
    adid = F.get("parts", F.lit(4)).try_cast("bigint")
    valid = millis.between(_MIN_MILLIS, _MAX_MILLIS) & userid.isNotNull() & adid.isNotNull()
    ts = F.timestamp_millis(millis)
    columns = [
        ts.alias("ts"),
        F.to_date(ts).alias("date"),
        province.alias("province"),
        city.alias("city"),
        userid.alias("userid"),
        adid.alias("adid"),
    ]
    return parts, F.coalesce(valid, F.lit(False)), columns


def _line_counts(valid: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("lines"), F.count_if(~valid).alias("malformed")]


def parse_ad_lines(
    lines: DataFrame, counts: Observation | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``epoch_ms province city userid adid`` lines as typed clicks, after the columns in ``keep``.

    Lines that do not parse are left out; ``malformed_line_count`` tells how
    many. An observation gets the same numbers while the clicks are computed.
    """
    parts, valid, columns = _fields(lines, keep)
    if counts is not None:
        parts = parts.observe(counts, *_line_counts(valid))
    return parts.where(valid).select(*keep, *columns)


def malformed_line_count(lines: DataFrame) -> DataFrame:
    parts, valid, _ = _fields(lines)
    return parts.agg(*_line_counts(valid))


def blacklist_filter(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of users not on the blacklist."""
    return clicks.join(blacklist.select("userid"), "userid", "left_anti")


def _counted(clicks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return clicks.groupBy(*keys).agg(F.count(F.lit(1)).alias("click_count"))


def ad_user_click_counts(clicks: DataFrame) -> DataFrame:
    """Clicks per date, user and ad."""
    return _counted(clicks, USER_AD_KEYS)


def blacklist_candidates(totals: DataFrame, threshold: int) -> DataFrame:
    """Date, user and ad keys whose total has reached the threshold."""
    return totals.where(F.col("click_count") >= threshold)


def blacklist_users(candidates: DataFrame) -> DataFrame:
    return candidates.select("userid").distinct()


def running_click_counts(clicks: DataFrame) -> DataFrame:
    """Clicks per date, province, city and ad."""
    return _counted(clicks, STAT_KEYS)


def province_counts(stats: DataFrame) -> DataFrame:
    """City counts rolled up to provinces."""
    return stats.groupBy(*PROVINCE_KEYS).agg(F.sum("click_count").alias("click_count"))


def province_top_ads(counts: DataFrame, k: int = 3, scope: tuple = ("date", "province")) -> DataFrame:
    """The ``k`` ads with most clicks per date and province.

    ``scope=("province",)`` ranks over all dates of a province together.
    """
    order = [F.desc("click_count"), "adid"] + [c for c in ("date",) if c not in scope]
    return (
        counts.withColumn("_rank", F.row_number().over(W.partitionBy(*scope).orderBy(*order)))
        .where(F.col("_rank") <= k)
        .select(*PROVINCE_KEYS, "click_count")
    )


def clicks_per_minute(clicks: DataFrame) -> DataFrame:
    """Clicks per minute and ad, by event time."""
    minute = F.window("ts", "1 minute")
    return (
        clicks.groupBy(minute, "adid")
        .agg(F.count(F.lit(1)).alias("click_count"))
        .select(
            F.to_date("window.start").alias("date"),
            F.date_format("window.start", "HH").alias("hour"),
            F.date_format("window.start", "mm").alias("minute"),
            "adid",
            "click_count",
        )
    )


def clicks_sliding(
    clicks: DataFrame, length_seconds: int = 3600, slide_seconds: int = 600
) -> DataFrame:
    """Clicks per ad in every sliding window.

    A click falls into ``length / slide`` windows. Counting first in the
    largest steps that all window edges fall on means that only counts, not
    clicks, are copied into the windows.
    """
    steps = clicks_per_step(clicks, gcd(length_seconds, slide_seconds))
    return windows_of_steps(steps, length_seconds, slide_seconds)


def clicks_per_step(clicks: DataFrame, step_seconds: int) -> DataFrame:
    """Clicks per ad in steps that follow each other."""
    return (
        clicks.groupBy(F.window("ts", f"{step_seconds} seconds").alias("_step"), "adid")
        .agg(F.count(F.lit(1)).alias("click_count"))
        .select(F.col("_step.start").alias("step_start"), "adid", "click_count")
    )


def windows_of_steps(steps: DataFrame, length_seconds: int, slide_seconds: int) -> DataFrame:
    """Sliding windows over counts per step; all window edges must be edges of steps."""
    window = F.window("step_start", f"{length_seconds} seconds", f"{slide_seconds} seconds")
    return (
        steps.groupBy(window, "adid")
        .agg(F.sum("click_count").alias("click_count"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "adid",
            "click_count",
        )
    )
