"""Jobs over date and time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import times


def date_diff_features(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every difference from time column ``a`` to time column ``b``."""
    x, y = F.col(a), F.col(b)
    return df.withColumns(
        {
            "diff_hours": times.hours_between(x, y),
            "diff_minutes": times.minutes_between(x, y),
            "diff_seconds": times.seconds_between(x, y),
            "diff_full_days": times.full_days_between(x, y),
            "diff_calendar_days": times.calendar_days_between(x, y).cast("bigint"),
            "diff_period": times.period_between(x, y),
            "completed_years": times.completed_years(x, y).cast("bigint"),
            "time_order": times.time_order(x, y).cast("bigint"),
        }
    )


def date_part_features(df: DataFrame, c: str, days: int = 7, years: int = 1) -> DataFrame:
    """Calendar columns derived from time column ``c``."""
    t = F.col(c)
    return df.withColumns(
        {
            "time_text": times.format_time(t),
            "parsed_time": times.parse_time(times.format_time(t)),
            "day_start": times.day_start(t),
            "next_day_start": times.next_day_start(t),
            "previous_day_end": times.previous_day_end(t),
            "plus_days": times.plus_days(t, days),
            "plus_years": times.plus_years(t, years),
            "weekday": times.weekday_number(t).cast("bigint"),
            "weekday_name": times.weekday_name(t),
            "date_hour": times.date_hour(t),
        }
    )


def calendar_spine(daily: DataFrame, date: str, metrics: list[str]) -> DataFrame:
    """Every day from the first to the last, days without a row as 0."""
    span = daily.agg(F.min(date).alias("_low"), F.max(date).alias("_high"))
    spine = span.where(F.col("_low").isNotNull()).select(
        F.explode(F.sequence("_low", "_high", F.make_dt_interval(days=F.lit(1)))).alias(date)
    )
    filled = spine.join(daily, date, "left")
    return filled.select(date, *[F.coalesce(m, F.lit(0)).alias(m) for m in metrics])


def week_calendar(df: DataFrame, date: str) -> DataFrame:
    """The seven dates, Monday to Sunday, of every week that occurs."""
    weeks = df.select(F.trunc(date, "week").alias("week_start")).distinct()
    return weeks.select("week_start", F.explode(times.week_dates(F.col("week_start"))).alias(date))


def stepped_calendar(df: DataFrame, date: str, n: int, step: int) -> DataFrame:
    """For every date that occurs, ``n`` dates ``step`` days apart, ascending."""
    starts = df.select(F.col(date).alias("start_date")).distinct()
    return starts.select(
        "start_date",
        F.posexplode(times.stepped_dates(F.col("start_date"), n, step)).alias("position", date),
    )


def date_validity_report(df: DataFrame, time_text: Column, date_text: Column) -> DataFrame:
    """How many texts are real times and real dates."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(times.is_valid_time(time_text)).alias("valid_times"),
        F.count_if(~times.is_valid_time(time_text)).alias("invalid_times"),
        F.count_if(times.is_valid_date(date_text)).alias("valid_dates"),
        F.count_if(~times.is_valid_date(date_text)).alias("invalid_dates"),
    )
