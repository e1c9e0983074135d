"""Date and time column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of stored times.
DATE_TIME = "yyyy-MM-dd HH:mm:ss"
# Day names, Sunday first.
DAY_NAMES = ("星期日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六")


def parse_time(c: Column, pattern: str = DATE_TIME) -> Column:
    """Text to timestamp; NULL where it does not parse."""
    return F.try_to_timestamp(c, F.lit(pattern))


def format_time(c: Column, pattern: str = DATE_TIME) -> Column:
    return F.date_format(c, pattern)


def date_hour(c: Column) -> Column:
    """``yyyy-MM-dd_HH`` key."""
    return F.date_format(c, "yyyy-MM-dd'_'HH")


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b, with fraction."""
    return (F.unix_millis(b) - F.unix_millis(a)) / F.lit(3600000.0)


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b, truncated toward zero."""
    return F.timestamp_diff("MINUTE", a, b)


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def full_days_between(a: Column, b: Column) -> Column:
    """Whole 24-hour days from a to b; -1 if either is NULL."""
    return F.coalesce(F.timestamp_diff("DAY", a, b), F.lit(-1).cast("bigint"))


def calendar_days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def period_between(a: Column, b: Column) -> Column:
    """``years,months,days`` from date a to date b, as a calendar period.

    The day part counts from a moved forward by the whole months; in a
    backward period it counts within the month of b.
    """
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    days = F.dayofmonth(b) - F.dayofmonth(a)
    short = (months > 0) & (days < 0)
    over = (months < 0) & (days > 0)
    whole = F.when(short, months - 1).when(over, months + 1).otherwise(months)
    rest = (
        F.when(short, F.datediff(b, F.add_months(a, months - 1)))
        .when(over, days - F.dayofmonth(F.last_day(b)))
        .otherwise(days)
    )
    years = F.when(whole < 0, F.ceil(whole / 12)).otherwise(F.floor(whole / 12))
    return F.concat_ws(",", years.cast("string"), (whole % 12).cast("string"), rest.cast("string"))


def completed_years(birth: Column, on: Column) -> Column:
    """Age in completed years."""

    def day_of_year(c: Column) -> Column:
        return F.month(c) * 100 + F.dayofmonth(c)

    before = day_of_year(on) < day_of_year(birth)
    return F.year(on) - F.year(birth) - F.when(before, 1).otherwise(0)


def time_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is before, at or after b; 0 if either is NULL."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def compare_times(a: Column, b: Column, pattern: str = DATE_TIME) -> Column:
    """The same for two time texts; 0 if either does not parse."""
    return time_order(parse_time(a, pattern), parse_time(b, pattern))


def day_start(c: Column) -> Column:
    return F.date_trunc("day", c)


def next_day_start(c: Column) -> Column:
    return day_start(c) + F.make_interval(days=F.lit(1))


def previous_day_end(c: Column) -> Column:
    """23:59:59 of the day before."""
    return day_start(c) - F.make_interval(secs=F.lit(1))


def plus_days(c: Column, n: int) -> Column:
    return c + F.make_interval(days=F.lit(n))


def plus_years(c: Column, n: int) -> Column:
    return c + F.make_interval(years=F.lit(n))


def weekday_number(c: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(c) - 1


def weekday_name(c: Column) -> Column:
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.get(names, weekday_number(c))


def week_dates(c: Column) -> Column:
    """Monday to Sunday of the date's week; Sunday closes the week."""
    monday = F.trunc(c, "week")
    return F.sequence(monday, F.date_add(monday, 6))


def stepped_dates(start: Column, n: int, step: int) -> Column:
    """``n`` dates from ``start``, ``step`` days apart, ascending."""
    if n < 1:
        return F.array().cast("array<date>")
    if step == 0:
        return F.array_repeat(F.to_date(start), n)
    last = F.date_add(start, (n - 1) * step)
    low, high = (F.to_date(start), last) if step > 0 else (last, F.to_date(start))
    return F.sequence(low, high, F.make_dt_interval(days=F.lit(abs(step))))


def is_valid_time(c: Column) -> Column:
    """True for a real ``20yy-MM-dd HH:mm:ss`` time (one-digit months allowed)."""
    shape = r"^20[0-9]{2}-[0-9]{1,2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
    real = F.try_to_timestamp(c, F.lit("yyyy-M-dd HH:mm:ss")).isNotNull()
    return F.coalesce(c.rlike(shape) & real, F.lit(False))


def is_valid_date(c: Column) -> Column:
    """True for a real ``20yy-MM-dd`` date (one-digit months allowed)."""
    shape = r"^20[0-9]{2}-[0-9]{1,2}-[0-9]{2}$"
    real = F.try_to_timestamp(c, F.lit("yyyy-M-dd")).isNotNull()
    return F.coalesce(c.rlike(shape) & real, F.lit(False))
