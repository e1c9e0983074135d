import calendar as pycalendar
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.functions import buckets, numbers, text, times


@pytest.mark.parametrize(
    "value, expected",
    [
        ("1,2", [1, 2]),
        (",1,2,", [None, 1, 2, None]),
        ("1,,2", [1, None, 2]),
        ("1,x", [1, None]),
        ("", None),
        ("  ", None),
        (None, None),
    ],
)
def test_id_list(one, value, expected):
    assert one(text.id_list(F.lit(value).cast("string"))) == expected


def test_trim_comma_strips_one_at_both_ends(one):
    got = one(*[text.trim_comma(F.lit(v)) for v in (",a,", "a,", ",a", "a", ",,a")])
    assert got == ("a", "a", "a", "a", ",a")


def test_empty_and_padding(one):
    null = F.lit(None).cast("string")
    assert one(text.is_empty(null), text.is_empty(F.lit("")), text.is_empty(F.lit(" "))) == (
        True,
        True,
        False,
    )
    assert one(*[text.pad_two(F.lit(v)) for v in ("", "7", "42", "123")]) == (
        "00",
        "07",
        "42",
        "123",
    )


PACKED = "a=1|b=|c=2|a=3|d|e=x=y|xa=9|f=5="


@pytest.mark.parametrize(
    "field, expected",
    [("a", "1"), ("b", None), ("c", "2"), ("d", None), ("e", None), ("z", None), ("f", "5")],
)
def test_kv_get(one, field, expected):
    assert one(text.kv_get(F.lit(PACKED), field)) == expected


def test_kv_get_other_delimiter_and_pattern_characters(one):
    assert one(text.kv_get(F.lit("a.b=1;axb=2"), "a.b", ";")) == "1"
    assert one(text.kv_get(F.lit("axb=2;a.b=1"), "a.b", ";")) == "1"
    with pytest.raises(ValueError):
        text.kv_get(F.lit(""), "a", "||")


def test_kv_set(one):
    assert one(text.kv_set(F.lit(PACKED), "a", "$9\\")) == "a=$9\\|b=|c=2|a=$9\\|d|e=x=y|xa=9|f=5="
    assert one(text.kv_set(F.lit("a=1|b=|d"), "b", "2")) == "a=1|b=2|d"
    assert one(text.kv_set(F.lit("a=1|b=|d"), "z", "2")) == "a=1|b=|d"


VISIT = {
    0: None, 1: "1s_3s", 3: "1s_3s", 4: "4s_6s", 6: "4s_6s", 7: "7s_9s", 9: "7s_9s",
    10: "10s_30s", 30: "10s_30s", 31: "30s_60s", 60: "30s_60s", 61: "1m_3m", 180: "1m_3m",
    181: "3m_10m", 600: "3m_10m", 601: "10m_30m", 1800: "10m_30m", 1801: "30m",
}
STEP = {
    1: "1_3", 3: "1_3", 4: "4_6", 6: "4_6", 7: "7_9", 9: "7_9", 10: "10_30", 30: "10_30",
    31: "30_60", 60: "30_60", 61: "60",
}


def test_bucket_edges(one):
    assert one(*[buckets.visit_length_bucket(F.lit(v)) for v in VISIT]) == tuple(VISIT.values())
    assert one(*[buckets.step_length_bucket(F.lit(v)) for v in STEP]) == tuple(STEP.values())


def test_ratio_rounds_half_up(spark):
    got = spark.range(201).select(numbers.ratio_round(F.col("id"), F.lit(200)).alias("r")).collect()
    assert [r.r for r in got] == [(x + 1) // 2 / 100 for x in range(201)]


def test_ratio_of_nothing_is_null(one):
    assert one(numbers.ratio_round(F.lit(0), F.lit(0))) is None


def _ts(value):
    return F.lit(value).cast("timestamp")


def test_differences(one):
    a, b = _ts("2024-01-31 23:59:30"), _ts("2024-02-02 00:00:00")
    assert one(times.seconds_between(a, b), times.minutes_between(a, b)) == (86430, 1440)
    assert one(times.minutes_between(b, a)) == -1440
    assert one(times.hours_between(a, b)) == pytest.approx(86430 / 3600)
    assert one(times.full_days_between(a, b), times.calendar_days_between(a, b)) == (1, 2)
    assert one(times.full_days_between(a, F.lit(None).cast("timestamp"))) == -1


def test_compare_times(one):
    def order(x, y):
        return one(times.compare_times(F.lit(x).cast("string"), F.lit(y).cast("string")))

    early, late = "2024-01-01 00:00:00", "2024-01-01 00:00:01"
    assert [order(early, late), order(late, early), order(late, late)] == [-1, 1, 0]
    assert [order("x", late), order(None, late), order("2024-02-30 00:00:00", late)] == [0, 0, 0]


def _period(a: date, b: date) -> str:
    """Calendar period the long way: the most whole months that do not pass b."""
    months = (b.year - a.year) * 12 + b.month - a.month
    days = b.day - a.day
    if months > 0 and days < 0:
        months -= 1
        y, m = divmod(a.year * 12 + a.month - 1 + months, 12)
        moved = date(y, m + 1, min(a.day, pycalendar.monthrange(y, m + 1)[1]))
        days = (b - moved).days
    elif months < 0 and days > 0:
        months += 1
        days -= pycalendar.monthrange(b.year, b.month)[1]
    years = abs(months) // 12 * (1 if months >= 0 else -1)
    return f"{years},{months - 12 * years},{days}"


def test_period_examples(one):
    def period(a, b):
        return one(times.period_between(F.lit(a).cast("date"), F.lit(b).cast("date")))

    assert period("2011-02-02", "2017-03-02") == "6,1,0"
    assert period("2000-02-29", "2023-02-28") == "22,11,30"
    assert period("2024-01-31", "2024-02-29") == "0,0,29"
    assert period("2024-03-01", "2024-01-30") == "0,-1,-2"
    assert period("2024-05-05", "2024-05-05") == "0,0,0"


def test_period_over_many_pairs(spark):
    start = date(1999, 11, 27)
    pairs = [
        (start + timedelta(days=i * 13), start + timedelta(days=(i * 7919) % 4000))
        for i in range(300)
    ]
    df = spark.createDataFrame(pairs, "a date, b date")
    got = df.select("a", "b", times.period_between(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r.p == _period(r.a, r.b) for r in got)


def test_completed_years(one):
    def age(birth, on):
        return one(times.completed_years(F.lit(birth).cast("date"), F.lit(on).cast("date")))

    assert age("2000-05-10", "2024-05-09") == 23
    assert age("2000-05-10", "2024-05-10") == 24
    assert age("2000-02-29", "2023-02-28") == 22


def test_days_and_shifts(one):
    t = _ts("2024-02-29 13:14:15.5")
    assert one(times.day_start(t)) == datetime(2024, 2, 29)
    assert one(times.next_day_start(t)) == datetime(2024, 3, 1)
    assert one(times.previous_day_end(t)) == datetime(2024, 2, 28, 23, 59, 59)
    assert one(times.plus_days(t, -1)) == datetime(2024, 2, 28, 13, 14, 15, 500000)
    assert one(times.plus_years(t, 1)) == datetime(2025, 2, 28, 13, 14, 15, 500000)
    assert one(times.date_hour(t)) == "2024-02-29_13"


def test_weekdays(one):
    sunday, monday = F.lit("2024-03-03").cast("date"), F.lit("2024-03-04").cast("date")
    assert one(times.weekday_number(sunday), times.weekday_number(monday)) == (0, 1)
    assert one(times.weekday_name(sunday), times.weekday_name(monday)) == ("星期日", "星期一")
    week = one(times.week_dates(sunday))
    assert (week[0], week[-1], len(week)) == (date(2024, 2, 26), date(2024, 3, 3), 7)
    assert one(times.week_dates(monday))[0] == date(2024, 3, 4)


def test_stepped_dates(one):
    start = F.lit("2024-03-03").cast("date")
    assert one(times.stepped_dates(start, 3, 2)) == [date(2024, 3, d) for d in (3, 5, 7)]
    assert one(times.stepped_dates(start, 3, -1)) == [date(2024, 3, d) for d in (1, 2, 3)]
    assert one(times.stepped_dates(start, 2, 0)) == [date(2024, 3, 3)] * 2
    assert one(times.stepped_dates(start, 0, 1)) == []


@pytest.mark.parametrize(
    "pattern",
    ["yyyyMMdd", times.DATE_TIME, "yyyyMMddHHmmssSSS", "yy-M-d H:m:s", "yyyy年MM月dd日HH时mm分ss秒"],
)
def test_patterns_format(one, pattern):
    assert one(times.format_time(_ts("2024-11-05 06:07:08.009"), pattern))


def test_format_examples(one):
    t = _ts("2024-11-05 06:07:08.009")
    assert one(times.format_time(t, "MM月dd日")) == "11月05日"
    assert one(times.format_time(t, "yyyyMMddHHmmssSSS")) == "20241105060708009"
    assert one(times.parse_time(F.lit("2024-1-5 6:7:8"), "yyyy-M-d H:m:s")) == datetime(
        2024, 1, 5, 6, 7, 8
    )
    assert one(times.parse_time(F.lit("nope"))) is None


@pytest.mark.parametrize(
    "value, valid",
    [
        ("2024-11-30 23:59:59", True),
        ("2024-11-31 00:00:00", False),
        ("2024-02-30 00:00:00", False),
        ("2024-2-29 00:00:00", True),
        ("2023-02-29 00:00:00", False),
        ("2024-01-01 24:00:00", False),
        ("1999-01-01 00:00:00", False),
        ("2024-01-01", False),
        ("", False),
        (None, False),
    ],
)
def test_is_valid_time(one, value, valid):
    assert one(times.is_valid_time(F.lit(value).cast("string"))) is valid


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 14), st.integers(1, 33))
def test_is_valid_date_is_a_real_parse(one, month, day):
    value = f"2024-{month}-{day:02d}"
    try:
        date(2024, month, day)
        real = True
    except ValueError:
        real = False
    assert one(times.is_valid_date(F.lit(value))) is real
