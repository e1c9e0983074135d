from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from clickloom.operators import calendar, clicks, keyed, textjobs

START = datetime(2024, 1, 5, 10, 0, 0)


def _millis(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1000)


def _lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_parse_keeps_well_formed_lines_only(spark):
    good = f"{_millis(START)} p c 7 3"
    bad = ["", "x", f"{_millis(START)} p c 7", f"abc p c 7 3", f"{_millis(START)} p c u 3",
           f"{_millis(START)} p c 7 3 4", "99999999999999999 p c 7 3", None]
    lines = _lines(spark, good, *bad)
    (row,) = clicks.parse_ad_lines(lines).collect()
    assert tuple(row) == (START, START.date(), "p", "c", 7, 3)
    assert tuple(clicks.malformed_line_count(lines).first()) == (9, 8)


def test_observed_line_counts(spark):
    seen = Observation()
    lines = _lines(spark, f"{_millis(START)} p c 7 3", "x", None)
    assert clicks.parse_ad_lines(lines, seen).count() == 1
    assert seen.get == {"lines": 3, "malformed": 2}


@pytest.fixture(scope="module")
def make_clicks(spark):
    def make(*rows):
        full = [(t, t.date(), p, c, u, a) for t, p, c, u, a in rows]
        return spark.createDataFrame(
            full,
            "ts timestamp, date date, province string, city string, userid bigint, adid bigint",
        )

    return make


def test_blacklist_flow(make_clicks, spark):
    rows = [(START, "p", "c", 1, 5)] * 3 + [(START, "p", "c", 1, 6)] * 3
    rows += [(START, "p", "c", 2, 5)] * 2 + [(START + timedelta(days=1), "p", "c", 2, 5)] * 2
    counts = clicks.ad_user_click_counts(make_clicks(*rows))
    reached = clicks.blacklist_candidates(counts, 3)
    assert reached.count() == 2
    users = clicks.blacklist_users(reached)
    assert [r.userid for r in users.collect()] == [1]
    kept = clicks.blacklist_filter(make_clicks(*rows), users.union(users))
    assert Counter(r.userid for r in kept.collect()) == {2: 4}


def _stats(spark, *rows):
    return spark.createDataFrame(
        rows, "date date, province string, city string, adid long, click_count long"
    )


def test_province_top_per_date_or_over_all(spark):
    d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
    stats = _stats(
        spark,
        (d1, "p", "a", 1, 5), (d1, "p", "b", 1, 5), (d1, "p", "a", 2, 10), (d1, "p", "a", 3, 9),
        (d2, "p", "a", 4, 1), (d2, "q", "a", 4, 1),
    )
    counts = clicks.province_counts(stats)
    assert counts.count() == 5
    top = {tuple(r) for r in clicks.province_top_ads(counts, 2).collect()}
    assert top == {(d1, "p", 1, 10), (d1, "p", 2, 10), (d2, "p", 4, 1), (d2, "q", 4, 1)}
    over_all = {tuple(r) for r in clicks.province_top_ads(counts, 2, ("province",)).collect()}
    assert over_all == {(d1, "p", 1, 10), (d1, "p", 2, 10), (d2, "q", 4, 1)}


def test_minute_counts(make_clicks):
    rows = [(START + timedelta(seconds=s), "p", "c", 1, 5) for s in (0, 59, 60)]
    got = {tuple(r) for r in clicks.clicks_per_minute(make_clicks(*rows)).collect()}
    assert got == {(START.date(), "10", "00", 5, 2), (START.date(), "10", "01", 5, 1)}


@pytest.mark.parametrize("length, slide", [(3600, 600), (60, 10), (90, 60), (60, 60)])
def test_sliding_equals_direct_windows(make_clicks, length, slide):
    rows = [
        (START + timedelta(milliseconds=137_900 * i * i), "p", "c", 1, i % 3) for i in range(60)
    ]
    df = make_clicks(*rows)
    direct = df.groupBy(F.window("ts", f"{length} seconds", f"{slide} seconds"), "adid").count()
    expected = {tuple(r) for r in direct.select("window.start", "window.end", "adid", "count").collect()}
    got = {tuple(r) for r in clicks.clicks_sliding(df, length, slide).collect()}
    assert got == expected


def _kv(spark, **values):
    return spark.createDataFrame(list(values.items()), "k string, v long")


def _dict(df):
    return {r.k: r.v for r in df.collect()}


def test_upserts(spark):
    old, new = _kv(spark, a=1, b=2), _kv(spark, b=5, c=7)
    assert _dict(keyed.add_upsert(old, new, ["k"], "v")) == {"a": 1, "b": 7, "c": 7}
    assert _dict(keyed.set_upsert(old, new, ["k"], "v")) == {"a": 1, "b": 5, "c": 7}


def test_set_upsert_can_lower_a_value_and_repeat(spark):
    old, new = _kv(spark, a=9), _kv(spark, a=1)
    once = keyed.set_upsert(old, new, ["k"], "v")
    assert _dict(once) == _dict(keyed.set_upsert(once, new, ["k"], "v")) == {"a": 1}


def test_replace_groups(spark):
    def rows(*r):
        return spark.createDataFrame(r, "g string, k string")

    old, new = rows(("x", "1"), ("x", "2"), ("y", "3")), rows(("x", "9"), ("z", "8"))
    merged = keyed.replace_groups(old, new, ["g"])
    assert {tuple(r) for r in merged.collect()} == {("x", "9"), ("y", "3"), ("z", "8")}
    again = keyed.replace_groups(merged, new, ["g"])
    assert sorted(again.collect()) == sorted(merged.collect())


def test_only_new(spark):
    old, new = _kv(spark, a=1), spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v long")
    assert [tuple(r) for r in keyed.only_new(old, new, ["k"]).collect()] == [("b",)]


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("pq"), st.integers(1, 4)), min_size=1, max_size=40),
    st.integers(1, 4),
)
def test_counting_in_any_batches_equals_counting_once(spark, rows, n):
    def counts(part):
        df = spark.createDataFrame(part, "k string, a long")
        return df.groupBy("k", "a").agg(F.count(F.lit(1)).alias("v"))

    total = counts(rows[0::n])
    for i in range(1, n):
        if rows[i::n]:
            total = keyed.add_upsert(total, counts(rows[i::n]), ["k", "a"], "v")
    assert {(r.k, r.a): r.v for r in total.collect()} == Counter(rows)


def test_calendar_spine(spark):
    df = spark.createDataFrame([(date(2024, 2, 28), 3), (date(2024, 3, 2), 4)], "day date, n long")
    got = [(r.day.isoformat(), r.n) for r in calendar.calendar_spine(df, "day", ["n"]).collect()]
    assert sorted(got) == [
        ("2024-02-28", 3), ("2024-02-29", 0), ("2024-03-01", 0), ("2024-03-02", 4),
    ]
    assert calendar.calendar_spine(df.where("false"), "day", ["n"]).count() == 0


def test_text_jobs(spark):
    df = spark.createDataFrame([("a=1|b=",), (None,)], "t string")
    got = textjobs.kv_field_extract(df, "t", ["a", "b"]).collect()
    assert [(r.a, r.b) for r in got] == [("1", None), (None, None)]
    rewritten = textjobs.kv_field_rewrite(df, "t", {"b": "2", "c": "3"})
    assert [r.t for r in rewritten.collect()] == ["a=1|b=2", None]
    row = textjobs.text_normalise(df.select(F.lit(",x,").alias("t")), "t").first()
    assert (row.is_empty, row.comma_trimmed, row.padded) == (False, "x", ",x,")
