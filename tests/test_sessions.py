from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.operators import actions as action_ops
from clickloom.operators import sessions, stats
from clickloom.operators.filters import SessionCriteria, any_match, session_filter
from clickloom.plans import jobs

DAY = "2024-01-05"


def test_scan_includes_both_ends(make_actions):
    rows = [("s", 1, f"2024-01-0{d} 10:00:00") for d in (1, 2, 3, 4)]
    kept = action_ops.action_scan(make_actions(*rows), "2024-01-02", "2024-01-03")
    assert sorted(str(r.date) for r in kept.collect()) == ["2024-01-02", "2024-01-03"]


def test_normalised_action(make_actions):
    row = make_actions(
        ("s", 1, "2024-01-05 9:08:07", {"order_category_ids": "12,1", "click_product_id": 4})
    ).first()
    assert row.action_time == datetime(2024, 1, 5, 9, 8, 7)
    assert (row.click_category_id, row.click_product_id) == (None, 4)
    assert (row.order_category_ids, row.pay_category_ids) == ([12, 1], None)


@pytest.fixture(scope="module")
def actions(make_actions):
    return make_actions(
        ("a", 1, f"{DAY} 10:00:05", {"search_keyword": "tea"}),
        ("a", 1, f"{DAY} 10:00:00", {"click_category_id": 12}),
        ("a", 1, f"{DAY} 10:00:09", {"click_category_id": 1}),
        ("a", 1, f"{DAY} 10:00:01", {"click_category_id": 12, "search_keyword": ""}),
        ("b", 7, f"{DAY} 11:00:01"),
        ("b", 2, f"{DAY} 11:00:00", {"search_keyword": "teapot"}),
        ("b", 2, f"{DAY} 11:00:02", {"search_keyword": "tea"}),
        ("c", 9, f"{DAY} 12:00:00", {"click_category_id": 2}),
    )


@pytest.fixture(scope="module")
def users(make_users):
    return make_users((1, 20, "doctor", "X", "0"), (2, 50, "cook", "Y", "1"), (3, 9, "cook", "Y", "1"))


def test_session_aggregate(actions):
    rows = {r.session_id: r for r in sessions.session_aggregate(actions).collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a.click_category_ids, a.search_keywords) == ([1, 12], ["tea"])
    assert (a.visit_length, a.step_length, a.user_id) == (9, 4, 1)
    assert a.start_time == datetime(2024, 1, 5, 10, 0, 0)
    assert (b.user_id, b.search_keywords, b.click_category_ids) == (2, ["tea", "teapot"], [])
    assert (c.visit_length, c.step_length) == (0, 1)


def test_spans_equal_aggregate(actions):
    lists = sessions.session_aggregate(actions)
    spans = sessions.session_spans(actions)
    assert sorted(lists.select(spans.columns).collect()) == sorted(spans.collect())


def test_first_user_of_ties_and_odd_ids(make_actions):
    """Ties go to the smaller id; NULL comes last; any bigint is possible."""
    low, high = -(2**63), 2**63 - 2
    time, later = f"{DAY} 10:00:00", f"{DAY} 10:00:01"
    actions = make_actions(
        ("a", 8, time), ("a", 3, time), ("a", 1, later),
        ("b", None, time), ("b", 4, time), ("c", None, time),
        ("d", low, later), ("d", high, time), ("e", low, time), ("e", high, time),
        ("f", -5, "1960-01-01 00:00:00"), ("f", 2, time),
    )
    expected = {"a": 3, "b": 4, "c": None, "d": high, "e": low, "f": -5}
    for result in (sessions.session_spans(actions), sessions.session_aggregate(actions)):
        assert {r.session_id: r.user_id for r in result.collect()} == expected


def test_join_drops_sessions_without_user(actions, users):
    joined = sessions.session_user_join(sessions.session_spans(actions), users)
    assert sorted((r.session_id, r.age) for r in joined.collect()) == [("a", 20), ("b", 50)]


def _kept(actions, users, **criteria):
    joined = sessions.session_user_join(sessions.session_aggregate(actions), users)
    c = SessionCriteria(**criteria)
    lists = sorted(r.session_id for r in session_filter(joined, c).collect())
    flags = sorted(r.session_id for r in sessions.matching_sessions(actions, users, c).collect())
    assert lists == flags
    return "".join(lists)


@pytest.mark.parametrize(
    "criteria, kept",
    [
        ({}, "ab"),
        ({"professionals": "", "cities": "", "sex": "", "keywords": "", "category_ids": ""}, "ab"),
        ({"start_age": 20, "end_age": 50}, "ab"),
        ({"start_age": 21, "end_age": 50}, "b"),
        ({"start_age": 99}, "ab"),
        ({"end_age": 1}, "ab"),
        ({"professionals": "cook,nurse"}, "b"),
        ({"professionals": "nurse"}, ""),
        ({"professionals": "-1"}, ""),
        ({"cities": ["X"]}, "a"),
        ({"sex": "1"}, "b"),
        ({"keywords": "tea"}, "ab"),
        ({"keywords": "teapot"}, "b"),
        ({"keywords": "te"}, ""),
        ({"category_ids": "1"}, "a"),
        ({"category_ids": [2]}, ""),
        ({"category_ids": "x"}, ""),
        ({"category_ids": "x,12", "keywords": "tea", "sex": "0"}, "a"),
        ({"category_ids": "12", "sex": "1"}, ""),
    ],
)
def test_filters(actions, users, criteria, kept):
    assert _kept(actions, users, **criteria) == kept


def test_any_match_null_never_matches(one):
    assert one(F.coalesce(any_match(F.lit(None).cast("string"), "a"), F.lit(False))) is False


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.sampled_from("pqr"),
            st.integers(1, 3),
            st.integers(0, 59),
            st.sampled_from(["tea", "milk", "", None]),
            st.sampled_from([-1, 1, 11]),
        ),
        min_size=1,
        max_size=25,
    )
)
def test_both_filters_agree(make_actions, users, rows):
    actions = make_actions(
        *[
            (s, u, f"{DAY} 10:00:{t:02d}", {"search_keyword": k, "click_category_id": c})
            for s, u, t, k, c in rows
        ]
    )
    _kept(actions, users, keywords="tea", category_ids="1", start_age=0, end_age=50)


def _stats_input(spark, visits, steps):
    n = max(len(visits), len(steps))
    rows = [(visits[i % len(visits)], steps[i % len(steps)]) for i in range(n)]
    return spark.createDataFrame(rows, "visit_length long, step_length long")


def test_ratio_stats(spark):
    got = stats.session_ratio_stats(_stats_input(spark, [0, 1, 3, 4, 31, 1801], [1, 61])).first()
    assert got.session_count == 6
    assert got.visit_length_1s_3s_ratio == 0.33
    assert got.visit_length_4s_6s_ratio == 0.17
    assert got.visit_length_30s_60s_ratio == 0.17
    assert got.visit_length_30m_ratio == 0.17
    assert (got.step_length_1_3_ratio, got.step_length_60_ratio) == (0.5, 0.5)


def test_stats_of_no_sessions(spark):
    none = _stats_input(spark, [1], [1]).where("false")
    row = stats.session_ratio_stats(none).first()
    assert row.session_count == 0
    assert row.visit_length_1s_3s_ratio is None
    assert {r["count"] for r in stats.bucket_counts(none).collect()} == {0}


def test_bucket_counts_match_bucket_columns(spark):
    df = _stats_input(spark, [0, 2, 5, 8, 20, 45, 100, 300, 900, 5000], [2, 5, 8, 20, 45, 99])
    counts = {r["name"]: r["count"] for r in stats.bucket_counts(df).collect()}
    labelled = stats.step_length_buckets(stats.visit_length_buckets(df)).collect()
    for row in labelled:
        for prefix, bucket in (("visit", row.visit_bucket), ("step", row.step_bucket)):
            if bucket is not None:
                counts[f"{prefix}_length_{bucket}"] -= 1
    assert counts.pop("session_count") == len(labelled)
    assert set(counts.values()) == {0}


def test_statistics_job_writes_one_stamped_row(actions, users):
    out = {}
    task = jobs.run_session_statistics(
        actions,
        users,
        jobs.DateRange(DAY, DAY),
        SessionCriteria(),
        lambda df, name: out.update({name: df.collect()}),
        task_id="t1",
    )
    assert task == "t1"
    (row,) = out["session_aggr_stat"]
    assert (row.task_id, row.session_count) == ("t1", 2)
