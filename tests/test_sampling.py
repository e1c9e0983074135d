import hashlib
from collections import Counter, defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from clickloom.operators import sampling
from clickloom.operators.filters import SessionCriteria
from clickloom.plans import jobs


def _sessions(spark, counts):
    """``counts[(day, hour)]`` sessions starting in each hour."""
    rows = [
        (f"s{day}-{hour}-{i}", f"2024-01-{day:02d} {hour:02d}:{i % 60:02d}:00")
        for (day, hour), n in counts.items()
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "session_id string, start_time string")
    return df.withColumn("start_time", F.col("start_time").cast("timestamp"))


def _brute(counts, total, seed):
    per_day = total // len({d for d, _ in counts})
    day_count = defaultdict(int)
    for (d, _), n in counts.items():
        day_count[d] += n
    picked = set()
    for (d, h), n in counts.items():
        quota = min(floor(per_day * (n / day_count[d])), n)
        ids = [f"s{d}-{h}-{i}" for i in range(n)]
        ids.sort(key=lambda s: (hashlib.md5(f"{seed}:{s}".encode()).hexdigest(), s))
        picked |= set(ids[:quota])
    return picked


SKEWED = {(1, 0): 3, (1, 9): 3000, (2, 9): 40, (2, 10): 1, (3, 23): 7}


@pytest.mark.parametrize("total", [3, 10, 200, 1500, 100_000])
@pytest.mark.parametrize("counts", [SKEWED, {(1, 1): 1}])
def test_sample_equals_brute_force(spark, counts, total):
    sample = sampling.session_random_sample(_sessions(spark, counts), total, seed=5)
    ids = [r.session_id for r in sample.collect()]
    assert len(ids) == len(set(ids)) <= total
    assert set(ids) == _brute(counts, total, 5)


def test_sample_size_is_sum_of_quotas(spark):
    sessions = _sessions(spark, SKEWED)
    quota = sampling.session_sample_quota(sampling.session_hour_counts(sessions), 600)
    rows = {(r.date.day, r.hour): r for r in quota.collect()}
    assert {r.per_day for r in rows.values()} == {200}
    assert rows[1, 9].quota == floor(200 * (3000 / 3003))
    assert rows[2, 10].quota == 1
    sample = sampling.session_random_sample(sessions, 600)
    drawn = Counter((r.date.day, r.hour) for r in sample.collect())
    assert drawn == {cell: r.quota for cell, r in rows.items() if r.quota}


def test_seed_decides(spark):
    def ids(seed):
        sample = sampling.session_random_sample(_sessions(spark, SKEWED), 300, seed)
        return {r.session_id for r in sample.collect()}

    assert ids(1) == ids(1) != ids(2)


def test_no_sessions_no_sample(spark):
    none = _sessions(spark, {(1, 1): 1}).where("false")
    assert sampling.session_random_sample(none, 10).count() == 0


def test_small_total_gives_empty_sample(spark):
    assert sampling.session_random_sample(_sessions(spark, SKEWED), 2).count() == 0


def test_sample_does_not_depend_on_broadcast(spark):
    sessions = _sessions(spark, SKEWED)
    small = sorted(sampling.session_random_sample(sessions, 500).collect())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(sampling.session_random_sample(sessions, 500).collect()) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_job_writes_matching_summary_and_detail(make_actions, make_users):
    rows = [
        (f"s{i}", i, f"2024-01-01 {h}:00:0{j}", {"click_category_id": j})
        for i in range(12)
        for h in (8 + i % 2,)
        for j in range(3)
    ]
    users = make_users(*[(i, 30, "cook", "X", "1") for i in range(12)])
    out = {}
    jobs.run_session_sample(
        make_actions(*rows),
        users,
        jobs.DateRange("2024-01-01", "2024-01-01"),
        SessionCriteria(),
        6,
        lambda df, name: out.update({name: df.collect()}),
        "t",
    )
    extract, detail = out["session_random_extract"], out["session_detail"]
    assert len(extract) == 6 and len(detail) == 18
    assert {r.session_id for r in extract} == {r.session_id for r in detail}
    assert {r.click_category_ids for r in extract} == {"0,1,2"}
    assert {r.search_keywords for r in extract} == {""}
    assert len(detail[0]) == 12
