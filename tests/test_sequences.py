"""Page flows, idle-time sessions, as-of joins, grouping sets, sketches, replaced partitions."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import physical_plan
from pyspark.sql import functions as F

from clickloom.operators import gaps, neighbours, pageflow, rollups, sessions
from clickloom.sources import partitions

START = datetime(2024, 1, 5, 10, 0, 0)


def _hot_actions(make_actions, n=600):
    """One session with most of the rows, some small ones."""
    rng = random.Random(2)
    rows, at = [], START
    for k in range(n):
        at += timedelta(seconds=rng.choice([1, 5, 4000]))
        hot = rng.random() < 0.8
        rows.append(
            ("hot" if hot else f"s{k % 7}", 1 if hot else k % 7 + 2, str(at), {"page_id": rng.randint(1, 4)})
        )
    return rows, make_actions(*rows)


def test_page_steps_cross_task_edges(make_actions):
    rows, actions = _hot_actions(make_actions)
    found = pageflow.page_step_conversion(actions, (1, 2, 3, 2), partitions=8).orderBy("step").collect()
    pages = {}
    for session, _, _, fields in rows:
        pages.setdefault(session, []).append(fields["page_id"])
    steps = Counter(p for seen in pages.values() for p in zip(seen, seen[1:], strict=False))
    reached = sum(seen.count(1) for seen in pages.values())
    for r, pair in zip(found, ((1, 2), (2, 3), (3, 2)), strict=True):
        assert (r.from_page, r.to_page, r.transitions, r.reached) == (*pair, steps[pair], reached)
        reached = steps[pair]
    with pytest.raises(ValueError):
        pageflow.page_step_conversion(actions, (1,))


def test_page_steps_without_rows(make_actions):
    actions = make_actions(("s", 1, "2024-01-05 10:00:00", {"page_id": 9}), (None, 1, "2024-01-05 10:00:01"))
    found = pageflow.page_step_conversion(actions.where("page_id = 9"), (1, 2)).first()
    assert (found.transitions, found.reached, found.conversion_ratio) == (0, 0, None)


def test_a_large_group_spans_pieces(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"), "id",
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"),
    )
    rows = neighbours.laid_out(df, ["g"], [F.col("id")], 6)
    assert rows.where("g = 'hot'").select(neighbours.PIECE).distinct().count() > 3
    found = neighbours.last_before(rows, ["g"], {"last": F.col("v")})
    found = neighbours.running_sum(found, ["g"], F.lit(1), "n")
    for r in found.collect():
        first = 0 if r.g == "hot" else 900
        want = [i for i in range(first, r.id) if i % 7 == 0]
        assert r.last == (want[-1] if want else None) and r.n == r.id - first + 1
    assert "HashPartitioning(g" not in physical_plan(found)


def test_idle_time_parts_sessions_of_a_hot_user(make_actions):
    rows, actions = _hot_actions(make_actions)
    found = gaps.gap_sessions(actions, 1800, partitions=8).collect()
    want, last = {}, {}
    for _, user, at, _ in rows:
        at = datetime.fromisoformat(at)
        if user not in last or (at - last[user]).total_seconds() >= 1800:
            want.setdefault(user, []).append([at, at, 0])
        last[user] = at
        want[user][-1][1] = at
        want[user][-1][2] += 1
    got = {}
    for r in sorted(found, key=lambda r: (r.user_id, r.gap_session)):
        got.setdefault(r.user_id, []).append([r.start_time, r.end_time, r.step_length])
    assert got == want
    lone = make_actions(("s", None, str(START)), ("s", 3, str(START)), ("s", 3, str(START + timedelta(seconds=1800))))
    assert [r.gap_session for r in gaps.gap_sessions(lone).orderBy("gap_session").collect()] == [1, 2]


def test_as_of_takes_the_last_row_not_later(spark):
    rng = random.Random(3)
    left = [(k, 1 if rng.random() < 0.7 else rng.randint(2, 5), rng.randint(0, 300)) for k in range(300)]
    right = [(1 if rng.random() < 0.7 else rng.randint(2, 5), rng.randint(0, 300), f"v{k}") for k in range(200)]
    left += [(1000, None, 5), (1001, 1, None), (1002, 99, 5)]
    right += [(None, 1, "x"), (1, None, "y")]
    found = gaps.as_of(
        spark.createDataFrame(left, "id long, by long, t long"),
        spark.createDataFrame(right, "by long, at long, v string"),
        "by", "t", "at", {"at": "seen_at", "v": "seen"}, partitions=6,
    )
    assert found.columns == ["id", "by", "t", "seen_at", "seen"] and found.count() == len(left)
    for r in found.collect():
        past = [(a, v) for b, a, v in right if None not in (b, a, r.by, r.t) and b == r.by and a <= r.t]
        assert (r.seen_at, r.seen) == (max(past) if past else (None, None))


def _sessions(spark):
    rows = [
        (k % 50, START + timedelta(minutes=k * 7), k * 37 % 2500, k % 80 + 1, k % 3, "ab"[k % 2]) for k in range(700)
    ]
    return spark.createDataFrame(
        rows, "user_id long, start_time timestamp, visit_length long, step_length long, age int, sex string"
    )


def test_ratios_over_sets_roll_up_counts(spark):
    frame = _sessions(spark).unionByName(_sessions(spark).limit(5).withColumn("sex", F.lit(None).cast("string")))
    found = rollups.ratios_over_sets(frame, ("age", "sex"))
    rows = {(r.grouping_id, r.age, r.sex): r for r in found.collect()}
    assert rows[3, None, None].session_count == 705 and rows[2, None, None].session_count == 5
    assert rows[1, 1, None].session_count == frame.where("age = 1").count()
    one = rows[2, None, "a"]
    part = frame.where("sex = 'a'")
    share = part.where("visit_length between 601 and 1800").count() / part.count()
    assert one.visit_length_10m_30m_ratio == int(share * 100 + 0.5) / 100
    plan = physical_plan(found)
    # grouping sets copy the counts of the grain, not sessions: Expand lies above an aggregate
    assert plan.index("Expand") < plan.rindex("HashAggregate")
    assert "Expand" not in plan[plan.rindex("Exchange") :]
    every = rollups.ratios_over_sets(frame.where("false"), ("age", "sex"), [("age",), ()])
    assert {r.session_count for r in every.collect()} <= {0}


def test_sketches_merge_to_the_same_figures(spark):
    frame = _sessions(spark)
    hourly = rollups.session_sketches(frame)
    merged = rollups.sketch_figures(rollups.merged_sketches(hourly)).first()
    direct = frame.agg(F.percentile("visit_length", F.array(F.lit(0.47), F.lit(0.53))).alias("p")).first().p
    assert merged.session_count == 700 and abs(merged.users - 50) <= 2
    assert direct[0] - 1 <= merged.length_p50 <= direct[1] + 1
    days = rollups.merged_sketches(hourly, "date")
    again = rollups.sketch_figures(rollups.merged_sketches(days)).first()
    assert again.users == merged.users and again.session_count == 700
    exact = sorted(r.visit_length for r in frame.collect())
    rank = sum(v <= again.length_p90 for v in exact) / len(exact)
    assert abs(rank - 0.9) < 0.03
    odd = frame.limit(2).withColumns({"user_id": F.lit(None).cast("long"), "visit_length": F.lit(None).cast("long")})
    empty = rollups.sketch_figures(rollups.session_sketches(odd)).first()
    assert (empty.session_count, empty.users, empty.length_p50) == (2, 0, None)


def test_session_sketches_of_spans(make_actions):
    _, actions = _hot_actions(make_actions, 60)
    table = rollups.session_sketches(sessions.session_spans(actions))
    total = rollups.sketch_figures(rollups.merged_sketches(table)).first()
    assert total.session_count == sessions.session_spans(actions).count()


def test_replaced_partitions_leave_others(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ("day", "place")
    schema = "v long, day int, place string"
    old = [(1, 1, "p"), (2, 1, "q"), (3, 2, "p")]
    new = [(9, 1, "p"), (8, 1, "p"), (7, 3, "r")]

    def rows():
        found = partitions.read_partitions(spark, path, spark.createDataFrame([], schema).schema)
        return sorted(tuple(r) for r in found.collect())

    def files(folder):
        return {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / folder).glob("*.parquet")}

    assert rows() == []
    partitions.replace_partitions(spark.createDataFrame(old, schema).repartition(9), path, keys)
    kept = files("day=1/place=q"), files("day=2/place=p")
    for _ in range(2):  # a second try gives the same
        partitions.replace_partitions(spark.createDataFrame(new, schema).repartition(9), path, keys)
        assert rows() == sorted([*new, old[1], old[2]])
    assert (files("day=1/place=q"), files("day=2/place=p")) == kept
    assert len(files("day=1/place=p")) == 1
    partitions.replace_partitions(spark.createDataFrame([], schema), path, keys)
    assert rows() == sorted([*new, old[1], old[2]])
