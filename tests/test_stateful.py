"""Streams with state: running counts, repeated lines, sessions, arrival windows, late clicks."""

import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_streaming import START, Folder, _line, _parsed

from clickloom.operators import clicks as ops
from clickloom.streaming import late, stateful, tables

DAY = 86400


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, tmp_path)


def _run(folder, start, table, **options):
    query = start(folder.lines(), table, folder.checkpoint, interval=None, **options)
    query.awaitTermination()
    return [o for p in query.recentProgress for o in p["stateOperators"]]


def _rows(df):
    return {tuple(r) for r in df.collect()}


def test_state_counts_equal_batch_and_forget_old_days(spark, folder):
    table = tables.state_totals(str(folder.path / "t"), compact_every=2)
    lines, sizes = [], []
    for day in range(8):
        part = [_line(day * DAY + i, "pq"[i % 2], "c", i, i % 3) for i in range(30)]
        part += [_line((day - 1) * DAY + 5, "p", "c", 1, 1)] * (day > 0)  # a day late is in time
        lines += part
        folder.drop(*part, "no line")
        sizes.append(_run(folder, stateful.start_ad_stat_state, table)[-1]["numRowsTotal"])
    assert _rows(table.current(spark)) == _rows(ops.running_click_counts(_parsed(spark, lines)))
    # six keys a day: the state holds the days within the lateness, not all eight
    assert max(sizes) <= 6 * 4 and sizes[-1] <= 6 * 4
    dropped = [_line(0, "p", "c", 1, 1)]
    folder.drop(*dropped)
    found = _run(folder, stateful.start_ad_stat_state, table)
    assert sum(o["numRowsDroppedByWatermark"] for o in found) == 1
    assert _rows(table.current(spark)) == _rows(ops.running_click_counts(_parsed(spark, lines)))


def test_lines_delivered_twice_count_once(spark, folder):
    table = tables.unique_totals(str(folder.path / "t"), compact_every=2)
    lines, sizes = [], []
    for hour in range(6):
        part = [_line(hour * 3600 + i, "p", "c", i % 5, i % 3) for i in range(40)]
        lines += part
        for _ in range(2):
            folder.drop(*part)
            found = _run(folder, stateful.start_unique_ad_stat, table, lateness="90 minutes")
            sizes.append(found[-1]["numRowsTotal"])
    assert _rows(table.current(spark)) == _rows(ops.running_click_counts(_parsed(spark, lines)))
    assert max(sizes) < len(lines)  # what the watermark has passed is forgotten


def test_sessions_are_written_when_closed(spark, folder):
    table = tables.closed_sessions(str(folder.path / "t"))
    folder.drop(_line(0, user=1), _line(60, user=1), _line(30, user=2))
    _run(folder, stateful.start_click_sessions, table, idle_seconds=600)
    assert table.current(spark).count() == 0
    folder.drop(_line(500, user=1), _line(4000, user=3))  # goes on over the restart, then is closed
    _run(folder, stateful.start_click_sessions, table, idle_seconds=600)
    at = lambda s: START + timedelta(seconds=s)
    found = table.current(spark).select("userid", "start_time", "end_time", "click_count")
    assert _rows(found) == {(1, at(0), at(500), 3), (2, at(30), at(30), 1)}


def test_arrival_hour_shrinks_as_clicks_leave_it(spark, tmp_path):
    table = tables.arrival_totals(str(tmp_path / "t"))
    clock = datetime(2024, 3, 1, 12, 0, 30)
    schema = "value string, arrived timestamp"
    (tmp_path / "in").mkdir()

    def deliver(minutes, *lines):
        rows = [(x, clock + timedelta(minutes=minutes)) for x in lines]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stateful.start_arrival_trend(
            source, table, str(tmp_path / "checkpoint"), interval=None
        ).awaitTermination()

    # clicks of any event time count by arrival
    deliver(0, _line(0, ad=1), _line(-9 * DAY, ad=1), _line(5, ad=2), "no line")
    deliver(40, _line(1, ad=1))
    deliver(61, _line(2, ad=3))
    deliver(130, _line(2, ad=3))
    at = lambda m: clock + timedelta(minutes=m)
    rows = table.current(spark)
    on_arrival = _rows(rows.where("not expired").select("as_of", "adid", "click_count"))
    assert on_arrival == {(at(0), 1, 2), (at(0), 2, 1), (at(40), 1, 3), (at(61), 3, 1), (at(130), 3, 1)}
    left = _rows(rows.where("expired").select("as_of", "adid", "click_count"))
    minute = lambda m: clock.replace(second=0) + timedelta(minutes=m)
    assert {(minute(60), 1, 1), (minute(60), 2, 0), (minute(100), 1, 0)} <= left


def test_arrival_hour_needs_no_setting_of_the_session(spark, tmp_path):
    """It runs with Spark's default state store, which it leaves as the session's."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    table = tables.arrival_totals(str(tmp_path / "t"))
    rows = [(_line(0, ad=1), START), (_line(1, ad=1), START), (_line(2, ad=2), START)]
    schema = "value string, arrived timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    spark.conf.set(key, plain)
    try:
        stateful.start_arrival_trend(
            source, table, str(tmp_path / "checkpoint"), interval=None
        ).awaitTermination()
        assert spark.conf.get(key) == plain
    finally:
        spark.conf.set(key, before)
    found = table.current(spark).where("not expired").select("as_of", "adid", "click_count")
    assert _rows(found) == {(START, 1, 2), (START, 2, 1)}


def test_processor_of_arrivals_is_sent_whole():
    """Spark's worker on the driver unpickles it without this package."""
    code = (
        "import sys, pickle; print(type(pickle.loads(sys.stdin.buffer.read())).__name__)"
    )
    sent = cloudpickle.dumps(stateful._last_hour())
    out = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd="/", env={})
    assert out.stdout.split() == [b"LastHour"], out.stderr.decode()


def test_late_and_on_time_add_up(spark, folder):
    found = tables.LateTables.below(str(folder.path / "t"), compact_every=2)

    def run():
        late.start_windows(
            folder.lines(), found, folder.checkpoint, 3600, 600, None
        ).awaitTermination()

    parts = [
        [_line(0, ad=1), _line(3500, ad=1)],
        [_line(3700, ad=1), _line(10, ad=2), "no line"],  # the first hour is still open
        [_line(4300, ad=1)],
        [_line(20, ad=1), _line(30, ad=2), _line(4400, ad=1)],  # now it has ended
        ["nothing"],
        [_line(3 * 3600, ad=1), _line(50, ad=3)],
    ]
    for part in parts:
        folder.drop(*part)
        run()
    hour = lambda h: START + timedelta(hours=h)
    assert _rows(late.reconciled(found, spark)) == {
        (hour(0), hour(1), 1, 2, 1), (hour(0), hour(1), 2, 1, 1), (hour(0), hour(1), 3, 0, 1),
        (hour(1), hour(2), 1, 3, 0), (hour(3), hour(4), 1, 1, 0),
    }
    closed = late.closed_windows(found, spark, 600)
    assert {r.window_start for r in closed.collect()} == {hour(0), hour(1)}
    # trying a batch again changes nothing
    before = _rows(late.reconciled(found, spark))
    late.apply_window_batch(_parsed(spark, parts[5]), 5, found, 3600, 600)
    assert _rows(late.reconciled(found, spark)) == before


def test_counts_of_lines_without_a_time(spark):
    """Lines whose event has no time are malformed, and counted as such."""
    lines = spark.createDataFrame([(" p c 1 2",), (_line(0),)], "value string")
    assert ops.malformed_line_count(lines).first()[:] == (2, 1)
    assert ops.parse_ad_lines(lines.withColumn("arrived", F.lit(1)), keep=("arrived",)).columns[0] == "arrived"
