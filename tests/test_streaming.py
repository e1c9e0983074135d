import os
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import physical_plan

from clickloom.operators import clicks as ops
from clickloom.sources import readers
from clickloom.streaming import batchlog, jobs
from clickloom.streaming.batchlog import BatchLog
from clickloom.streaming.tables import AdTables

START = datetime(2024, 1, 5, 10, 0, 0)


def _line(seconds, province="p", city="c", user=1, ad=1):
    millis = int((START + timedelta(seconds=seconds) - datetime(1970, 1, 1)).total_seconds() * 1000)
    return f"{millis} {province} {city} {user} {ad}"


class Folder:
    """Input folder, tables and checkpoint of one stream."""

    def __init__(self, spark, path: Path, compact_every=100):
        self.spark, self.path, self.files = spark, path, 0
        (path / "in").mkdir(exist_ok=True)
        self.tables = AdTables.below(str(path / "tables"), compact_every)
        self.checkpoint = str(path / "checkpoint")

    def drop(self, *lines):
        """One more file, a second younger than the one before: files are read in this order."""
        file = self.path / "in" / f"{self.files:04d}.txt"
        file.write_text("\n".join(lines) + "\n")
        os.utime(file, (1_700_000_000 + self.files,) * 2)
        self.files += 1

    def lines(self):
        return readers.file_lines(self.spark, str(self.path / "in"), max_files_per_trigger=1)

    def run(self, job, **options):
        job(self.lines(), self.tables, self.checkpoint, interval=None, **options).awaitTermination()

    def flow(self, **options):
        self.run(jobs.start_ad_flow, **options)

    def rows(self, table):
        return {tuple(r) for r in getattr(self.tables, table).current(self.spark).collect()}


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, tmp_path)


def _parsed(spark, lines):
    return ops.parse_ad_lines(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_blacklist_feeds_back_from_batch_to_batch(folder):
    folder.drop(*[_line(i, user=1) for i in range(3)], _line(3, user=2), "not a line")
    folder.flow(threshold=4)
    assert folder.rows("blacklist") == set()
    folder.drop(*[_line(10 + i, user=1) for i in range(2)], _line(13, user=2))
    folder.flow(threshold=4)
    assert folder.rows("blacklist") == {(1,)}
    folder.drop(*[_line(20 + i, user=1) for i in range(5)], _line(26, user=2))
    folder.flow(threshold=4)
    day = START.date()
    assert folder.rows("user_clicks") == {(day, 1, 1, 5), (day, 2, 1, 3)}
    assert folder.rows("stats") == {(day, "p", "c", 1, 8)}
    assert folder.rows("province_top") == {(day, "p", 1, 8)}
    assert folder.rows("line_counts") == {(14, 1)}


def test_stream_equals_batch_over_restarts_and_compaction(spark, tmp_path):
    folder = Folder(spark, tmp_path, compact_every=2)
    all_lines = []
    for f in range(7):
        lines = [
            _line(f * 7200 * 3 + i * 31, "pq"[i % 2], "cde"[i % 3], i % 11, i * i % 7)
            for i in range(40)
        ]
        all_lines += lines
        folder.drop(*lines)
        if f % 2:
            folder.flow(threshold=10**6)
    folder.flow(threshold=10**6)
    assert list((folder.path / "tables" / "ad_stat" / "base").iterdir())
    batch = _parsed(spark, all_lines)
    stats = ops.running_click_counts(batch)
    assert folder.rows("stats") == {tuple(r) for r in stats.collect()}
    assert folder.rows("user_clicks") == {
        tuple(r) for r in ops.ad_user_click_counts(batch).collect()
    }
    top = ops.province_top_ads(ops.province_counts(stats))
    assert folder.rows("province_top") == {tuple(r) for r in top.collect()}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    folder = Folder(spark, tmp_path, compact_every=2)

    def snapshot():
        names = ("blacklist", "user_clicks", "stats", "province_top")
        return [folder.rows(n) for n in names]

    seen = []
    for n in range(7):
        lines = [_line(i + 86400 * (n // 3), user=n % 2, ad=i % 2) for i in range(4)]
        seen += lines
        jobs.apply_ad_batch(_parsed(spark, lines), n, folder.tables, threshold=100)
        once = snapshot()
        jobs.apply_ad_batch(_parsed(spark, lines), n, folder.tables, threshold=100)
        assert snapshot() == once
    batch = _parsed(spark, seen)
    assert once[1] == {tuple(r) for r in ops.ad_user_click_counts(batch).collect()}
    assert once[2] == {tuple(r) for r in ops.running_click_counts(batch).collect()}


def test_unfinished_batch_is_not_read(folder, spark):
    rows = spark.createDataFrame([(1,), (2,)], "userid long")
    table = folder.tables.blacklist
    table.write(rows.where("userid = 1"), 0)
    table._save(rows, "log/epoch=0/batch_id=1", False)  # ended before the batch was listed
    assert folder.rows("blacklist") == {(1,)}
    assert table.rows(spark).count() == 1
    for marker in folder.path.rglob("_SUCCESS"):  # not every committer leaves one
        marker.unlink()
    assert folder.rows("blacklist") == {(1,)}


def _dated(spark, *rows):
    schema = AdTables.below("x").stats.schema
    days = [(START.date() + timedelta(days=d), p, "c", a, n) for d, p, a, n in rows]
    return spark.createDataFrame(days, schema)


def test_log_folds(spark, tmp_path):
    schema = AdTables.below("x").stats.schema
    keys = ("date", "province", "city", "adid")
    folds = {
        "groups": batchlog.latest_groups(("date", "province")),
        "latest": batchlog.latest(keys, "click_count"),
        "summed": batchlog.summed(keys, "click_count"),
    }
    # epochs of two: the third batch folds the first two, the fifth the next two
    logs = {
        k: BatchLog(str(tmp_path / k), schema, fold, True, compact_every=2) for k, fold in folds.items()
    }
    batches = [
        [(0, "p", 1, 5), (0, "p", 2, 4), (0, "q", 1, 9)],
        [(0, "p", 3, 2)],
        [(1, "r", 1, 1)],
        [(0, "q", 1, 3)],
        [(2, "s", 1, 1)],
    ]

    def result(name, before=None):
        rows = logs[name].current(spark, before).collect()
        return {(r.province, r.adid, r.click_count) for r in rows}

    expected = {
        ("groups", 1): {("p", 1, 5), ("p", 2, 4), ("q", 1, 9)},
        ("groups", 3): {("p", 3, 2), ("q", 1, 9), ("r", 1, 1)},
        ("groups", None): {("p", 3, 2), ("q", 1, 3), ("r", 1, 1), ("s", 1, 1)},
    }
    for name, log in logs.items():
        for n, rows in enumerate(batches):
            log.write(_dated(spark, *rows), n)
            if (name, n + 1) in expected:
                assert result(name, n + 1) == result(name) == expected[name, n + 1]
    assert result("groups") == expected["groups", None]
    assert ("q", 1, 3) in result("latest") and ("q", 1, 12) in result("summed")
    assert len(result("summed")) == 6
    # a late try of the batch that folded still sees what was before it
    assert ("q", 1, 12) in result("summed", before=4)


def test_batch_reads_and_folds_its_dates_only(spark, tmp_path):
    log = BatchLog(
        str(tmp_path / "t"),
        AdTables.below("x").stats.schema,
        batchlog.summed(("date", "province", "city", "adid"), "click_count"),
        True,
        compact_every=2,
    )
    for n in range(8):
        # the first epoch fills twenty days, later ones one day each
        days = range(n * 10, n * 10 + 10) if n < 2 else [n // 2]
        log.write(_dated(spark, *[(d, "p", 1, 1) for d in days]), n)
    base = tmp_path / "t" / "base"
    held = {e: {p.name for p in (base / f"epoch={e}").glob("date=*")} for e in (0, 1, 2)}
    assert held[1] == {"date=2024-01-06"} and held[2] == {"date=2024-01-07"}
    # the base of the first epoch still serves the dates that later epochs do not hold
    assert len(held[0]) == 20 - 1
    assert not (tmp_path / "t" / "log" / "epoch=0").exists()
    day = START.date() + timedelta(days=3)
    rows = log.rows(spark, before=7, dates=(day, day))
    scans = re.findall(r"Location: InMemoryFileIndex", physical_plan(rows))
    assert len(scans) == 2
    read = [f for f in rows.inputFiles() if "/base/" in f]
    assert read and all("/base/epoch=0/date=2024-01-08/" in f for f in read)
    assert [r.click_count for r in log.fold(rows).collect()] == [2]
    total = log.current(spark).collect()
    assert sum(r.click_count for r in total) == 26 and len(total) == 20


def test_batches_write_few_files(spark, tmp_path):
    """However many tasks and dates a batch has; its dates lie together in them."""
    log = BatchLog(
        str(tmp_path / "t"), AdTables.below("x").stats.schema,
        batchlog.summed(("date", "province", "city", "adid"), "click_count"), True, compact_every=2,
    )
    rows = [(d, p, a, 1) for d in range(30) for p in "pq" for a in range(5)]
    for n in range(4):
        log.write(_dated(spark, *rows).repartition(16), n)
    written = lambda kind: [p for p in (tmp_path / "t" / kind).rglob("*.parquet")]
    assert len(written("log")) <= 2 * 4 and len(written("base")) == 30
    assert {p.name for p in (tmp_path / "t" / "finished").iterdir() if p.name.isdigit()} == {"2", "3"}
    assert sum(r.click_count for r in log.current(spark).collect()) == 4 * len(rows)


def test_empty_tables_read_as_empty(folder):
    assert folder.rows("stats") == set() and folder.rows("blacklist") == set()


def test_late_clicks_count(folder, spark):
    """Nothing is dropped however late it comes, in any job."""
    lines = [[_line(0)], [_line(2 * 3600)], [_line(1), _line(2 * 3600 - 3000)], [_line(-400 * 86400)]]
    for part in lines:
        folder.drop(*part, "x", "")
    folder.run(jobs.start_ad_trend)
    batch = _parsed(spark, sum(lines, []))
    assert folder.rows("trend") == {tuple(r) for r in ops.clicks_per_minute(batch).collect()}
    by_minute = {(r[1], r[2]): r[4] for r in folder.rows("trend") if r[0] == START.date()}
    assert by_minute == {("10", "00"): 2, ("12", "00"): 1, ("11", "10"): 1}
    assert folder.rows("line_counts") == {(13, 8)}
    per_batch = folder.tables.line_counts.rows(spark).orderBy("batch_id").collect()
    assert [(r.lines, r.malformed) for r in per_batch] == [(3, 2), (3, 2), (4, 2), (3, 2)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai"])
def test_running_counts_equal_batch_in_any_zone(spark, tmp_path, zone):
    folder = Folder(spark, tmp_path, compact_every=2)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        lines = []
        for f in range(5):
            part = [_line(f * 30000 + i * 61, "pq"[i % 2], ad=i % 3) for i in range(30)]
            lines += part
            folder.drop(*part)
            folder.run(jobs.start_ad_stat)
        expected = {tuple(r) for r in ops.running_click_counts(_parsed(spark, lines)).collect()}
        assert folder.rows("stats") == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("length, slide", [(1800, 600), (3600, 10)])
def test_sliding_stream_equals_batch(spark, tmp_path, length, slide):
    folder = Folder(spark, tmp_path, compact_every=2)
    lines = []
    for f in range(3):
        part = [_line(f * 1000 + i * 97, ad=i % 2) for i in range(30)]
        lines += part
        folder.drop(*part)
        folder.run(jobs.start_ad_sliding, length_seconds=length, slide_seconds=slide)
    expected = {tuple(r) for r in ops.clicks_sliding(_parsed(spark, lines), length, slide).collect()}
    steps = folder.tables.steps.current(spark)
    assert steps.count() <= len(lines)  # one row per step and ad, not per window
    assert {tuple(r) for r in jobs.sliding_windows(steps, length, slide).collect()} == expected


def test_repartitioned_lines(folder):
    folder.drop(_line(0))
    stream = readers.file_lines(folder.spark, str(folder.path / "in"), partitions=3)
    assert stream.isStreaming and stream.columns == ["value"]
