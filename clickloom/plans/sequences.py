"""Registered queries over sequences of rows, grouping sets, sketches and stateful streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators import clicks, gaps, pageflow, rollups, sessions
from clickloom.runtime import shared_dir
from clickloom.sources import bindings as b
from clickloom.sources import partitions, readers
from clickloom.streaming import late, stateful, tables

FLOW = (1, 2, 3, 4, 5, 6, 7)
IDLE_SECONDS = 6 * 3600
LATENESS_SECONDS = 600
PROFILE = ("age", "professional", "city", "sex")
# When the four parts of the lines reach the log, for windows by arrival.
FIRST_ARRIVAL = "2024-03-01 12:00:00"
ARRIVAL_MINUTES = 25
SPLIT_DATE = "2024-01-15"


def _plain(df: DataFrame) -> DataFrame:
    stamps = [n for n, t in df.dtypes if t == "timestamp"]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in stamps})


def page_step_conversion(s, d):
    return pageflow.page_step_conversion(b.actions(s, d), FLOW)


def gap_sessions(s, d):
    return _plain(gaps.gap_sessions(b.actions(s, d), IDLE_SECONDS))


def click_last_view(s, d):
    """Every click with the user's last view before it."""
    events = b.with_k(b.table(s, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    asking = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select(
        "user_id", F.col("ts").alias("viewed"), (F.col("k") % 10).cast("bigint").alias("page")
    )
    take = {"viewed": "viewed_at", "page": "viewed_page"}
    return _plain(gaps.as_of(asking, views, "user_id", "ts", "viewed", take))


def _profiled(s, d) -> DataFrame:
    spans = sessions.session_spans(b.actions(s, d, compressed_clock=True))
    return sessions.session_user_join(spans, b.users(s, d))


def session_ratio_sets(s, d):
    """Ratios by age, by profession, by city, by sex, and of all sessions."""
    found = rollups.ratios_over_sets(_profiled(s, d), PROFILE)
    return found.withColumn("age", F.col("age").cast("bigint"))


def session_ratio_cube(s, d):
    sets = [("professional", "sex"), ("professional",), ("sex",), ()]
    return rollups.ratios_over_sets(_profiled(s, d), ("professional", "sex"), sets)


def session_sketch_days(s, d):
    """Hourly sketches merged to days, beside exact figures: whether they are within bounds.

    Users within five of a hundred of the exact number; the median between the exact
    quantiles 0.45 and 0.55.
    """
    spans = sessions.session_spans(b.actions(s, d, compressed_clock=True))
    daily = rollups.merged_sketches(rollups.session_sketches(spans), "date")
    found = rollups.sketch_figures(daily, (0.5,))
    exact = spans.groupBy(F.to_date("start_time").alias("date")).agg(
        F.countDistinct("user_id").alias("exact_users"),
        F.percentile("visit_length", F.array(F.lit(0.45), F.lit(0.55))).alias("around"),
    )
    users = F.abs(F.col("users") - F.col("exact_users")) <= 0.05 * F.col("exact_users")
    median = F.col("length_p50").between(F.floor(F.col("around")[0]), F.ceil(F.col("around")[1]))
    return found.join(exact, "date").select(
        "date", "session_count", "exact_users",
        users.alias("users_within"), median.alias("median_within"),
    )


def partition_replace(s, d):
    """The top lists of a table partitioned by date and province, new days in place of old."""
    path = f"{shared_dir(s)}/tables/{uuid.uuid4().hex}"
    counts = clicks.province_counts(clicks.running_click_counts(b.ad_clicks(s, d)))
    old = clicks.province_top_ads(counts, 5)
    keys = ("date", "province")
    partitions.replace_partitions(old, path, keys)
    fresh = clicks.province_top_ads(counts.where(F.col("date") >= F.lit(SPLIT_DATE).cast("date")))
    partitions.replace_partitions(fresh, path, keys)
    return partitions.read_partitions(s, path, old.schema)


def _stream(
    s: SparkSession,
    parts: Iterable[DataFrame],
    start: Callable[[DataFrame, str, str], StreamingQuery],
    copies: int = 1,
) -> str:
    """A stream over parts that arrive one after the other, restarted after each.

    Gives the folder of its tables. Each part is delivered ``copies`` times.
    """
    folder = f"{shared_dir(s)}/streams/{uuid.uuid4().hex}"
    for part in parts:
        for _ in range(copies):
            part.write.mode("append").text(f"{folder}/lines")
            lines = readers.file_lines(s, f"{folder}/lines")
            start(lines, f"{folder}/tables", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/tables"


def stream_ad_stat_state(s, d):
    """Running counts in the state store."""
    at = _stream(
        s,
        b.ad_line_weeks(s, d),
        lambda lines, path, mark: stateful.start_ad_stat_state(
            lines, tables.state_totals(path, 2), mark, interval=None
        ),
    )
    return tables.state_totals(at, 2).current(s)


def stream_ad_unique(s, d):
    """Counts of lines that were all delivered twice."""
    at = _stream(
        s,
        b.ad_line_weeks(s, d),
        lambda lines, path, mark: stateful.start_unique_ad_stat(
            lines, tables.unique_totals(path, 2), mark, "10 days", None
        ),
        copies=2,
    )
    return tables.unique_totals(at, 2).current(s)


def stream_click_sessions(s, d):
    """Sessions by idle time that the watermark has closed."""
    at = _stream(
        s,
        b.ad_line_weeks(s, d),
        lambda lines, path, mark: stateful.start_click_sessions(
            lines, tables.closed_sessions(path, 2), mark, IDLE_SECONDS, "1 hour", None
        ),
    )
    return _plain(tables.closed_sessions(at, 2).current(s).drop("date"))


def stream_ad_window_late(s, d):
    """Hourly clicks on time and late; every part but the first brings late ones."""
    at = _stream(
        s,
        b.ad_line_parts(s, d),
        lambda lines, path, mark: late.start_windows(
            lines, tables.LateTables.below(path, 2), mark, 3600, LATENESS_SECONDS, None
        ),
    )
    return _plain(late.reconciled(tables.LateTables.below(at, 2), s))


def stream_ad_arrival_hour(s, d):
    """Clicks of the last hour by arrival, after each part."""
    folder = f"{shared_dir(s)}/streams/{uuid.uuid4().hex}"
    table = tables.arrival_totals(f"{folder}/tables", 2)
    first = F.lit(FIRST_ARRIVAL).cast("timestamp")
    for n, part in enumerate(b.ad_line_parts(s, d)):
        arrived = first + F.make_interval(mins=F.lit(n * ARRIVAL_MINUTES))
        timed = part.withColumn("arrived", arrived)
        timed.write.mode("append").parquet(f"{folder}/lines")
        lines = s.readStream.schema(timed.schema).parquet(f"{folder}/lines")
        stateful.start_arrival_trend(lines, table, f"{folder}/checkpoint", interval=None).awaitTermination()
    found = table.current(s).where("not expired").select("as_of", "adid", "click_count")
    return _plain(found)


QUERIES = {
    f.__name__: f
    for f in (
        page_step_conversion,
        gap_sessions,
        click_last_view,
        session_ratio_sets,
        session_ratio_cube,
        session_sketch_days,
        partition_replace,
        stream_ad_stat_state,
        stream_ad_unique,
        stream_click_sessions,
        stream_ad_window_late,
        stream_ad_arrival_hour,
    )
}
