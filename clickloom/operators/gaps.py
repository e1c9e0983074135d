"""Sessions by idle time, for logs without session ids, and the last action before a click."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators import neighbours

IDLE_SECONDS = 1800


def gap_sessions(
    actions: DataFrame,
    idle_seconds: int = IDLE_SECONDS,
    user: str = "user_id",
    time: str = "action_time",
    partitions: int | None = None,
) -> DataFrame:
    """One row per session of a user: a new one starts after ``idle_seconds`` or more of rest.

    Columns: the user, ``gap_session`` from 1, start_time, end_time, step_length,
    visit_length in seconds. Actions without user or time are in no session. A user may
    hold any share of all actions: time before and session number are carried over the
    edges of tasks, and sessions are summed before their shuffle.
    """
    rows = actions.where(f"`{user}` is not null and `{time}` is not null").select(
        F.col(user).alias("user"), F.col(time).alias("time")
    )
    placed = neighbours.laid_out(rows, ["user"], [F.col("time")], partitions)
    timed = neighbours.last_before(placed, ["user"], {"before": F.col("time")})
    rest = F.unix_micros("time") - F.unix_micros("before")
    starts = F.col("before").isNull() | (rest >= idle_seconds * 1_000_000)
    numbered = neighbours.running_sum(timed, ["user"], starts.cast("bigint"), "gap_session")
    spans = numbered.groupBy("user", "gap_session").agg(
        F.min("time").alias("start_time"),
        F.max("time").alias("end_time"),
        F.count(F.lit(1)).alias("step_length"),
    )
    length = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    return spans.withColumnRenamed("user", user).withColumn("visit_length", length)


def click_sessions(clicks: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """(userid, start_time, end_time, click_count) per user and idle time; tables and streams.

    A stream needs a watermark and gives a session when the watermark has passed its end.
    """
    window = F.session_window("ts", f"{idle_seconds} seconds")
    return (
        clicks.groupBy(window.alias("_session"), "userid")
        .agg(F.count(F.lit(1)).alias("click_count"), F.max("ts").alias("end_time"))
        .select("userid", F.col("_session.start").alias("start_time"), "end_time", "click_count")
    )


def as_of(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_time: str,
    right_time: str,
    take: dict[str, str],
    partitions: int | None = None,
) -> DataFrame:
    """``left`` with columns of the last row of ``right`` not later, for the same ``by``.

    ``take`` maps columns of ``right`` to their names in the result; they are null where no
    such row exists. Of rows of ``right`` with one time, the one with the greatest taken
    values counts. Rows of ``left`` without key or time are kept with nulls.

    Both sides are sorted together once and the last row is carried along, so the work is
    linear in both, and a key with a large share of all rows is spread over many tasks.
    """
    held = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    usable = F.col(by).isNotNull() & F.col(left_time).isNotNull()
    asking = left.select(
        F.col(by).alias("_by"), F.col(left_time).alias("_time"),
        F.lit(1).alias("_asks"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    telling = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(by).alias("_by"), F.col(right_time).alias("_time"),
        F.lit(0).alias("_asks"), held.alias("_right"),
    )
    both = asking.where("_by is not null and _time is not null").unionByName(
        telling, allowMissingColumns=True
    )
    order = [F.col("_time"), F.col("_asks"), F.col("_right")]
    placed = neighbours.laid_out(both, ["_by"], order, partitions)
    found = neighbours.last_before(placed, ["_by"], {"_last": F.col("_right")})
    matched = found.where("_asks = 1").select(
        "_left.*", *[F.col("_last").getField(n).alias(n) for n in take.values()]
    )
    kinds = dict(right.dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(n) for c, n in take.items()]
    return matched.unionByName(left.where(~usable).select("*", *none))
