"""Sessions: one row per session from its actions, joined to users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import text
from clickloom.operators.filters import SessionCriteria

USER_COLUMNS = ("age", "professional", "city", "sex")


_LAST_USER = 2**63 - 1  # where a NULL user sorts
# Wider than the range of a bigint, so that no user id reaches into the next microsecond.
_MICRO = "20000000000000000000"


def _time_then_user() -> Column:
    """Time and user as one number, to find the user of the earliest action.

    A number has a fixed width, so the aggregate stays a hash aggregate; with
    a struct as ordering Spark would sort all actions instead.
    """
    micros = F.unix_micros("action_time").cast("decimal(18,0)")
    user = F.coalesce("user_id", F.lit(_LAST_USER)).cast("decimal(19,0)")
    return (micros * F.lit(_MICRO).cast("decimal(20,0)") + user).cast("decimal(38,0)")


def _visit_length() -> Column:
    return F.unix_timestamp("end_time") - F.unix_timestamp("start_time")


def session_spans(actions: DataFrame, criteria: SessionCriteria | None = None) -> DataFrame:
    """Sessions without their lists: user, times and lengths.

    Every running value has a fixed width, so actions combine by hash before
    the one shuffle, also those of a session with a large share of all rows.
    Where the criteria name keywords or categories, the match is folded in as
    a flag, so that no list is built just to be searched.
    """
    flags = {} if criteria is None else criteria.action_flags()
    spans = actions.groupBy("session_id").agg(
        F.min_by("user_id", _time_then_user()).alias("user_id"),
        F.min("action_time").alias("start_time"),
        F.max("action_time").alias("end_time"),
        F.count(F.lit(1)).alias("step_length"),
        *[F.max(c).alias(n) for n, c in flags.items()],
    )
    return spans.select(
        "session_id",
        "user_id",
        "start_time",
        "end_time",
        "step_length",
        *flags,
        _visit_length().alias("visit_length"),
    )


def session_aggregate(actions: DataFrame) -> DataFrame:
    """Sessions with the distinct keywords searched and categories clicked.

    The first grouping removes repeats, so that the second sees each value of
    a session once, however many actions carried it.
    """
    keyword = text.non_empty(F.col("search_keyword"))
    once = (
        actions.withColumn("search_keyword", keyword)
        .groupBy("session_id", "user_id", "search_keyword", "click_category_id")
        .agg(
            F.min("action_time").alias("start_time"),
            F.max("action_time").alias("end_time"),
            F.count(F.lit(1)).alias("step_length"),
        )
    )
    first_user = F.min_by("user_id", F.struct("start_time", F.coalesce("user_id", F.lit(_LAST_USER))))
    return (
        once.groupBy("session_id")
        .agg(
            first_user.alias("user_id"),
            F.min("start_time").alias("start_time"),
            F.max("end_time").alias("end_time"),
            F.sum("step_length").alias("step_length"),
            F.array_sort(F.collect_set("search_keyword")).alias("search_keywords"),
            F.array_sort(F.collect_set("click_category_id")).alias("click_category_ids"),
        )
        .withColumn("visit_length", _visit_length())
    )


def session_user_join(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with their user's attributes; those without a user drop out."""
    return sessions.join(users.select("user_id", *USER_COLUMNS), "user_id", "inner")


def matching_sessions(
    actions: DataFrame, users: DataFrame, criteria: SessionCriteria
) -> DataFrame:
    """Sessions that meet the criteria, without their lists.

    Same rows as filtering the joined aggregate, but the user conditions are
    applied to the users before the join and the list conditions as flags.
    """
    sessions = session_spans(actions, criteria)
    flags = list(criteria.action_flags())
    kept = sessions.where(F.expr(" AND ".join(flags))) if flags else sessions
    return session_user_join(kept.drop(*flags), users.where(criteria.user_condition()))
