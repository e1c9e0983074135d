"""Repeatable sample of sessions, stratified by date and hour.

Nothing here ranks or counts a whole hour in one task. Sessions are ordered
inside an hour by a seeded hash; its first hex digits split the hour into
slices whose sizes are counted first. That tells which slices are taken whole
and in which slice the quota ends, so only rows within a slice are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import text
from clickloom.operators import actions as action_ops
from clickloom.operators import sessions as session_ops
from clickloom.runtime import stored

CELL = ("date", "hour")
SLICE_DIGITS = 3  # 4,096 slices per hour


def _celled(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns(
        {"date": F.to_date("start_time"), "hour": F.hour("start_time").cast("bigint")}
    )


def session_hour_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per date and hour of their start."""
    return _celled(sessions).groupBy(*CELL).agg(F.count(F.lit(1)).alias("session_count"))


def session_sample_quota(hour_counts: DataFrame, total: int) -> DataFrame:
    """How many sessions to draw from each date and hour.

    Days share ``total`` equally in whole numbers; within a day each hour gets
    its share of the day's sessions, rounded down. A small total over many
    days can therefore give an empty sample.
    """
    days = hour_counts.select(F.count_distinct("date")).scalar()
    return (
        hour_counts.withColumn("day_count", F.sum("session_count").over(W.partitionBy("date")))
        .withColumn("per_day", F.floor(F.lit(total) / days))
        .withColumn(
            "quota",
            F.least(
                F.floor(
                    F.col("per_day")
                    * (F.col("session_count").cast("double") / F.col("day_count"))
                ),
                F.col("session_count"),
            ),
        )
    )


def session_random_sample(sessions: DataFrame, total: int, seed: int | str = 0) -> DataFrame:
    """Draw each hour's quota of sessions without replacement.

    The same seed gives the same sample. Sessions with their hashes are kept as a
    table first, so they are aggregated once though counts, quotas and the draw all
    read them; that runs when this is called.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("session_id")))
    hashed = (
        _celled(sessions)
        .withColumn("_hash", order)
        .withColumn("_slice", F.substring("_hash", 1, SLICE_DIGITS))
    )
    hashed = stored(hashed)
    slices = hashed.groupBy(*CELL, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    hour_counts = slices.groupBy(*CELL).agg(F.sum("_n").alias("session_count"))
    quota = session_sample_quota(hour_counts, total).where("quota > 0").select(*CELL, "quota")

    upto = W.partitionBy(*CELL).orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)
    last_slices = (
        slices.withColumn("_upto", F.sum("_n").over(upto))
        .join(quota, list(CELL))
        .where("_upto >= quota AND _upto - _n < quota")
        .select(
            *CELL,
            F.col("_slice").alias("_last"),
            (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_rest"),
        )
    )
    in_slice = W.partitionBy(*CELL, "_slice").orderBy("_hash", "session_id")
    return (
        hashed.join(last_slices, list(CELL))
        .where("_slice <= _last")
        .withColumn("_rank", F.row_number().over(in_slice))
        .where("_slice < _last OR _rank <= _rest")
        .drop("_hash", "_slice", "_last", "_rest", "_rank")
    )


def session_extract(actions: DataFrame, sample: DataFrame) -> DataFrame:
    """Summary row of each sampled session; lists are built for these only."""
    lists = session_ops.session_aggregate(action_ops.filtered_actions(actions, sample))
    return lists.select(
        "session_id",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        text.list_text(F.col("search_keywords")).alias("search_keywords"),
        text.list_text(F.col("click_category_ids")).alias("click_category_ids"),
    )


def session_detail(actions: DataFrame, sample: DataFrame) -> DataFrame:
    """Every action of the sampled sessions."""
    return action_ops.filtered_actions(actions, sample).select(
        "user_id",
        "session_id",
        "page_id",
        "action_time",
        "search_keyword",
        "click_category_id",
        "click_product_id",
        text.list_text(F.col("order_category_ids")).alias("order_category_ids"),
        text.list_text(F.col("order_product_ids")).alias("order_product_ids"),
        text.list_text(F.col("pay_category_ids")).alias("pay_category_ids"),
        text.list_text(F.col("pay_product_ids")).alias("pay_product_ids"),
    )
