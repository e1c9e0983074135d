"""Conversion from page to page along a flow of pages, within sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numbers import ratio_round
from clickloom.operators import neighbours


def page_steps(actions: DataFrame, partitions: int | None = None) -> DataFrame:
    """(session_id, previous_page, page_id) of every action; the first one has no previous page.

    Actions of a session follow each other by time, then page; actions without a page are
    passed over, those without a session are left out. A session may span many tasks:
    the page before is carried over their edges.
    """
    pages = actions.where("session_id is not null and page_id is not null").select(
        "session_id", "action_time", "page_id"
    )
    order = [F.col("action_time").asc_nulls_first(), F.col("page_id")]
    rows = neighbours.laid_out(pages, ["session_id"], order, partitions)
    found = neighbours.last_before(rows, ["session_id"], {"previous_page": F.col("page_id")})
    return found.select("session_id", "previous_page", "page_id")


def page_step_conversion(
    actions: DataFrame, flow: Sequence[int], partitions: int | None = None
) -> DataFrame:
    """One row per step of the flow: how often it was taken, and its share of the step before.

    Step k goes straight from page k to page k + 1 of the flow. The first step is
    divided by the visits of the first page, a later one by the transitions of the step
    before; a share of zero is NULL. The flow may name a page repeatedly. All steps are
    counted in one pass as columns of a single row, so the flow should be a path and not
    a catalogue.
    """
    if len(flow) < 2:
        raise ValueError("a flow has at least two pages")
    steps = list(zip(flow, flow[1:], strict=False))
    taken = [
        F.count_if((F.col("previous_page") == a) & (F.col("page_id") == b)).alias(f"_{k}")
        for k, (a, b) in enumerate(steps, 1)
    ]
    first = F.count_if(F.col("page_id") == flow[0]).alias("_0")
    counts = page_steps(actions, partitions).agg(first, *taken)
    rows = [
        F.struct(
            F.lit(k).cast("bigint").alias("step"),
            F.lit(a).cast("bigint").alias("from_page"),
            F.lit(b).cast("bigint").alias("to_page"),
            F.col(f"_{k}").alias("transitions"),
            F.col(f"_{k - 1}").alias("reached"),
        )
        for k, (a, b) in enumerate(steps, 1)
    ]
    found = counts.select(F.inline(F.array(*rows)))
    share = ratio_round(F.col("transitions"), F.col("reached"))
    return found.withColumn("conversion_ratio", share)
