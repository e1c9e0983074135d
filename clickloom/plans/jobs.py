"""The four batch jobs, from input tables to result tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from clickloom.operators import actions as action_ops
from clickloom.operators import areas, categories, sampling, sessions, stats
from clickloom.operators.filters import SessionCriteria
from clickloom.sources.sinks import run_stamp, stamped

Sink = Callable[[DataFrame, str], None]


class DateRange(NamedTuple):
    start: str
    end: str


def session_statistics(
    actions: DataFrame, users: DataFrame, days: DateRange, criteria: SessionCriteria
) -> DataFrame:
    """Visit-length and step-length shares of the matching sessions."""
    scanned = action_ops.action_scan(actions, *days)
    return stats.session_ratio_stats(sessions.matching_sessions(scanned, users, criteria))


def session_sample(
    actions: DataFrame,
    users: DataFrame,
    days: DateRange,
    criteria: SessionCriteria,
    total: int,
    seed: int | str = 0,
) -> DataFrame:
    """Time-stratified sample of the matching sessions."""
    scanned = action_ops.action_scan(actions, *days)
    matching = sessions.matching_sessions(scanned, users, criteria)
    return sampling.session_random_sample(matching, total, seed)


def matching_actions(
    actions: DataFrame, users: DataFrame, days: DateRange, criteria: SessionCriteria
) -> DataFrame:
    """Actions of the matching sessions."""
    scanned = action_ops.action_scan(actions, *days)
    return action_ops.filtered_actions(
        scanned, sessions.matching_sessions(scanned, users, criteria)
    )


def area_ranking(
    actions: DataFrame, cities: DataFrame, products: DataFrame, k: int = 3
) -> DataFrame:
    """Best products per area."""
    counts = areas.area_product_counts(areas.product_click_scan(actions), cities)
    return areas.area_top_products(counts, products, k)


def run_session_statistics(actions, users, days, criteria, sink: Sink, task_id=None) -> str:
    task_id = task_id or run_stamp()
    result = session_statistics(actions, users, days, criteria)
    sink(stamped(result, task_id), "session_aggr_stat")
    return task_id


def run_session_sample(
    actions, users, days, criteria, total: int, sink: Sink, task_id=None, seed=0
) -> str:
    """Write the sample's summary and detail.

    The sample is drawn once and kept, so that both tables hold the same sessions.
    """
    task_id = task_id or run_stamp()
    scanned = action_ops.action_scan(actions, *days)
    sample = session_sample(actions, users, days, criteria, total, seed).persist()
    try:
        extract = sampling.session_extract(scanned, sample)
        sink(stamped(extract, task_id), "session_random_extract")
        detail = sampling.session_detail(scanned, sample)
        sink(stamped(detail, task_id), "session_detail")
    finally:
        sample.unpersist()
    return task_id


def run_category_ranking(
    actions, users, days, criteria, sink: Sink, task_id=None, k: int = 10
) -> str:
    """Write the top categories and the top sessions of each."""
    task_id = task_id or run_stamp()
    kept = matching_actions(actions, users, days, criteria).select(
        "session_id", "click_category_id", "order_category_ids", "pay_category_ids"
    )
    kept = kept.persist()
    try:
        top = categories.top_categories(categories.category_funnel(kept), k).persist()
        sink(stamped(top, task_id), "top10_category")
        best = categories.top_sessions(kept, top, k)
        sink(stamped(best, task_id), "top10_session")
        top.unpersist()
    finally:
        kept.unpersist()
    return task_id


def run_area_ranking(
    actions, cities, products, sink: Sink, task_id=None, k: int = 3
) -> str:
    task_id = task_id or run_stamp()
    sink(stamped(area_ranking(actions, cities, products, k), task_id), "area_top3_product")
    return task_id
