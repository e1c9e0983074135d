"""One registered query per operator, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import text
from clickloom.functions.numbers import ratio_round
from clickloom.operators import actions as action_ops
from clickloom.operators import (
    areas,
    calendar,
    categories,
    clicks,
    keyed,
    sampling,
    sessions,
    stats,
    textjobs,
)
from clickloom.operators.filters import SessionCriteria, any_overlap, session_filter
from clickloom.plans import jobs, sequences
from clickloom.runtime import shared_dir
from clickloom.sources import bindings as b
from clickloom.sources import readers
from clickloom.sources.sinks import list_columns_as_text, stamped
from clickloom.streaming import jobs as streams
from clickloom.streaming.tables import AdTables

DAYS = jobs.DateRange("2024-01-02", "2024-01-29")
CRITERIA = SessionCriteria(
    start_age=10,
    end_age=50,
    professionals="BUILDING,MACHINERY,AUTOMOBILE,HOUSEHOLD",
    cities="",
    sex="1",
    keywords="kw1,kw2,kw3,kw7",
    category_ids=None,
)
TASK_ID = "20240131000000"
SEED = 7
SAMPLE_TOTAL = 3000
THRESHOLD = 2
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SPLIT_DATE = "2024-01-15"  # what is stored and what is new, for the merges


def _ntz(*names: str):
    """Wall-clock times, as the given tables hold them."""
    return {n: F.col(n).cast("timestamp_ntz") for n in names}


def _plain(df: DataFrame) -> DataFrame:
    """Result form: lists as text, wall-clock times."""
    out = list_columns_as_text(df)
    stamps = [n for n, t in out.dtypes if t == "timestamp"]
    return out.withColumns(_ntz(*stamps)) if stamps else out


def _sessions(s: SparkSession, d: str, compressed: bool = False) -> DataFrame:
    return sessions.session_spans(b.actions(s, d, compressed))


def _matching(s, d) -> DataFrame:
    return sessions.matching_sessions(b.actions(s, d), b.users(s, d), CRITERIA)


def _kept_actions(s, d) -> DataFrame:
    return jobs.matching_actions(b.actions(s, d), b.users(s, d), DAYS, CRITERIA)


def action_scan(s, d):
    return _plain(action_ops.action_scan(b.actions(s, d), *DAYS))


def session_aggregate(s, d):
    return _plain(sessions.session_aggregate(b.actions(s, d)))


def session_user_join(s, d):
    joined = sessions.session_user_join(_sessions(s, d), b.users(s, d))
    return _plain(joined.withColumn("age", F.col("age").cast("bigint")))


def _session_filter(s, d):
    joined = sessions.session_user_join(sessions.session_aggregate(b.actions(s, d)), b.users(s, d))
    return session_filter(joined, CRITERIA)


def session_filter_query(s, d):
    kept = _session_filter(s, d).withColumn("age", F.col("age").cast("bigint"))
    return _plain(kept)


def filter_any_match(s, d):
    found: Column = any_overlap(F.col("click_category_ids"), "5,50,95", "bigint")
    return sessions.session_aggregate(b.actions(s, d)).select(
        "session_id", found.alias("matches")
    )


def visit_length_bucket(s, d):
    bucketed = stats.visit_length_buckets(_sessions(s, d, compressed=True))
    return bucketed.select("session_id", "visit_length", "visit_bucket")


def step_length_bucket(s, d):
    bucketed = stats.step_length_buckets(_sessions(s, d))
    return bucketed.select("session_id", "step_length", "step_bucket")


def session_ratio_stats(s, d):
    result = jobs.session_statistics(b.actions(s, d), b.users(s, d), DAYS, CRITERIA)
    return stamped(result, TASK_ID)


def session_ratio_stats_all(s, d):
    """All sessions, compressed clock: fills the short buckets too."""
    return stats.session_ratio_stats(_sessions(s, d, compressed=True))


def bucket_counts(s, d):
    return stats.bucket_counts(_sessions(s, d, compressed=True))


def session_hour_counts(s, d):
    return sampling.session_hour_counts(_sessions(s, d))


def session_sample_quota(s, d):
    return sampling.session_sample_quota(session_hour_counts(s, d), SAMPLE_TOTAL)


def session_random_sample(s, d):
    actions = b.actions(s, d)
    sample = sampling.session_random_sample(_sessions(s, d), SAMPLE_TOTAL, SEED)
    return stamped(sampling.session_extract(actions, sample), TASK_ID)


def session_detail(s, d):
    actions = b.actions(s, d)
    sample = sampling.session_random_sample(_sessions(s, d), SAMPLE_TOTAL, SEED)
    detail = sampling.session_detail(actions, sample)
    return _plain(stamped(detail, TASK_ID))


def session_sample_job(s, d):
    """Ids and times of a sample of the filtered sessions, by hour."""
    actions = b.actions(s, d)
    sample = jobs.session_sample(actions, b.users(s, d), DAYS, CRITERIA, SAMPLE_TOTAL, SEED)
    return stamped(sampling.session_extract(actions, sample), TASK_ID)


def filtered_actions(s, d):
    return _plain(_kept_actions(s, d))


def category_click_counts(s, d):
    return categories.category_click_counts(b.actions(s, d))


def category_order_counts(s, d):
    return categories.category_order_counts(b.actions(s, d))


def category_pay_counts(s, d):
    return categories.category_pay_counts(b.actions(s, d))


def category_universe(s, d):
    return categories.category_universe(b.actions(s, d))


def category_funnel(s, d):
    return categories.category_funnel(b.actions(s, d))


def top10_category(s, d):
    top = categories.top_categories(categories.category_funnel(_kept_actions(s, d)))
    return stamped(top, TASK_ID)


def category_session_counts(s, d):
    return categories.category_session_counts(b.actions(s, d))


def top10_session(s, d):
    kept = _kept_actions(s, d)
    top = categories.top_categories(categories.category_funnel(kept))
    return stamped(categories.top_sessions(kept, top), TASK_ID)


def product_click_scan(s, d):
    return areas.product_click_scan(b.actions(s, d))


def click_city_join(s, d):
    return areas.click_city_join(product_click_scan(s, d), b.cities(s, d))


def area_product_counts(s, d):
    return areas.area_product_counts(product_click_scan(s, d), b.cities(s, d))


def concat_distinct(s, d):
    label = F.concat_ws(":", F.col("city_id").cast("string"), F.col("city_name"))
    return areas.concat_distinct(click_city_join(s, d), ["area"], label, "city_info")


def product_status_label(s, d):
    label = areas.product_status_label(F.col("extend_info"))
    return b.products(s, d).select("product_id", label.alias("product_status"))


def area_product_rank(s, d):
    return areas.area_product_rank(area_product_counts(s, d), b.products(s, d))


def area_top3_products(s, d):
    return jobs.area_ranking(b.actions(s, d), b.cities(s, d), b.products(s, d))


def ad_log_parse(s, d):
    return _plain(clicks.parse_ad_lines(b.ad_lines(s, d)))


def ad_log_malformed(s, d):
    return clicks.malformed_line_count(b.ad_lines(s, d))


def ad_user_click_count(s, d):
    return clicks.ad_user_click_counts(b.ad_clicks(s, d))


def blacklist_candidates(s, d):
    return clicks.blacklist_candidates(ad_user_click_count(s, d), THRESHOLD)


def blacklist_users(s, d):
    return clicks.blacklist_users(blacklist_candidates(s, d))


def _earlier(s, d):
    return b.ad_clicks(s, d).where(F.col("date") < F.lit(SPLIT_DATE).cast("date"))


def _later(s, d):
    return b.ad_clicks(s, d).where(F.col("date") >= F.lit(SPLIT_DATE).cast("date"))


def _blacklist(s, d, events):
    counts = clicks.ad_user_click_counts(events)
    return clicks.blacklist_users(clicks.blacklist_candidates(counts, THRESHOLD + 1))


def blacklist_filter(s, d):
    listed = _blacklist(s, d, b.ad_clicks(s, d))
    return _plain(clicks.blacklist_filter(b.ad_clicks(s, d), listed))


def blacklist_merge(s, d):
    old = _blacklist(s, d, _earlier(s, d))
    return keyed.only_new(old, _blacklist(s, d, _later(s, d)), ["userid"])


def ad_stat(s, d):
    return clicks.running_click_counts(b.ad_clicks(s, d))


def _by_province_ad(events: DataFrame) -> DataFrame:
    """Counts without the date, so that earlier and later keys meet."""
    return events.groupBy("province", "adid").agg(F.count(F.lit(1)).alias("click_count"))


def keyed_add_upsert(s, d):
    old, new = _by_province_ad(_earlier(s, d)), _by_province_ad(_later(s, d))
    return keyed.add_upsert(old, new, ["province", "adid"], "click_count")


def keyed_set_upsert(s, d):
    old, new = _by_city_ad(_earlier(s, d)), _by_city_ad(_later(s, d))
    return keyed.set_upsert(old, new, ["city", "adid"], "click_count")


def _by_city_ad(events: DataFrame) -> DataFrame:
    return events.groupBy("city", "adid").agg(F.count(F.lit(1)).alias("click_count"))


def keyed_replace(s, d):
    """Stored top ads of all days by all clicks; new ones by city, of the later days."""
    old = clicks.province_top_ads(ad_province_counts(s, d), k=5)
    later = clicks.running_click_counts(_later(s, d))
    new = clicks.province_top_ads(clicks.province_counts(later))
    return keyed.replace_groups(old, new, ["date", "province"])


def ad_province_counts(s, d):
    return clicks.province_counts(ad_stat(s, d))


def ad_province_top3(s, d):
    return clicks.province_top_ads(ad_province_counts(s, d))


def ad_province_top3_all_dates(s, d):
    return clicks.province_top_ads(ad_province_counts(s, d), scope=("province",))


def ad_click_trend(s, d):
    return clicks.clicks_per_minute(b.ad_clicks(s, d))


def ad_click_sliding(s, d):
    return _plain(clicks.clicks_sliding(b.ad_clicks(s, d)))


def _run_stream(s, d, start) -> AdTables:
    """A stream over all events as they arrive in four parts, restarted after each.

    Epochs of two batches let the tables fold and clear on the way.
    """
    folder = f"{shared_dir(s)}/streams/{uuid.uuid4().hex}"
    tables = AdTables.below(f"{folder}/tables", compact_every=2)
    for part in b.ad_line_parts(s, d):
        part.write.mode("append").text(f"{folder}/lines")
        lines = readers.file_lines(s, f"{folder}/lines")
        start(lines, tables, f"{folder}/checkpoint").awaitTermination()
    return tables


def _run_flow(s, d) -> AdTables:
    """The blacklist stream: who is listed by one part is dropped from the next."""
    return _run_stream(
        s, d, lambda lines, tables, at: streams.start_ad_flow(lines, tables, at, THRESHOLD, None)
    )


def stream_ad_blacklist(s, d):
    return _run_flow(s, d).blacklist.current(s)


def stream_ad_user_click_count(s, d):
    return _run_flow(s, d).user_clicks.current(s)


def stream_ad_province_top3(s, d):
    return _run_flow(s, d).province_top.current(s)


def stream_ad_line_counts(s, d):
    return _run_stream(
        s, d, lambda lines, tables, at: streams.start_ad_trend(lines, tables, at, None)
    ).line_counts.current(s)


def stream_ad_stat(s, d):
    return _run_stream(
        s, d, lambda lines, tables, at: streams.start_ad_stat(lines, tables, at, None)
    ).stats.current(s)


def stream_ad_click_trend(s, d):
    return _run_stream(
        s, d, lambda lines, tables, at: streams.start_ad_trend(lines, tables, at, None)
    ).trend.current(s)


def stream_ad_click_sliding(s, d):
    """Windows of 60 minutes every 10 minutes, from steps."""
    tables = _run_stream(
        s,
        d,
        lambda lines, tables, at: streams.start_ad_sliding(lines, tables, at, 3600, 600, None),
    )
    return _plain(streams.sliding_windows(tables.steps.current(s), 3600, 600))


def date_diff_features(s, d):
    lineitem = b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = b.table(s, d, "orders").select("o_orderkey", "o_orderdate")
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.col("o_orderdate").cast("timestamp").alias("ordered"),
        F.col("l_shipdate").cast("timestamp").alias("shipped"),
    )
    return calendar.date_diff_features(joined, "ordered", "shipped").drop("ordered", "shipped")


def date_part_features(s, d):
    events = b.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _plain(calendar.date_part_features(events, "ts"))


def _order_days(s, d):
    return (
        b.table(s, d, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )


def calendar_spine(s, d):
    """Orders of each priority per day, days without one as 0."""
    metrics = {f"orders_{p[0]}": F.count_if(F.col("o_orderpriority") == p) for p in PRIORITIES}
    daily = (
        b.table(s, d, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(*[column.alias(name) for name, column in metrics.items()])
    )
    return calendar.calendar_spine(daily, "date", list(metrics))


def week_calendar(s, d):
    return calendar.week_calendar(_order_days(s, d), "date")


def stepped_calendar(s, d):
    steps = calendar.stepped_calendar(_order_days(s, d), "date", n=3, step=-7)
    return steps.withColumn("position", F.col("position").cast("bigint"))


def date_validity_report(s, d):
    """Texts with days 1 to 33 and hours 0 to 25, so some are no real times."""
    day = F.lpad((F.col("o_orderkey") % 33 + 1).cast("string"), 2, "0")
    hour = F.lpad((F.col("o_custkey") % 26).cast("string"), 2, "0")
    month = F.date_format("o_orderdate", "MM")
    date = F.concat(F.lit("2024-"), month, F.lit("-"), day)
    time = F.concat(date, F.lit(" "), hour, F.lit(":30:00"))
    return calendar.date_validity_report(b.table(s, d, "orders"), time, date)


def _packed_sessions(s, d) -> DataFrame:
    """Sessions as ``k=v|k=v`` text; a session without clicks has an empty value."""
    rows = sessions.session_aggregate(b.actions(s, d))
    lists = text.list_text(F.col("click_category_ids"))
    packed = F.concat(
        F.lit("sessionid="),
        F.col("session_id"),
        F.lit("|clickCategoryIds="),
        lists,
        F.lit("|stepLength="),
        F.col("step_length").cast("string"),
    )
    return rows.select("session_id", packed.alias("packed"))


def kv_field_extract(s, d):
    fields = ["sessionid", "clickCategoryIds", "stepLength", "age"]
    return textjobs.kv_field_extract(_packed_sessions(s, d), "packed", fields).drop("packed")


def kv_field_rewrite(s, d):
    values = {"clickCategoryIds": "none", "age": "30"}
    return textjobs.kv_field_rewrite(_packed_sessions(s, d), "packed", values)


def text_normalise(s, d):
    """Comma-wrapped numbers of the events."""
    events = b.with_k(b.table(s, d, "events"))
    k = F.col("k").cast("string")
    wrapped = (
        F.when(F.col("event_type") == "click", F.concat(F.lit(","), k, F.lit(",")))
        .when(F.col("event_type") == "view", F.lit(""))
        .when(F.col("event_type") == "error", F.lit(None))
        .otherwise(k)
    )
    return textjobs.text_normalise(events.select("event_id", wrapped.alias("item")), "item")


def ratio_round_query(s, d):
    """Share of each customer's orders that are finished, to two places."""
    per_customer = (
        b.table(s, d, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
            F.count(F.lit(1)).alias("orders"),
        )
    )
    share = ratio_round(F.col("finished"), F.col("orders"))
    return per_customer.withColumn("finished_ratio", share)


QUERIES = {
    "action_scan": action_scan,
    "session_aggregate": session_aggregate,
    "session_user_join": session_user_join,
    "session_filter": session_filter_query,
    "filter_any_match": filter_any_match,
    "visit_length_bucket": visit_length_bucket,
    "step_length_bucket": step_length_bucket,
    "session_ratio_stats": session_ratio_stats,
    "session_ratio_stats_all": session_ratio_stats_all,
    "bucket_counts": bucket_counts,
    "session_hour_counts": session_hour_counts,
    "session_sample_quota": session_sample_quota,
    "session_random_sample": session_random_sample,
    "session_detail": session_detail,
    "session_sample_job": session_sample_job,
    "filtered_actions": filtered_actions,
    "category_click_counts": category_click_counts,
    "category_order_counts": category_order_counts,
    "category_pay_counts": category_pay_counts,
    "category_universe": category_universe,
    "category_funnel": category_funnel,
    "top10_category": top10_category,
    "category_session_counts": category_session_counts,
    "top10_session": top10_session,
    "product_click_scan": product_click_scan,
    "click_city_join": click_city_join,
    "area_product_counts": area_product_counts,
    "concat_distinct": concat_distinct,
    "product_status_label": product_status_label,
    "area_product_rank": area_product_rank,
    "area_top3_products": area_top3_products,
    "ad_log_parse": ad_log_parse,
    "ad_log_malformed": ad_log_malformed,
    "blacklist_filter": blacklist_filter,
    "ad_user_click_count": ad_user_click_count,
    "keyed_add_upsert": keyed_add_upsert,
    "blacklist_candidates": blacklist_candidates,
    "blacklist_users": blacklist_users,
    "blacklist_merge": blacklist_merge,
    "ad_stat": ad_stat,
    "keyed_set_upsert": keyed_set_upsert,
    "ad_province_counts": ad_province_counts,
    "ad_province_top3": ad_province_top3,
    "ad_province_top3_all_dates": ad_province_top3_all_dates,
    "keyed_replace": keyed_replace,
    "ad_click_trend": ad_click_trend,
    "ad_click_sliding": ad_click_sliding,
    "stream_ad_blacklist": stream_ad_blacklist,
    "stream_ad_user_click_count": stream_ad_user_click_count,
    "stream_ad_province_top3": stream_ad_province_top3,
    "stream_ad_stat": stream_ad_stat,
    "stream_ad_click_trend": stream_ad_click_trend,
    "stream_ad_click_sliding": stream_ad_click_sliding,
    "stream_ad_line_counts": stream_ad_line_counts,
    "date_diff_features": date_diff_features,
    "date_part_features": date_part_features,
    "calendar_spine": calendar_spine,
    "week_calendar": week_calendar,
    "stepped_calendar": stepped_calendar,
    "date_validity_report": date_validity_report,
    "kv_field_extract": kv_field_extract,
    "kv_field_rewrite": kv_field_rewrite,
    "text_normalise": text_normalise,
    "ratio_round": ratio_round_query,
    **sequences.QUERIES,
}
