"""Session ratios over grouping sets, and sketches that merge over dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import buckets
from clickloom.functions.numbers import ratio_round

# Rank error of a quantile is about 1.65 / 2 ** LOG_K; of a distinct count 1.04 / 2 ** (LOG_M / 2).
KLL_K = 400
HLL_LOG_M = 14


def _counters():
    for name, low, high in buckets.VISIT_LENGTH_BUCKETS:
        yield f"visit_length_{name}", buckets.bucket_count(F.col("visit_length"), low, high)
    for name, low, high in buckets.STEP_LENGTH_BUCKETS:
        yield f"step_length_{name}", buckets.bucket_count(F.col("step_length"), low, high)


def session_grain(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Session and bucket counts of every combination of the ``by`` columns."""
    counts = [c.alias(n) for n, c in _counters()]
    return sessions.groupBy(*by).agg(F.count(F.lit(1)).alias("session_count"), *counts)


def ratios_over_sets(
    sessions: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """Session count and bucket ratios for every grouping set of the ``by`` columns.

    ``sets`` defaults to each column alone and all sessions together. ``grouping_id`` has
    a bit for each ``by`` column, the first one highest, set where the column is rolled up,
    so a null value is told from a total. Sessions are counted once, at the finest grain;
    only those counts are copied for the sets and added up.
    """
    wanted = [(c,) for c in by] + [()] if sets is None else [tuple(s) for s in sets]
    names = ["session_count", *[n for n, _ in _counters()]]
    grain = session_grain(sessions, by)
    rolled = grain.groupingSets([[F.col(c) for c in s] for s in wanted], *[F.col(c) for c in by]).agg(
        F.grouping_id().cast("bigint").alias("grouping_id"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
    )
    ratios = [ratio_round(F.col(n), F.col("session_count")).alias(f"{n}_ratio") for n in names[1:]]
    return rolled.select(*by, "grouping_id", "session_count", *ratios)


def session_sketches(sessions: DataFrame) -> DataFrame:
    """A sketch table: per date and hour of the start, distinct users and visit lengths.

    A row has a bounded size whatever it counts, and rows merge: over hours to days, over
    days to months, without reading a session again. Sessions without a start have date and
    hour null; null users and lengths are in no sketch.
    """
    return sessions.groupBy(
        F.to_date("start_time").alias("date"), F.hour("start_time").alias("hour")
    ).agg(
        F.count(F.lit(1)).alias("session_count"),
        F.hll_sketch_agg("user_id", F.lit(HLL_LOG_M)).alias("users"),
        F.kll_sketch_agg_bigint("visit_length", F.lit(KLL_K)).alias("lengths"),
    )


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches merged to coarser groups; without ``by`` to one row."""
    return sketches.groupBy(*by).agg(
        F.sum("session_count").alias("session_count"),
        F.hll_union_agg("users").alias("users"),
        F.kll_merge_agg_bigint("lengths", F.lit(KLL_K)).alias("lengths"),
    )


def sketch_figures(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Estimates read from sketches: distinct users, and visit lengths at the quantiles."""
    n = F.kll_sketch_get_n_bigint("lengths")
    lengths = [
        F.when(n > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))).alias(f"length_p{q * 100:g}")
        for q in quantiles
    ]
    kept = [c for c in sketches.columns if c not in ("users", "lengths")]
    return sketches.select(*kept, F.hll_sketch_estimate("users").alias("users"), *lengths)
