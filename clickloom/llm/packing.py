"""Sharding by vector bin packing of bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import stored

# Groups are packed one by one if they hold more than 1 / LARGE of any total; there can
# be no more than 3 * LARGE such. The others are packed in BUNDLES bundles by hash.
LARGE = 16_384
BUNDLES = 32_768
# Slots are counted per shard in this many cells, so no task holds a whole shard.
CELLS = 2_048

_DIMENSIONS = ("bytes", "tokens", "rows")
# What residual capacity counts for in each: shards shall be equal in bytes first of all.
WEIGHTS = (16.0, 1.0, 1.0)


def place(sizes: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Shard of every item: largest first, to where size . residual capacity is highest.

    Sizes and capacities are measured as shares of the totals and weighed. Ties go to
    the lowest shard.
    """
    total = np.maximum(sizes.sum(axis=0), 1e-300)
    share = sizes / total
    weights = np.array(weights)
    residual = np.full((shards, sizes.shape[1]), 1.0 / shards)
    out = np.empty(len(sizes), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        best = int(np.argmax(residual @ (weights * share[i])))
        out[i] = best
        residual[best] -= share[i]
    return out


def shard(
    df: DataFrame,
    shards: int = 16,
    doc_id: str = "doc_id",
    text: str = "text",
    large: int = LARGE,
    bundles: int = BUNDLES,
    cells: int = CELLS,
) -> DataFrame:
    """One row per row of ``df``: id, ``size``, ``tokens``, ``text_crc32``, ``shard``, ``slot``.

    Rows of equal text form a group and stay in one shard, unless the group alone is
    more than a shard may hold; such a group is dealt in pieces of a quarter of that.
    Only digests and sizes are shuffled. At most ``3 * large + bundles`` items, plus the
    pieces of the at most ``3 * shards`` groups above a shard's share, are placed by
    the driver: a bound that does not depend on the corpus. Slots number the rows of a
    shard from 0 without a gap.

    A null text has size 1 and checksum 0, as an empty one, but is a group of its own; a
    null id is kept. Repeated rows are rows. An empty table gives no rows.
    """
    raw = F.col(text).cast("binary")
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(raw, F.lit(b"").cast("binary")), 256)).alias("key"),
        F.col(text).isNull().alias("absent"),
    ).withColumn("h", F.xxhash64("key", "absent"))
    rows = stored(rows)
    groups = rows.groupBy("key", "absent").agg(
        F.sum("size").alias("bytes"),
        F.sum("tokens").alias("tokens"),
        F.count(F.lit(1)).alias("rows"),
        F.first("h").alias("h"),
    )
    total = rows.agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
    ).first()
    totals = {n: max(1, total[n] or 0) for n in _DIMENSIONS}
    share = F.greatest(*[F.col(n) / F.lit(totals[n]) for n in _DIMENSIONS])
    groups = stored(groups.withColumn("share", share))
    big = groups.where(F.col("share") > 1.0 / large)
    # how many pieces a group is dealt in: one, unless no shard can hold it
    pieces = F.when(
        F.col("share") > 1.0 / shards, F.ceil(F.col("share") * (4 * shards))
    ).otherwise(F.lit(1)).cast("int")
    big = big.select("key", "absent", pieces.alias("pieces"))
    small = (
        groups.where(F.col("share") <= 1.0 / large)
        .groupBy(F.pmod("h", F.lit(bundles)).cast("int").alias("bundle"))
        .agg(*[F.sum(n).alias(n) for n in _DIMENSIONS])
        .orderBy("bundle")
    )
    big = stored(big)
    piece = F.pmod(F.xxhash64("doc_id", "size", F.lit(7)), F.col("pieces")).cast("int")
    dealt_out = (
        rows.join(F.broadcast(big.select("key", "absent", "pieces")), ["key", "absent"])
        .groupBy("key", "absent", piece.alias("piece"))
        .agg(
            F.sum("size").alias("bytes"),
            F.sum("tokens").alias("tokens"),
            F.count(F.lit(1)).alias("rows"),
            F.first("pieces").alias("pieces"),
        )
        .orderBy("key", "absent", "piece")
    )
    large_rows, small_rows = dealt_out.collect(), small.collect()
    sizes = [[r[n] for n in _DIMENSIONS] for r in [*large_rows, *small_rows]]
    where = place(np.array(sizes, float).reshape(-1, len(_DIMENSIONS)), shards).tolist()
    spark = df.sparkSession
    placed = spark.createDataFrame(
        [
            (r["key"], r["absent"], r["pieces"], r["piece"], at)
            for r, at in zip(large_rows, where, strict=False)
        ],
        "key binary, absent boolean, pieces int, piece int, at int",
    )
    placed = placed.groupBy("key", "absent").agg(
        F.first("pieces").alias("pieces"),
        F.map_from_entries(F.collect_list(F.struct("piece", "at"))).alias("at"),
    )
    dealt = spark.createDataFrame(
        [(r["bundle"], at) for r, at in zip(small_rows, where[len(large_rows) :], strict=True)],
        "bundle int, bundle_at int",
    )
    out = (
        rows.join(F.broadcast(placed), ["key", "absent"], "left")
        .withColumn("bundle", F.pmod("h", F.lit(bundles)).cast("int"))
        .join(F.broadcast(dealt), "bundle", "left")
        .withColumn("shard", F.coalesce(F.try_element_at("at", piece), F.col("bundle_at")))
        .select("doc_id", "size", "tokens", "text_crc32", "shard")
    )
    return _slots(stored(out), cells)


def _slots(rows: DataFrame, cells: int) -> DataFrame:
    """Numbers from 0 within each shard, as the start of a cell and the place within it."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int")
    rows = rows.withColumn("cell", cell)
    counts = rows.groupBy("shard", "cell").count()  # at most shards * cells rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "cell"])
        .withColumn("slot", (F.col("start") + F.col("place")).cast("bigint"))
        .drop("cell", "start", "place")
    )
