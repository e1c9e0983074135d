"""Near copies by the share of word shingles that two texts have in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import as_bytes, components, map_batches, remove, stored, stored_at
from clickloom.llm.simhash import _hashes

WIDTH = 5
LEAST = 0.8
# Two sets of similarity s share no band with chance (1 - s**ROWS) ** BANDS: 6e-4 at 0.8.
BANDS, ROWS = 40, 8
# Sizes within a step of this ratio are one bucket of the exact join.
STEP = 1.05

_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_FLIPS, _FACTORS = _DRAWN[0] << np.uint64(1), _DRAWN[1] | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
# shingles hashed together, so that they stay in the processor's cache
_CHUNK = 1 << 15


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted; fewer words than a shingle form one."""
    words = text.lower().split()
    return np.unique(np.array(_hashes(words, width) if words else [], np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of band keys for each set; no set may be empty."""
    out = np.empty((len(sets), BANDS), np.uint64)
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (last == first or held + len(sets[last]) <= _CHUNK):
            held += len(sets[last])
            last += 1
        joined = np.concatenate(sets[first:last])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[first:last]])[:-1]))
        for band in range(BANDS):
            key = np.full(last - first, band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                least = np.minimum.reduceat((joined ^ _FLIPS[k]) * _FACTORS[k], starts)
                key = (key ^ least) * _MIX
                key ^= key >> np.uint64(29)
            out[first:last, band] = key
        first = last
    return out


def _sketches(df: DataFrame, width: int) -> DataFrame:
    """``df`` with ``digest`` of the set, ``size`` and ``keys`` in place of ``__bytes``."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            sets = [shingles(raw, width) for raw in batch.column("__bytes").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = band_keys([s for s in sets if len(s)])
            ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0))))
            return {
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "size": pa.array(sizes),
                "keys": pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))
                ),
            }

        return step

    fields = {"digest": "binary", "size": "bigint", "keys": "array<bigint>"}
    return map_batches(df, make, fields, ("__bytes",))


def _sets(df: DataFrame, width: int) -> DataFrame:
    """``df`` with the ``shingles`` of ``__bytes`` in its place."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            sets = [shingles(raw, width) for raw in batch.column("__bytes").to_pylist()]
            return {"shingles": [s.view(np.int64) for s in sets]}

        return step

    return map_batches(df, make, {"shingles": "array<bigint>"}, ("__bytes",))


def _fits(a: Column, b: Column, least: float) -> Column:
    """Whether sets of these sizes can be so similar."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar, compared as whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(both / (F.size("sa") + F.size("sb") - both) >= least)
        .select("a", "b")
    )


def _unordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _head_pairs(mates: DataFrame, least: float) -> DataFrame:
    """Pairs of a set with the most central set of each of its bands.

    Central is who shares bands with most others: in a group of edited copies the text
    they come from, to which each is closer than to another copy.
    """
    crowd = mates.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    score = mates.join(crowd, "key").groupBy("node").agg(F.sum("n").alias("score"))
    heads = (
        mates.join(score, "node")
        .groupBy("key")
        .agg(F.max(F.struct("score", "node", "size")).alias("head"))
        .select("key", F.col("head.node").alias("head"), F.col("head.size").alias("head_size"))
    )
    met = mates.join(heads, "key").where("node <> head")
    return _unordered(met.where(_fits(F.col("size"), F.col("head_size"), least)), "node", "head")


def _close_pairs(close: DataFrame, unique: DataFrame, least: float) -> DataFrame:
    """(a, b) of every set that another method found close to others, with the first of those."""
    marked = unique.select("node", "size", "row").join(close.select("row", "near"), "row")
    heads = marked.where("row = near").select(
        "near", F.col("node").alias("head"), F.col("size").alias("head_size")
    )
    met = marked.where("row <> near").join(heads, "near")
    return met.where(_fits(F.col("size"), F.col("head_size"), least)).select(
        F.col("node").alias("a"), F.col("head").alias("b")
    )


def _open_pairs(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs that links of a set with its head (a, b) do not already connect."""
    side = lambda x: linked.select(F.col("a").alias(x), F.col("b").alias(f"{x}_head"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = F.coalesce("a_head", "a") != F.coalesce("b_head", "b")
    return both.where(apart).select("a", "b")


def _prefix_pairs(crowd: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, str]:
    """Stored pairs and their folder: pairs of (node, comp) from different components that may be similar; none is missed.

    Shingles are ordered rarest first. Two sets as similar as ``least`` share one of the
    first ``n - ceil(least * n) + 1``, and at the first that they share, what is left of
    both must still make the overlap: this bounds the other's size from both sides, so the
    join is on shingle and size bucket. A passage common to many texts sorts last and
    makes no pairs. Of each shingle, the component with most sets in its list only
    answers; the others ask.
    """
    tokens = crowd.join(sets, "node").select(
        "node", "comp", F.size("shingles").alias("size"), F.explode("shingles").alias("token")
    )
    often = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), (F.min("comp") < F.max("comp")).alias("open")
    )
    shared = tokens.join(often.where("n > 1"), "token")
    listed = shared.groupBy("node", "comp", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "token", "open"))).alias("shared")
    )
    # shingles of one set only come first, so their number is the place of the next
    prefix = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
    placed = listed.select(
        "node", "comp", "size", prefix.alias("prefix"),
        (F.col("size") - F.size("shared")).alias("before"), F.posexplode("shared"),
    )
    entries = placed.select(
        "node", "comp", "size", F.col("col.token").alias("token"), "prefix",
        (F.col("before") + F.col("pos")).alias("at"), F.col("col.open").alias("open"),
    ).where("open and at < prefix").select("node", "comp", "size", "token", "at")
    entries, folder = stored_at(entries)
    most = (
        entries.groupBy("token", "comp")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("token")
        .agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"))
        .where("comps > 1")
        .select("token", "most")
    )
    bucket = lambda size: F.floor(F.log(size) / float(np.log(STEP)) + 1e-9)
    rest = F.col("size") - F.col("at")
    largest = F.least(F.col("size") / least, rest * ((1 + least) / least) - F.col("size"))
    asking = entries.join(most, "token").where("comp <> most").select(
        "token", F.col("node").alias("x"), F.col("comp").alias("cx"),
        F.col("size").alias("nx"), F.col("at").alias("ax"),
        F.explode(F.sequence(bucket(least * F.col("size")), F.greatest(bucket(largest), bucket(least * F.col("size"))))).alias("bucket"),
    )
    answers = entries.withColumn("bucket", bucket(F.col("size")))
    needed = F.ceil(least / (1 + least) * (F.col("nx") + F.col("size")) - 1e-9)
    can = F.least(F.col("nx") - F.col("ax"), F.col("size") - F.col("at")) >= needed
    met = asking.join(answers, ["token", "bucket"]).where(F.col("cx") != F.col("comp"))
    pairs, pair_folder = stored_at(
        _unordered(met.where(can & _fits(F.col("nx"), F.col("size"), least)), "x", "node")
    )
    remove(entries.sparkSession, folder)
    return pairs, pair_folder


def near_copies(
    df: DataFrame,
    row_id: str,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    least: float = LEAST,
    close: DataFrame | None = None,
) -> DataFrame:
    """(row_id, doc_id, component_id, first) of every row of ``df``.

    ``row_id`` is a long that differs in every row and is the same whenever ``df`` is read.
    Texts are linked if their sets of ``width``-word shingles have a Jaccard similarity of
    at least ``least``; the component is its smallest id. Sets that share a MinHash band are
    candidates (at 0.8 a pair is missed with chance 6e-4, at 0.9 with 1e-10), and whole sets
    are compared, so no other pair is linked.

    ``close`` (row_id, component_id) has for each row the smallest row of those that another
    method holds for near copies. Their whole sets are compared first; what is linked
    so is not compared again by bands.

    Each set is compared with the most central band-mates first, which links a group of
    copies in one step, linear in its size. What is then left in bands of several
    components is joined exactly on its rarest shingles (see ``_prefix_pairs``), which
    finds every link among these sets, also those that share no band.

    ``first`` marks one row of each component: that with the smallest id (null last), then
    the smallest digest of its shingles, then the smallest row_id. Equal texts, repeated rows and
    rows that share an id are rows like others. Rows without an id take part but name no
    component; texts without words (null, empty, blank) are equal. Texts of any length count
    whole; only the named columns are read, so others may have any name.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(row_id).alias("row"), F.col(doc_id).alias("doc_id"), as_bytes(text).alias("__bytes")
    )
    keyed = stored(_sketches(rows, width))
    unique, unique_folder = stored_at(
        keyed.groupBy("digest")
        .agg(F.min("row").alias("row"), F.min("size").alias("size"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    bands = unique.select("node", "size", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").count().where("count > 1").select("key")
    mates, mates_folder = stored_at(bands.join(shared, "key"))
    met, gone = mates.select("node"), []
    if close is not None:
        near = close.select(F.col(row_id).alias("row"), F.col("component_id").alias("near"))
        near_pairs, folder = stored_at(_close_pairs(near, unique, least))
        gone.append(folder)
        met = met.unionByName(near_pairs.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = unique.join(met.distinct(), "node", "left_semi").select("node", "row")
    sets, sets_folder = stored_at(_sets(rows.join(wanted, "row").select("node", "__bytes"), width))

    heads = _head_pairs(mates, least)
    if close is None:
        links, links_folder = stored_at(_similar(heads, sets, least))
    else:
        linked, folder = stored_at(_similar(near_pairs, sets, least))
        gone.append(folder)
        others, links_folder = stored_at(_similar(_open_pairs(heads, linked), sets, least))
        links = linked.unionByName(others)
    roots = components(links)
    comps = mates.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    split = comps.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    crowd, crowd_folder = stored_at(
        comps.join(split.where("lo < hi"), "key", "left_semi").select("node", "comp").distinct()
    )
    pairs, pairs_folder = _prefix_pairs(crowd, sets, least)
    more, more_folder = stored_at(_similar(pairs, sets, least))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    rooted = unique.join(roots, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("root")
    )
    marked = keyed.select("row", "doc_id", "digest").join(rooted, "digest")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"), F.col("row"))
    groups = marked.groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min_by("row", order).alias("least_row")
    )
    found = stored(
        marked.join(groups, "root").select(
            F.col("row").alias(row_id),
            "doc_id",
            "component_id",
            (F.col("row") == F.col("least_row")).alias("first"),
        )
    )
    remove(
        spark, unique_folder, mates_folder, sets_folder, links_folder, crowd_folder, pairs_folder,
        more_folder, *gone,
    )
    return found
