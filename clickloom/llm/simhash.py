"""SimHash near-duplicates found by Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import components, map_batches, sorted_groups, stored, with_bytes

SHINGLE = 3
SEED = 42
MAX_BITS = 2
# A key shared by more fingerprints than this is linked through common neighbours
# instead of being compared pair by pair; either way finds the same links.
PAIRWISE = 64

# The 64 bits as three segments, each read as a word of the (23, 12) Golay code.
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_N, _K = 23, 12


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text."""
    words = text.lower().split()  # bytes: lower-cases A-Z, splits at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    return int(_majority([_hashes(words, width)])[0])


def _hashes(words: list[bytes], width: int) -> list[int]:
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [hashed(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return [
        hashed(line[i:j], SEED)
        for i, j in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)
    ]


def _majority(groups: list[list[int]]) -> np.ndarray:
    """For each group of hashes the word of the bits set in over half of them."""
    out = np.zeros(len(groups), np.uint64)
    sizes = np.array([len(g) for g in groups], np.int64)
    if not sizes.sum():
        return out
    h = np.concatenate([np.array(g, np.uint64) for g in groups if g])
    full = np.flatnonzero(sizes)
    n = sizes[full]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    # byte lanes hold at most 255: groups are summed in pieces, then the pieces widened
    pieces = -(-n // 255)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & ones, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        set_ = (2 * counts > n[:, None]).astype(np.uint64)
        for lane in range(8):
            out[full] |= set_[:, lane] << np.uint64(8 * lane + bit)
    return out


def fingerprints(
    df: DataFrame,
    text: str = "text",
    width: int = SHINGLE,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``df`` with ``fp``, the 64-bit SimHash as a signed long.

    Null, empty or blank texts have fingerprint zero; fewer words than a shingle form
    one shingle. Other columns, or those in ``keep``, are carried along.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found: list[np.ndarray] = []
            groups: list[list[int]] = []
            held = 0
            for raw in batch.column("__bytes").to_pylist():
                words = raw.lower().split()
                groups.append(_hashes(words, width) if words else [])
                held += len(groups[-1])
                if held > 1_000_000:
                    found.append(_majority(groups))
                    groups, held = [], 0
            found.append(_majority(groups))
            return {"fp": pa.array(np.concatenate(found).view(np.int64))}

        return step

    return map_batches(with_bytes(df, text, keep, ("fp",)), make, {"fp": "bigint"}, ("__bytes",))


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(_N - 1, _N - _K - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (_GENERATOR << (bit - _N + _K)), rest)
    return rest


def _error_table() -> np.ndarray:
    """The only error of at most three bits for each of the 2,048 syndromes: the code is perfect."""
    errors = np.array(
        [sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(_N), k)]
    )
    table = np.full(1 << (_N - _K), -1, np.int64)
    table[_syndrome(errors)] = errors
    return table


_ERRORS = _error_table()
_BIT_SYNDROMES = _syndrome(1 << np.arange(_N))


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every codeword within four bits of each 23-bit word.

    A word is one to three bits or fewer from exactly one codeword. Up to two bits
    away there is no other within four; three bits away there are five more. Words
    that differ in one bit always share an index: if one lies within three bits of a
    codeword, the other lies within four.
    """
    own = _syndrome(words)
    nearest = words ^ _ERRORS[own]
    rows = [np.arange(len(words))]
    found = [nearest >> (_N - _K)]
    far = np.flatnonzero(np.bitwise_count(_ERRORS[own].astype(np.uint64)) == 3)
    if far.size:
        flipped = words[far, None] ^ (1 << np.arange(_N))
        other = flipped ^ _ERRORS[own[far, None] ^ _BIT_SYNDROMES]
        index = np.sort(np.where(other == nearest[far, None], -1, other >> (_N - _K)), axis=1)
        new = np.diff(index, axis=1, prepend=-1) != 0
        rows.append(np.repeat(far, new.sum(axis=1)))
        found.append(index[new])
    return np.concatenate(rows), np.concatenate(found)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) so that fingerprints within two bits share a key.

    Of three segments with two errors in all, one has none and the one after it, in
    a circle, has at most one (try the six placings). A key is the first as it is and
    a codeword index near the second.
    """
    parts = [
        (fps.view(np.uint64) >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)
        for at, n in _SEGMENTS
    ]
    rows, keys = [], []
    for k in range(3):
        row, index = codeword_indices(parts[(k + 1) % 3])
        rows.append(row)
        keys.append((k << 34) | (parts[k][row] << _K) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy()
            if len(values):
                rows, keys = fuzzy_keys(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(values[rows])], names=["key", "fp"]
                )

    return fps.mapInArrow(run, "key long, fp long")


def _pairs(batches):
    """Verified links among the fingerprints of each key of a sorted partition."""
    for piece in sorted_groups(batches, "key"):
        keys, fps = piece["key"], piece["fp"]
        shift = 1
        while shift < len(keys):
            same = np.flatnonzero(keys[shift:] == keys[:-shift])
            if not same.size:
                break
            a, b = fps[same], fps[same + shift]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
            if near.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[near]), pa.array(b[near])], names=["a", "b"]
                )
            shift += 1


def links(fps: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints are within two bits.

    Fingerprints meet by fuzzy keys and are compared. Where more than ``pairwise``
    share a key, nobody is compared with everybody: two words within two bits have a
    word within one bit of both, so each is linked to the smallest one around each of
    its 65 such words. That connects the same ones with rows linear in their number.
    """
    keyed = _keyed(fps)
    crowded = keyed.groupBy("key").count().where(F.col("count") > pairwise).select("key")
    crowded = stored(crowded)
    calm = keyed.join(crowded, "key", "left_anti")
    parts = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    pairs = (
        calm.repartition(int(parts), "key").sortWithinPartitions("key").mapInArrow(_pairs, "a long, b long")
    )
    dense = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    middle = F.explode(
        F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
    )
    around = dense.select("fp", middle.alias("m"))
    least = around.groupBy("m").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    stars = around.join(least, "m").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``df`` with ``fp`` and ``component_id``, the smallest id reachable by links.

    Fingerprints differing in at most two bits are linked. Equal fingerprints count as
    one while links are sought, so copies cost nothing there. Fingerprints and ids are
    written to the shared folder, as they are read several times; texts are not. Rows
    without an id have a fingerprint and take part, but name no component: one whose
    ids are all null has a null component. Repeated rows stay. An empty table gives an
    empty result.
    """
    keys = stored(
        fingerprints(df.select(F.col(doc_id).alias("__id"), F.col(text)), text, width, ("__id",))
    )
    unique = stored(keys.groupBy("fp").agg(F.min("__id").alias("least")))
    roots = components(links(unique.select("fp"))).withColumnRenamed("node", "fp")
    rooted = unique.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    if keep == (doc_id,) or df.columns == [doc_id]:
        return keys.join(labels, "fp").select(F.col("__id").alias(doc_id), "fp", "component_id")
    new = ("fp", "component_id")
    named = [c for c in (df.columns if keep is None else keep) if c not in new]
    marked = fingerprints(df, text, width, tuple(dict.fromkeys([*named, text])))
    return marked.join(labels, "fp").select(*named, "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
