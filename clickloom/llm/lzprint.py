"""Document fingerprints from Lempel-Ziv phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import as_bytes, bounded_batches, map_batches, stored, with_bytes

HASHES = 64
SEED = 0x5EED
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) & 0xFFFFFFFFFFFFFFFF
    return x


_INVERSE = np.uint64(_inverse(int(_BASE)))
_rng = np.random.Generator(np.random.PCG64(SEED))
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown when needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = self._powers(_BASE, n), self._powers(_INVERSE, n)

    @staticmethod
    def _powers(base: np.uint64, n: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)


_POWERS = _Powers()


def parse(text: str, known: set[str] | None = None, start: int = 0) -> tuple[list[int], int]:
    """LZ78 parse from ``start``: (ends of new phrases, start of the unfinished rest).

    Each phrase is the shortest piece not in ``known`` yet, and joins it. All shorter
    beginnings of a phrase are phrases, so its length is searched from the last one.
    """
    known = set() if known is None else known
    ends = []
    n, i, size = len(text), start, 1
    add, append = known.add, ends.append
    while i < n:
        piece = text[i : i + size]
        if piece in known:
            size += 1
            while (piece := text[i : i + size]) in known and i + size <= n:
                size += 1
            if i + size > n:
                break
        else:
            while size > 1 and (shorter := text[i : i + size - 1]) not in known:
                piece = shorter
                size -= 1
        add(piece)
        i += size
        append(i)
    return ends, i


def _phrase_hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of phrases, from prefix hashes over the code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    _POWERS.upto(len(points) + 1)
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * _POWERS.up[: len(points)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _POWERS.down[starts]
    h ^= h >> np.uint64(32)  # low bits of such a sum are weak: mix before hashing again
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def signature(hashes: np.ndarray) -> str:
    """MinHash: the top byte of each of 64 smallest values; no phrases give zeros."""
    if not len(hashes):
        return "00" * HASHES
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _MUL + _ADD
        np.minimum(least, part.min(axis=0), out=least)
    mixed = least * np.uint64(0xFF51AFD7ED558CCD)  # the smallest values' own top bits are all zero
    return (mixed >> np.uint64(56)).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal places, corrected for those of 1/256 that agree by chance; 0 to 1."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    same = float((x == y).mean())
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def fingerprint(text: str) -> str:
    return _printed(text, parse(text)[0])


def _printed(text: str, ends: list[int]) -> str:
    e = np.array(ends, np.int64)
    starts = np.concatenate(([0], e[:-1])).astype(np.int64) if ends else e
    return signature(_phrase_hashes(text, starts, e))


class Parsed:
    """A text's fingerprint, and what is needed to parse on with another last third.

    The text and the edited text begin alike: that part is parsed once.
    """

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.known: set[str] = set()
        self.head, self.at = parse(text[: len(text) - len(text) // 3], self.known)
        self.fingerprint = _printed(text, self.head + parse(text, self.known.copy(), self.at)[0])

    def edited(self, following: str) -> tuple[str, str]:
        """(the edited text, its fingerprint); call once."""
        tail = len(self.text) // 3
        text = self.text[: len(self.text) - tail] + following[:tail]
        return text, _printed(text, self.head + parse(text, self.known, self.at)[0])


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``fingerprint`` of every text; null counts as empty."""
    def make():
        return lambda batch: {
            "fingerprint": [
                fingerprint(raw.decode("utf-8", "replace"))
                for raw in batch.column("__bytes").to_pylist()
            ]
        }

    return map_batches(
        with_bytes(df, text, None, ("fingerprint",)), make, {"fingerprint": "string"}, ("__bytes",)
    )


_ROW = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_NAMES = [part.split()[0] for part in _ROW.split(", ")]


def _compared(doc: Parsed, following: Parsed) -> tuple:
    text, edited = doc.edited(following.text)
    return (
        doc.doc_id,
        len(doc.text),
        hashlib.sha256(text.encode()).hexdigest(),
        doc.fingerprint,
        edited,
        likeness(doc.fingerprint, edited),
        likeness(doc.fingerprint, following.fingerprint),
    )


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a sorted partition against the next; the first and last row as edges."""
    part = TaskContext.get().partitionId()
    schema = pa.schema(
        [
            ("part", pa.int32()), ("edge", pa.string()), ("text", pa.binary()),
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ]
    )
    blank = (None,) * 6

    def out(rows):
        return pa.RecordBatch.from_pylist(
            [dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema
        )

    last = None
    for batch in batches:
        rows = []
        for doc_id, raw in zip(
            batch.column("doc_id").to_pylist(), batch.column("__bytes").to_pylist(), strict=True
        ):
            now = Parsed(doc_id, raw.decode("utf-8", "replace"))
            if last is None:
                rows.append((part, "first", raw, doc_id, *blank))
            else:
                rows.append((part, None, None, *_compared(last, now)))
            last = now
        if rows:
            yield out(rows)
    if last is not None:
        yield out([(part, "last", last.text.encode(), last.doc_id, *blank)])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            doc = Parsed(r["doc_id"], r["text"].decode("utf-8", "replace"))
            following = Parsed(None, r["following"].decode("utf-8", "replace"))
            rows.append(dict(zip(_NAMES, _compared(doc, following), strict=True)))
        if rows:
            yield pa.RecordBatch.from_pylist(rows)


def compare_with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to it and the next one.

    Order is by descending id, after the last comes the first; the edited text has its
    last third replaced by the beginning of the next text. Documents are sorted by range, the only
    shuffle of texts, and each task walks its own. A task's last document
    needs the first of the next task that has any: these two rows per task are kept
    and joined by task number afterwards.

    Null texts count as empty; null ids come last. Rows with the same id are ordered by
    a hash of their text, then by the text, so they spread over tasks. A single row is followed by itself. An empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.select(F.col(doc_id).cast("bigint").alias("doc_id"), as_bytes(text).alias("__bytes"))
        .withColumn("__hash", F.xxhash64("__bytes"))
        .repartitionByRange(parts, F.desc_nulls_last("doc_id"), "__hash")
        .sortWithinPartitions(F.desc_nulls_last("doc_id"), "__hash", "__bytes")
        .drop("__hash")
    )
    walked = stored(ordered.mapInArrow(_chain, f"part int, edge string, text binary, {_ROW}"))
    rows = walked.where("edge is null").select(*_NAMES)
    edges = walked.where("edge is not null")
    order = Window.orderBy("part")  # one small row per task
    heads = edges.where("edge = 'first'").select("part")
    top = heads.agg(F.min("part")).first()[0]
    follows = heads.select(
        "part", F.coalesce(F.lead("part").over(order), F.lit(top)).alias("next_part")
    )
    pairs = (
        edges.where("edge = 'last'")
        .select("part", "doc_id", "text")
        .join(follows, "part")
        .join(
            edges.where("edge = 'first'").select(
                F.col("part").alias("next_part"), F.col("text").alias("following")
            ),
            "next_part",
        )
        .select("doc_id", "text", "following")
    )
    return rows.unionByName(pairs.mapInArrow(_edges, _ROW))
