"""Benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import as_bytes, byte_words, map_batches, stored, with_bytes

WINDOW = 13
# Item text that one automaton is built from. A larger benchmark is scanned in
# blocks of this size, one automaton after the other, with the same result.
BLOCK_BYTES = 8 << 20
SHARE = 20  # contaminated from one hit word in this many

_SPANS = "array<struct<first_word:int,last_word:int,start:int,stop:int,item_id:string>>"


def item_windows(text: bytes, window: int = WINDOW) -> set[bytes]:
    """All windows of an item, words joined by blanks; a shorter item is one window."""
    words = byte_words(text)
    if not words:
        return set()
    n = max(1, len(words) - window + 1)
    return {b" ".join(words[i : i + window]) for i in range(n)}


def _automaton(items: list[tuple[str | None, bytes]], window: int):
    import ahocorasick

    owners: dict[bytes, list[str]] = {}
    for item, text in items:
        for piece in item_windows(text, window):
            found = owners.setdefault(piece, [])
            if item is not None:
                found.append(item)
    machine = ahocorasick.Automaton()
    for piece, ids in owners.items():
        # one character per byte, and blanks around it, so only whole words match
        machine.add_word(f" {piece.decode('latin-1')} ", (len(piece) + 1, tuple(ids)))
    machine.make_automaton()
    return machine if owners else None


def _word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of the original text start and stop."""
    b = np.frombuffer(text, dtype=np.uint8)
    lower = b | np.where((b >= 0x41) & (b <= 0x5A), 0x20, 0).astype(np.uint8)
    part = ((lower >= 0x30) & (lower <= 0x39)) | ((lower >= 0x61) & (lower <= 0x7A)) | (b >= 0x80)
    edge = np.diff(np.concatenate(([0], part.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scan(text: bytes, machine, spans: bool = False) -> tuple[int, np.ndarray, set[str], list]:
    """(words, marked words as a 0/1 array, items found, spans in the original bytes)."""
    words = byte_words(text)
    if not words or machine is None:
        return len(words), np.zeros(0, np.int8), set(), []
    line = f" {b' '.join(words).decode('latin-1')} "
    found = list(machine.iter(line))
    if not found:
        return len(words), np.zeros(0, np.int8), set(), []
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
    ends = np.array([end for end, _ in found])
    last = np.searchsorted(blanks, ends)  # the word before the closing blank, plus one
    first = np.searchsorted(blanks, ends - np.array([size for _, (size, _) in found]))
    depth = np.zeros(len(words) + 1, np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, last, -1)
    hit = (np.cumsum(depth[:-1]) > 0).astype(np.int8)
    items = {item for _, (_, ids) in found for item in ids}
    rows = []
    if spans:
        starts, stops = _word_offsets(text)
        rows = [
            (int(i), int(j - 1), int(starts[i]), int(stops[j - 1]), item)
            for i, j, (_, (_, ids)) in zip(first.tolist(), last.tolist(), found, strict=True)
            for item in ids or (None,)
        ]
    return len(words), hit, items, rows


def _item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """The benchmark in parts of bounded size, read from the cluster one by one."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), as_bytes(text).alias("bytes"))
    total = rows.agg(F.sum(F.length("bytes"))).first()[0] or 0
    blocks = int(-(-total // block_bytes)) or 1
    if blocks == 1:
        yield [(r.item, bytes(r.bytes)) for r in rows.collect()]
        return
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "bytes"), F.lit(blocks)))
    for block in range(blocks):
        yield [(r.item, bytes(r.bytes)) for r in rows.where(F.col("block") == block).collect()]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    spans: bool = False,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted), ``contaminated``, ``spans``.

    A document word is hit inside any occurrence of a window of an item. ``spans``, if
    asked for, hold word numbers and byte offsets in the original text for every
    occurrence, else they are empty. The automaton is made of the benchmark only; it is
    sent to the tasks in blocks of ``block_bytes`` of item text, so its size is bounded
    whatever the benchmark's, and words hit by different blocks are joined bit by bit.
    Null or empty texts and items have no words; repeated items count by their id. Items
    without an id hit words like others, but are not in ``item_ids``. ``keep`` names the columns carried along, by default all; columns
    named like the new ones are replaced.
    """
    spark = docs.sparkSession
    new = ("n_words", "n_hit", "item_ids", "contaminated", "spans")
    out = with_bytes(docs, text, keep, new)
    names = [c for c in out.columns if c != "__bytes"]
    fields = {
        "n_words": "bigint", "n_hit": "bigint", "__hit": "binary",
        "item_ids": "array<string>", "spans": _SPANS,
    }
    first = True
    blocks = _item_blocks(items, item_id, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        sent = spark.sparkContext.broadcast(block)
        last = following is None
        used = ("__bytes",) if last else ()
        out = map_batches(out, _step(sent, window, spans, first, last), fields, used)
        if not last:
            out = stored(out)
            sent.unpersist()
        first, block = False, following
    return out.select(
        *names,
        "n_words",
        "n_hit",
        "item_ids",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def _step(sent, window: int, spans: bool, first: bool, last: bool):
    def make():
        machine = _automaton(sent.value, window)

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {
                k: [] for k in ("n_words", "n_hit", "__hit", "item_ids", "spans")
            }
            texts = batch.column("__bytes").to_pylist()
            earlier = (
                [(b"", [], [])] * len(texts)
                if first
                else zip(
                    *(batch.column(c).to_pylist() for c in ("__hit", "item_ids", "spans")),
                    strict=True,
                )
            )
            for raw, (bits, ids, rows) in zip(texts, earlier, strict=True):
                words, hit, items, found = scan(raw, machine, spans)
                if bits:
                    old = np.unpackbits(np.frombuffer(bits, np.uint8))[:words]
                    hit = old | hit if hit.size else old
                out["n_words"].append(words)
                out["n_hit"].append(int(hit.sum()))
                out["__hit"].append(b"" if last or not hit.any() else np.packbits(hit).tobytes())
                out["item_ids"].append(sorted({*ids, *items}))
                out["spans"].append(
                    [tuple(r.values()) for r in rows] + found if spans else []
                )
            out["spans"] = [
                [
                    dict(zip(("first_word", "last_word", "start", "stop", "item_id"), r, strict=True))
                    for r in rows
                ]
                for rows in out["spans"]
            ]
            return out

        return step

    return make

