"""Quality rules: word and line repeats, and compression bands of whole texts and chunks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from clickloom.llm.common import map_batches, with_bytes

SYMBOLS = b"#*$%&|<>"
# Words of a window that may repeat; a power of two.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LEVEL = 3

_SPACES = b" \t\n\v\f\r"
# Bytes that begin a code point of a word: neither white space nor a continuation byte.
_WORD_CHAR = np.array([b not in _SPACES and b & 0xC0 != 0x80 for b in range(256)])


@dataclass(frozen=True)
class Bands:
    """Limits of compressed by plain bytes, for texts and for their chunks.

    ``texts`` holds (from so many bytes on, least ratio, greatest ratio); shorter texts
    than the first entry are not judged, since a frame's own bytes outweigh them. The
    ratio of prose falls with its length, so do the limits. Text below the least ratio
    repeats itself, text above the greatest is encoded or random.

    Chunks are cut every ``chunk_bytes``; a last one of under half of that is not
    judged. A text fails if more than ``chunk_share`` of its judged bytes lie in chunks
    outside ``chunk_limits``.
    """

    texts: tuple[tuple[int, float, float], ...] = (
        (64, 0.40, 1.60),
        (128, 0.35, 1.05),
        (256, 0.30, 0.88),
        (1024, 0.25, 0.78),
        (4096, 0.20, 0.72),
        (16384, 0.17, 0.70),
    )
    chunk_bytes: int = 4096
    chunk_limits: tuple[float, float] = (0.20, 0.72)
    chunk_share: float = 0.25

    def limits(self, n_bytes: int) -> tuple[float, float] | None:
        found = None
        for least_bytes, low, high in self.texts:
            if n_bytes >= least_bytes:
                found = (low, high)
        return found


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more.

    Windows are compared exactly: places are numbered by what stands there, first one
    word, then pairs, then pairs of pairs.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    width = 1
    while True:
        ids = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        width *= 2
        values, ids, counts = np.unique(ids, return_inverse=True, return_counts=True)
        if len(values) == len(ids):
            return 0
        if width == WINDOW:
            break
    starts = np.flatnonzero(counts[ids] > 1)
    steps = np.zeros(n + 1, np.int64)
    steps[starts] += 1
    steps[starts + WINDOW] -= 1
    return int((np.cumsum(steps) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


def _measure(text: bytes, coder: zstandard.ZstdCompressor, bands: Bands) -> tuple:
    words = text.split()  # bytes: splits at \\x20 and \\x09-\\x0D
    repeats = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    chars = int(_WORD_CHAR[np.frombuffer(text, np.uint8)].sum())
    ratio = len(coder.compress(text)) / len(text) if text else None
    limits = bands.limits(len(text))
    whole = limits is None or limits[0] <= ratio <= limits[1]
    judged = outside = chunks = 0
    low, high = bands.chunk_limits
    if len(text) > bands.chunk_bytes:  # a single chunk is the text
        for at in range(0, len(text), bands.chunk_bytes):
            piece = text[at : at + bands.chunk_bytes]
            if 2 * len(piece) < bands.chunk_bytes:
                continue
            chunks += 1
            judged += len(piece)
            if not low <= len(coder.compress(piece)) / len(piece) <= high:
                outside += len(piece)
    share = outside / judged if judged else 0.0
    kept = not failed and whole and share <= bands.chunk_share
    symbols = sum(text.count(s) for s in SYMBOLS)
    return (
        len(words), chars, symbols, duplicate_lines(text), repeats, failed,
        ratio, chunks, share, kept,
    )


_FIELDS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "base_failed": "boolean",
    "ratio": "double",
    "n_chunks": "bigint",
    "bad_chunk_share": "double",
    "kept": "boolean",
}


def judged(
    df: DataFrame,
    text: str = "text",
    bands: Bands | None = None,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Every row with its counts, compression ratio and verdict, in one pass.

    ``base_failed``: fewer than 20 words, or over 30 of 100 words in repeated windows.
    ``kept``: not failed so, the whole text's ratio within the limits of its length, and
    at most a quarter of its bytes in chunks outside theirs. ``ratio`` is null for empty
    texts, ``n_chunks`` 0 for texts of one chunk, which the whole ratio judges.

    Null text counts as empty: no words, not kept. Rows are judged one by one, so repeated
    rows have equal results; texts of any length are measured whole. Other columns, or
    those in ``keep``, are carried along; those named like a result are replaced.
    """
    used = bands or Bands()

    def make():
        coder = zstandard.ZstdCompressor(level=LEVEL)

        def step(batch: pa.RecordBatch) -> dict:
            rows = [_measure(raw, coder, used) for raw in batch.column("__bytes").to_pylist()]
            return dict(zip(_FIELDS, map(list, zip(*rows, strict=True)), strict=True))

        return step

    return map_batches(with_bytes(df, text, keep, tuple(_FIELDS)), make, _FIELDS, ("__bytes",))
