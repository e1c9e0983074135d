"""Byte-level BPE encoding and decoding by a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import map_batches, with_bytes

# A text above this many characters is cut at safe boundaries, so one call of the
# library never holds a whole very long text.
CHUNK_CHARS = 1 << 16
# A stretch without any safe boundary above this is matched pattern by pattern.
LONGEST_CHUNK = 1 << 18

# Before a blank or line break that follows no white space, every pattern match ends.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: one base64 token and its rank per line."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Consecutive parts whose encodings, one after the other, are the text's encoding."""
    start, n = 0, len(text)
    while n - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    if start < n:
        yield text[start:]


class ByteBpe:
    """Encoder and decoder of one vocabulary, without special tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        self.pattern = pattern
        self.coding = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={}
        )

    def encode(self, text: str) -> list[int]:
        if len(text) <= CHUNK_CHARS:
            return self.coding.encode_ordinary(text)
        ids: list[int] = []
        for chunk in safe_chunks(text):
            ids += (
                self.coding.encode_ordinary(chunk)
                if len(chunk) <= LONGEST_CHUNK
                else self._by_match(chunk)
            )
        return ids

    def _by_match(self, text: str) -> list[int]:
        """The pattern matched here, as a run of white space this long is too much for the library."""
        import regex

        ids: list[int] = []
        for match in regex.finditer(self.pattern, text):
            ids += self.coding._encode_single_piece(match.group().encode())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes; ids need not stand for whole characters."""
        return self.coding.decode_bytes(ids)


def _rank_bytes(df: DataFrame, rank_path: str):
    with open(rank_path, "rb") as file:  # a vocabulary: about a megabyte, whatever the corpus
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(
    df: DataFrame,
    rank_path: str,
    pattern: str,
    text: str = "text",
    decode: bool = False,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``df`` with ``ids`` (packed little-endian unsigned 32-bit) and ``n_tokens``.

    With ``decode`` also ``decoded``, the bytes got back from the ids. The rank file
    is read by the driver and sent to the tasks, so executors need no copy of it.
    Null texts count as empty and give no tokens; bytes that are not UTF-8 are read as
    U+FFFD. ``keep`` names the columns carried along, by default all; columns named like
    the new ones are replaced. Repeated rows stay.
    """
    ranks = _rank_bytes(df, rank_path)
    fields = {"ids": "binary", "n_tokens": "bigint"} | ({"decoded": "binary"} if decode else {})

    def make():
        coder = ByteBpe(ranks.value, pattern)

        def step(batch):
            out: dict[str, list] = {name: [] for name in fields}
            for raw in batch.column("__bytes").to_pylist():
                ids = coder.encode(raw.decode("utf-8", "replace"))
                out["ids"].append(np.array(ids, dtype="<u4").tobytes())
                out["n_tokens"].append(len(ids))
                if decode:
                    out["decoded"].append(coder.decode(ids))
            return out

        return step

    return map_batches(with_bytes(df, text, keep, fields), make, fields, ("__bytes",))


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the raw bytes of packed ``ids``; null ids give no bytes."""
    ranks = _rank_bytes(df, rank_path)

    def make():
        coder = ByteBpe(ranks.value, pattern)
        return lambda batch: {
            "decoded": [
                coder.decode(np.frombuffer(raw or b"", dtype="<u4").tolist())
                for raw in batch.column(ids).to_pylist()
            ]
        }

    return map_batches(df, make, {"decoded": "binary"})


def digest(column: str) -> Column:
    return F.sha2(F.col(column), 256)
