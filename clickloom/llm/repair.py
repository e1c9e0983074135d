"""Conversation repair: the cheapest edits that give alternating turns, by integer weights.

A conversation is a path through a graph of places: before each row, in one of four
states (nothing yet, after the system row, after a user, after an assistant). Rows are
kept, given another role or deleted, empty rows may be inserted. The weight of a path is
one integer: its cost above, below it one octal digit for each edit's letter, from the
left, zeros to the end. The least integer is the least cost and, among equals, the
least letters, so one ordinary minimum decides both.

Long conversations are cut into chunks; a chunk gives its least paths from each state
to each, and chunks are joined in rounds, so no conversation has to fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import bounded_batches, stored
from clickloom.llm.ordered import numbered

START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
CHUNK = 256  # rows whose paths one call finds
FAN = 64  # chunks joined at once

_KEEP = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
# The role that must follow a state, if it is not a system row.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
_LETTERS = "DIKR"  # in ASCII order, digits 1 to 4
_DIGITS = str.maketrans(_LETTERS, "1234")
_BACK = str.maketrans("1234", _LETTERS)
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
# Letters after one row: itself and the inserts before it, which never come back to a state.
_MOST = 3


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if self.insert <= 0 or min(self.keep, self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("inserting must cost something, nothing less than zero")


class _Weights:
    """Adds edits to weights of ``digits`` letters at most."""

    def __init__(self, digits: int):
        self.digits = digits

    def plus(self, path: tuple[int, int], cost: int, letter: str) -> tuple[int, int]:
        value, length = path
        shift = 3 * (self.digits - 1 - length)
        digit = _LETTERS.index(letter) + 1
        return value + (cost << 3 * self.digits) + (digit << shift), length + 1

    def read(self, value: int) -> tuple[int, str]:
        """Cost and letters."""
        low = value & ((1 << 3 * self.digits) - 1)
        return value >> 3 * self.digits, octal(low, self.digits)


def octal(low: int, digits: int) -> str:
    return format(low, "o").zfill(digits).rstrip("0").translate(_BACK) if low else ""


def _least(into: dict, state: int, path: tuple[int, int]) -> None:
    if state not in into or path[0] < into[state][0]:
        into[state] = path


def _inserted(paths: dict, weights: _Weights, costs: Costs) -> dict:
    """Least paths after up to two inserted rows; more would come back to a state."""
    best, layer = dict(paths), paths
    for _ in range(_MOST - 1):
        following: dict = {}
        for state, path in layer.items():
            _least(following, _NEXT[state], weights.plus(path, costs.insert, "I"))
        for state, path in following.items():
            _least(best, state, path)
        layer = following
    return best


def chunk_paths(rows: list[tuple[str, int]], entry: int, costs: Costs) -> dict[int, tuple[int, str]]:
    """state -> (cost, letters) of the least path over (role initial, fault) rows."""
    weights = _Weights(_MOST * len(rows) + _MOST)
    paths: dict[int, tuple[int, int]] = {entry: (0, 0)}
    for initial, fault in rows:
        after: dict = {}
        extra = costs.truncated if fault == TRUNCATED else 0
        for state, path in _inserted(paths, weights, costs).items():
            _least(after, state, weights.plus(path, costs.delete, "D"))
            if fault in (BLANK, DUPLICATE):
                continue
            target = _KEEP.get(initial, {}).get(state)
            if target is not None:
                _least(after, target, weights.plus(path, costs.keep + extra, "K"))
            _least(after, _NEXT[state], weights.plus(path, costs.rerole + extra, "R"))
        paths = after
    return {state: weights.read(value) for state, (value, _) in paths.items()}


def _joined(first: dict, second: dict[int, dict]) -> dict[int, tuple[int, str]]:
    """Least paths through ``first`` and, from each of its ends, ``second``."""
    found: dict[int, tuple[int, str]] = {}
    longest = max(len(b) for e in first for _, b in second[e].values())
    digits = max(len(a) for _, a in first.values()) + longest
    best: dict[int, int] = {}
    for middle, (cost, letters) in first.items():
        head = (cost << 3 * digits) + (_number(letters) << 3 * (digits - len(letters)))
        for end, (more, rest) in second[middle].items():
            tail = _number(rest) << 3 * (digits - len(letters) - len(rest))
            value = head + (more << 3 * digits) + tail
            if end not in best or value < best[end]:
                best[end] = value
    weights = _Weights(digits)
    for end, value in best.items():
        found[end] = weights.read(value)
    return found


def _number(letters: str) -> int:
    return int(letters.translate(_DIGITS), 8) if letters else 0


def finished(paths: dict[int, tuple[int, str]], costs: Costs) -> tuple[int, str]:
    """Cost and letters of a whole conversation from its paths out of the first state."""
    digits = max(len(a) for _, a in paths.values()) + _MOST
    weights = _Weights(digits)
    ends = {
        state: ((cost << 3 * digits) + (_number(a) << 3 * (digits - len(a))), len(a))
        for state, (cost, a) in paths.items()
    }
    ends = _inserted(ends, weights, costs)
    return weights.read(min(ends[state][0] for state in ENDS if state in ends))


# What is known of a chunk, or of several joined: counts, edges, and paths by entry and end.
_PART = {
    "n": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
    "illegal": "bigint", "first": "string", "last": "string", "low": "bigint",
    "high": "bigint", "turns": "bigint", "costs": "array<bigint>", "audits": "array<string>",
}


def chunk_part(rows: list[tuple[int | None, str, int]], entries: Iterable[int], costs: Costs) -> dict:
    """The part of (turn, role initial, fault) rows; no rows give an empty part."""
    pairs = zip(rows, rows[1:], strict=False)
    turns = [t for t, _, _ in rows if t is not None]
    part = {
        "n": len(rows),
        "blank": sum(f == BLANK for _, _, f in rows),
        "duplicate": sum(f == DUPLICATE for _, _, f in rows),
        "truncated": sum(f == TRUNCATED for _, _, f in rows),
        "illegal": sum(a[1] + b[1] not in LEGAL for a, b in pairs),
        "first": rows[0][1] if rows else None,
        "last": rows[-1][1] if rows else None,
        "low": turns[0] if turns else None,
        "high": turns[-1] if turns else None,
        "turns": len(set(turns)),
    }
    short = [(i, f) for _, i, f in rows]
    paths = {e: chunk_paths(short, e, costs) for e in entries}
    return part | _flat(paths)


def _flat(paths: dict[int, dict]) -> dict:
    cells = [paths.get(a, {}).get(b, (None, None)) for a in range(4) for b in range(4)]
    return {"costs": [c for c, _ in cells], "audits": [a for _, a in cells]}


def _unflat(part: dict) -> dict[int, dict]:
    paths: dict[int, dict] = {e: {} for e in range(4)}
    for at, (cost, audit) in enumerate(zip(part["costs"], part["audits"], strict=True)):
        if cost is not None:
            paths[at // 4][at % 4] = (cost, audit)
    return paths


def join_parts(a: dict, b: dict) -> dict:
    """The part of two that follow each other."""
    both = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated")}
    both["illegal"] = a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in LEGAL)
    both["first"], both["last"] = a["first"], b["last"]
    both["low"] = a["low"] if a["low"] is not None else b["low"]
    both["high"] = b["high"] if b["high"] is not None else a["high"]
    same = a["high"] is not None and a["high"] == b["low"]
    both["turns"] = a["turns"] + b["turns"] - same
    second = _unflat(b)
    paths = {e: _joined(first, second) for e, first in _unflat(a).items() if first}
    return both | _flat(paths)


_TYPES = {
    "bigint": pa.int64(), "string": pa.string(),
    "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def _streamed(
    df: DataFrame, keys: tuple[str, ...], work, fields: dict[str, str], spread: tuple[str, ...]
) -> DataFrame:
    """``work(keys, rows)`` over groups of a sorted partition, a row at a time out of Arrow."""
    bounded_batches(df.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items())
    arrow = pa.schema([(n, _TYPES[t]) for n, t in fields.items()])
    names = [c for c in df.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in (*keys, *names)]
                yield from zip(*columns, strict=True)

        out: list[dict] = []
        width = len(keys)
        for key, group in groupby(rows(), key=lambda r: r[:width]):
            out.append(work(key, (r[width:] for r in group)))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*spread).sortWithinPartitions(*df.columns[: len(keys) + 1]).mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows after the damage that the CRC of ``conv_id:turn`` names.

    Columns: key (never null), conv_id, turn, role, text, ``copy`` (0, or 1 for the second
    of a repeated row) and ``alive`` (false for rows that were dropped). Nulls count as one
    space, in the CRC too; a null turn stays null for ordering.
    """
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    text = (
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    )
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("key"),
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (kind != 0).alias("alive"),
    )


def _fault(first: Column) -> Column:
    """The first fault of a row; ``first`` is the place of the first row equal to it."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    return (
        F.when(bare == "", F.lit(BLANK))
        .when(first < F.col("idx"), F.lit(DUPLICATE))
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), F.lit(TRUNCATED))
        .otherwise(F.lit(NO_FAULT))
    )


def repaired(rows: DataFrame, costs: Costs | None = None) -> DataFrame:
    """One row per conversation of key, conv_id, turn, role, text, copy, alive.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, the digest of the repaired ``role:text`` lines. Rows are ordered by
    turn (nulls first), then role and text, so the result does not depend on how they are
    stored; the copies of a row are adjacent. A null conv_id is a conversation of its own;
    one without rows alive has zeros, no edits and the digest of nothing. An empty table
    gives no rows; other columns are not read.

    The digest of a conversation is one running SHA-256, so its texts pass through one
    task in order, one batch at a time; all else is split whatever its size.
    """
    prices = costs or Costs()
    same = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    # dropped rows stay until the end, so that no conversation is lost
    order = [
        (~F.col("alive")).asc(),
        F.col("turn").asc_nulls_first(),
        F.col("role"),
        F.col("text"),
        F.col("copy"),
    ]
    placed = stored(numbered(rows.withColumn("same", same), "key", order))
    alive = placed.where("alive")
    repeats = (
        alive.groupBy("key", "same")
        .agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .drop("times")
    )
    judged = alive.join(repeats, ["key", "same"], "left").select(
        "key",
        F.expr(f"idx div {CHUNK}").alias("part"),
        "idx",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        _fault(F.col("first")).alias("fault"),
    )

    def chunk(key, group) -> dict:
        entries = (START,) if key[1] == 0 else range(4)
        part = chunk_part([r[1:] for r in group], entries, prices)
        return {"key": key[0], "part": key[1]} | part

    def join(key, group) -> dict:
        whole = None
        for row in group:
            part = dict(zip(_PART, row[1:], strict=True))
            whole = part if whole is None else join_parts(whole, part)
        return {"key": key[0], "part": key[1]} | whole

    def end(key, group) -> dict:
        ((_, *row),) = group
        part = dict(zip(_PART, row, strict=True))
        cost, audit = finished(_unflat(part)[START], prices)
        low, high = part["low"], part["high"]
        gaps = 0 if low is None else high - low + 1 - part["turns"]
        out = {n: part[n] for n in ("blank", "duplicate", "truncated", "illegal")}
        return {"key": key[0], "gaps": gaps, "cost": cost, "audit": audit} | out

    fields = {"key": "string", "part": "bigint"} | _PART
    parts = stored(_streamed(judged, ("key", "part"), chunk, fields, ("key", "part")))
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        grouped = parts.select(
            "key", F.expr(f"part div {FAN}").alias("whole"), "part", *_PART
        )
        named = {"key": "string", "part": "bigint"} | _PART
        parts = stored(_streamed(grouped, ("key", "whole"), join, named, ("key", "whole")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ended = {"key": "string"} | dict.fromkeys(counts, "bigint") | {"audit": "string"}
    summary = _streamed(parts, ("key",), end, ended, ("key",))
    return _digested(placed, summary, counts)


def _digested(placed: DataFrame, summary: DataFrame, counts: tuple[str, ...]) -> DataFrame:
    """The summaries with the digest of the repaired rows; the summary leads its rows."""
    none = F.lit(None)
    lines = placed.select(
        "key", "idx", "conv_id", F.when(F.col("alive"), F.col("role")).alias("role"), "text",
        none.cast("string").alias("audit"), *[none.cast("bigint").alias(c) for c in counts],
    )
    heads = summary.select(
        "key", F.lit(-1).cast("bigint").alias("idx"), none.cast("bigint").alias("conv_id"),
        none.cast("string").alias("role"), none.cast("string").alias("text"), "audit", *counts,
    )
    fields = {"conv_id": "bigint"} | dict.fromkeys(counts, "bigint")
    fields |= {"audit": "string", "repaired_sha256": "string"}

    def digest(_, group) -> dict:
        out = dict.fromkeys(counts, 0) | {"audit": "", "conv_id": None}
        edits = iter("")
        state, count, sha = START, 0, hashlib.sha256()

        def put(role: str, text: str) -> None:
            nonlocal count
            sha.update(f"{chr(10) if count else ''}{role}:{text}".encode())
            count += 1

        def inserts() -> str:
            """The next letter of a row, after the inserted rows before it."""
            nonlocal state
            for letter in edits:
                if letter != "I":
                    return letter
                state = _NEXT[state]
                put(ROLES[state], "")
            return ""

        for idx, conv_id, role, text, audit, *values in group:
            if idx < 0:
                out |= dict(zip(counts, values, strict=True)) | {"audit": audit}
                edits = iter(audit)
                continue
            out["conv_id"] = conv_id
            if role is None:
                continue
            letter = inserts()
            if letter == "K":
                state = _KEEP[role[:1]][state]
                put(role, text)
            elif letter == "R":
                state = _NEXT[state]
                put(ROLES[state], text)
        inserts()
        return out | {"repaired_sha256": sha.hexdigest()}

    both = lines.unionByName(heads)
    return _streamed(both, ("key",), digest, fields, ("key",))
