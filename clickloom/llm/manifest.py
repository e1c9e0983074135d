"""Merkle manifest of a dataset as append logs in postorder.

Each partition of the dataset (a tree) has its rows as leaves; eight consecutive nodes
become their parent, the last run may be shorter. Leaves are dealt in aligned blocks of
``BLOCK``: a builder takes one block and appends its nodes in the order in which they are
complete, a parent right after its last child. A block fills a segment of ``SEGMENT``
places of the log, and where a node stands in it follows from the sizes of the subtrees
before it, so proofs read siblings by their place. Block roots are the leaves of the next
tier, whose log is 4,681 times shorter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import UPPER, stored
from clickloom.llm.ordered import numbered

ARITY = 8
LEVELS = 4  # that one builder completes
BLOCK = ARITY**LEVELS
SEGMENT = sum(ARITY**k for k in range(LEVELS + 1))
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_LOG = (
    "tree string, block bigint, total bigint, position bigint, level int, digest string,"
    " top boolean"
)
_SPINE = "lefts array<string>, rights array<string>, subroot string, root string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tagged(column: Column) -> Column:
    """A value with its length in bytes, ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
    )


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[tagged(f) for f in fields]), 256)


def append_log(leaves: list[str], total: int) -> list[tuple[int, str]]:
    """(level, digest) of a block's nodes in the order of completion.

    ``total`` leaves are in the whole tree; if they fit one block it ends with their
    root, else every block climbs ``LEVELS`` levels, also a short last one.
    """
    log: list[tuple[int, str]] = []
    open_runs: list[list[str]] = [[] for _ in range(LEVELS + 1)]

    def append(level: int, digest: str) -> None:
        log.append((level, digest))
        open_runs[level].append(digest)
        if level < LEVELS and len(open_runs[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        append(level + 1, h(*run))

    for leaf in leaves:
        append(0, leaf)
    count = len(leaves)
    for level in range(LEVELS):
        if total <= BLOCK and count == 1:
            break
        if open_runs[level]:
            close(level)
        count = -(-count // ARITY)
    return log


def position(level: int, index: int, leaves: int) -> int:
    """Place in its segment of a block's node, from the sizes of the subtrees before it."""
    end = (index + 1) * ARITY**level
    if end <= leaves:  # complete: appended after leaf ``end``, above its ``level`` ancestors
        return sum((end - 1) // ARITY**k for k in range(LEVELS + 1)) + level
    complete = sum(leaves // ARITY**k for k in range(LEVELS + 1))
    return complete + sum(leaves % ARITY**k > 0 for k in range(1, level))


def local_steps(log: list[str], leaves: int, total: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block the siblings left and right of its path, level by level."""
    height, count, counts = 0, leaves, []
    while height < LEVELS and (total > BLOCK or count > 1):
        counts.append(count)
        count = -(-count // ARITY)
        height += 1
    known: list[dict[int, tuple[str, str]]] = [{} for _ in range(height)]
    for leaf in range(leaves):
        steps, index = [], leaf
        for level in range(height):
            if index not in known[level]:
                first = index - index % ARITY
                last = min(first + ARITY, counts[level])
                run = [log[position(level, i, leaves)] for i in range(first, last)]
                known[level] = {
                    i: ("".join(run[: i - first]), "".join(run[i - first + 1 :]))
                    for i in range(first, last)
                }
            steps.append(known[level][index])
            index //= ARITY
        yield steps


@dataclass(frozen=True)
class Manifest:
    """``leaves``: rows with tree, idx, total, leaf. ``logs``: one log a tier, lowest first.
    ``subroots``: (tree, subroot, idx, total) in tree order. ``top_logs``: the logs of the
    tree over the subroots. ``root``: one row with the root, none for an empty dataset."""

    leaves: DataFrame
    logs: list[DataFrame]
    subroots: DataFrame
    top_logs: list[DataFrame]
    root: DataFrame


def _logs(leaves: DataFrame) -> list[DataFrame]:
    """The logs of (tree, idx, total, digest); a tier more while some tree has several blocks."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        total, block = int(part["total"].iloc[0]), int(part["block"].iloc[0])
        log = append_log(part["digest"].tolist(), total)
        return pd.DataFrame(
            {
                "tree": part["tree"].iloc[0],
                "block": block,
                "total": total,
                "position": [block * SEGMENT + i for i in range(len(log))],
                "level": [level for level, _ in log],
                "digest": [digest for _, digest in log],
                "top": [i == len(log) - 1 for i in range(len(log))],
            }
        )

    logs = []
    while True:
        blocks = leaves.withColumn("block", F.expr(f"idx div {BLOCK}"))
        logs.append(stored(blocks.groupBy("tree", "block").applyInPandas(build, _LOG)))
        above = logs[-1].where(f"top and total > {BLOCK}")
        if above.isEmpty():
            return logs
        leaves = above.select(
            "tree",
            F.col("block").alias("idx"),
            F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"),
            "digest",
        )


def _roots(logs: list[DataFrame]) -> DataFrame:
    found = None
    for log in logs:
        part = log.where(f"top and total <= {BLOCK}").select("tree", "digest")
        found = part if found is None else found.unionByName(part)
    return found


def build(
    df: DataFrame,
    tree: Column,
    order: list[Column],
    fields: list[Column],
    carry: dict[str, Column] | None = None,
) -> Manifest:
    """The manifest of the rows of ``df``: a tree for every value of ``tree``.

    Null is a tree of its own, before all others; trees are ordered by their UTF-8 bytes.
    Leaves follow ``order``, rows equal in it their digest, so the result does not depend
    on how rows are stored; repeated rows are leaves of their own. ``fields`` go into a
    leaf, null as ``-``; ``carry`` are columns to keep beside the leaves. Only these
    expressions are read, so further columns and their names do not matter. An empty
    table has empty logs and no root.
    """
    name = F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-"))  # '-' < '='
    ordering = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    rows = df.select(
        name.alias("tree"),
        leaf_digest(fields).alias("leaf"),
        *ordering,
        *[c.alias(n) for n, c in (carry or {}).items()],
    )
    keys = [F.col(f"__o{i}").asc_nulls_first() for i in range(len(order))]
    leaves = numbered(rows, "tree", [*keys, F.col("leaf")])
    leaves = leaves.drop(*[f"__o{i}" for i in range(len(order))])
    logs = _logs(leaves.select("tree", "idx", "total", F.col("leaf").alias("digest")))
    roots = _roots(logs).select(
        F.lit("").alias("all"), F.col("tree").alias("name"), F.col("digest").alias("subroot")
    )
    subroots = numbered(roots, "all", [F.col("name")])
    top_logs = _logs(subroots.select(F.col("all").alias("tree"), "idx", "total", F.col("subroot").alias("digest")))
    root = _roots(top_logs).select(F.col("digest").alias("root"))
    named = subroots.select(F.col("name").alias("tree"), "subroot", "idx", "total")
    return Manifest(leaves, logs, named, top_logs, root)


def _block_leaves(spines: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of a tier, the spine of a block on its first row only."""
    blocks = rows.withColumn("block", F.expr(f"idx div {BLOCK}"))
    first = spines.withColumn("idx", F.col("block") * BLOCK).drop("block")
    return blocks.join(first, ["tree", "idx"], "left")


def _block_paths(log: pd.DataFrame, rows: pd.DataFrame):
    """(row, steps up to the root, subroot, root) of every leaf of a block."""
    log = log.sort_values("position")
    rows = rows.sort_values("idx")
    head = rows.iloc[0]
    spine = list(zip(head["lefts"], head["rights"], strict=True))
    digests = log["digest"].tolist()
    paths = local_steps(digests, len(rows), int(log["total"].iloc[0]))
    for row, steps in zip(rows.itertuples(index=False), paths, strict=True):
        yield row, [*steps, *spine], head["subroot"], head["root"]


def _spines(logs: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Spines of the lowest tier's blocks: what lies beside the path from a block to the root.

    ``roots`` holds (tree, lefts, rights, subroot, root) of every tree.
    """

    def descend(key, log: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [
            (key[0], row.idx, [a for a, _ in steps], [b for _, b in steps], subroot, root)
            for row, steps, subroot, root in _block_paths(log, rows)
        ]
        return pd.DataFrame(out, columns=["tree", "block", "lefts", "rights", "subroot", "root"])

    found = None
    for tier in range(len(logs) - 1, -1, -1):
        ends = logs[tier].where(f"top and total <= {BLOCK}").select("tree", "block")
        ended = ends.join(roots, "tree")
        spines = ended if found is None else ended.unionByName(found)
        if tier == 0:
            return spines
        below = logs[tier - 1].where(f"top and total > {BLOCK}")
        leaves = below.select("tree", F.col("block").alias("idx"))
        found = stored(
            logs[tier]
            .groupBy("tree", "block")
            .cogroup(_block_leaves(spines, leaves).groupBy("tree", "block"))
            .applyInPandas(descend, f"tree string, block bigint, {_SPINE}")
        )
    raise AssertionError("no tier")


def proofs(manifest: Manifest, given: str = "leaf", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every leaf with its proof, and the root recomputed from the digest in ``given``.

    Columns: those in ``carry``, leaf, subroot, root, ``proof_sha256`` (digest of all
    siblings, from the leaf up, each level from left to right) and ``folded_root``
    (``given`` folded with the original siblings; equal to root if nothing changed).
    Siblings are read from the log segment of the leaf's block, those above the block
    from its spine; a task holds one block of 4,096 leaves at a time.
    """
    kinds = dict(manifest.leaves.dtypes)
    results = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    end = "lefts array<string>, rights array<string>, subroot string, root string"

    def above(key, log: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [
            (row.name, [a for a, _ in steps], [b for _, b in steps], row.leaf, root)
            for row, steps, _, root in _block_paths(log, rows)
        ]
        return pd.DataFrame(out, columns=["tree", "lefts", "rights", "subroot", "root"])

    def prove(key, log: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, steps, subroot, root in _block_paths(log, rows):
            node = getattr(row, given)
            for left, right in steps:
                node = h(left, node, right)
            proof = h(*[part for pair in steps for part in pair])
            out.append(
                (*[getattr(row, c) for c in carry], row.leaf, subroot, root, proof, node)
            )
        return pd.DataFrame(out, columns=[*carry, *results])

    # the tree over the subroots first: its leaves are the roots of the trees
    no_siblings = F.array().cast("array<string>")
    one = manifest.root.select(
        F.lit("").alias("tree"),
        no_siblings.alias("lefts"),
        no_siblings.alias("rights"),
        F.lit(None).cast("string").alias("subroot"),
        "root",
    )
    names = manifest.subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), "idx", F.col("subroot").alias("leaf")
    )
    tops = _block_leaves(_spines(manifest.top_logs, one), names)
    roots = stored(
        manifest.top_logs[0]
        .groupBy("tree", "block")
        .cogroup(tops.groupBy("tree", "block"))
        .applyInPandas(above, f"tree string, {end}")
    )
    # as text, since pandas has no whole numbers beside nulls
    texts = [F.col(c).cast("string").alias(c) for c in carry]
    wanted = [c for c in dict.fromkeys(["tree", "idx", "leaf", given]) if c not in carry]
    rows = _block_leaves(
        _spines(manifest.logs, roots), manifest.leaves.select(*wanted, *texts)
    )
    proved = (
        manifest.logs[0]
        .groupBy("tree", "block")
        .cogroup(rows.groupBy("tree", "block"))
        .applyInPandas(prove, ", ".join(f"`{c}` string" for c in (*carry, *results)))
    )
    return proved.withColumns({c: F.col(c).cast(kinds[c]) for c in carry})


def verified_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and each one's proof checked against tampered text.

    A tree for every language, leaves by doc_id. Where 3 divides the CRC of the decimal
    doc_id, the text that is checked has A-Z lower-cased; rows without a doc_id are not
    tampered. Nulls are leaves like others, null languages a tree of their own.
    """
    columns = {c: F.col(c) for c in FIELDS}
    lowered = F.translate(columns["text"], UPPER, UPPER.lower())
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = hit & (lowered != columns["text"])
    tampered = F.when(changed, leaf_digest([*[columns[c] for c in FIELDS[:-1]], lowered]))
    manifest = build(
        docs,
        F.col("lang"),
        [F.col("doc_id")],
        list(columns.values()),
        {"doc_id": F.col("doc_id"), "tampered": tampered},
    )
    manifest = Manifest(
        manifest.leaves.withColumn("given", F.coalesce("tampered", "leaf")),
        manifest.logs,
        manifest.subroots,
        manifest.top_logs,
        manifest.root,
    )
    found = proofs(manifest, "given", ("doc_id",))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
