"""Chat formatting: reply trees to conversations, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import stored

START = "<|im_start|>"
END = "<|im_end|>\n"

# Control strings of this template and of common others. In texts and roles one
# backslash more is put after their first character, and taken away on reading.
_TAIL = r"(\||/?s>|/?INST\]|<SYS>>|</?SYS>>)"
_ESCAPE = (rf"([<\[])(\\*){_TAIL}", r"$1\\$2$3")
_UNESCAPE = (rf"([<\[])\\(\\*){_TAIL}", r"$1$2$3")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *_ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *_UNESCAPE)


def _role_out(role: Column) -> Column:
    """A role stands on one line, so its line breaks are written as %0A."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def reply_nodes(conversations: DataFrame) -> DataFrame:
    """Turns of linear conversations as a reply tree: each turn answers the one before.

    Columns ``tree``, ``node``, ``parent``, ``role``, ``text``, ``score``; nodes are
    numbered by turn, ties by role and text, repeated rows after one another.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        F.col("conv_id").alias("tree"),
        F.row_number().over(order).cast("bigint").alias("node"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(0.0).alias("score"),
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def chosen_paths(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, node, depth, path_rank) of the best root-to-leaf paths of each tree.

    Paths grow by self-joins: in round k every node knows its ancestor 2^k steps up and
    the score and length of the way there, so the number of rounds is the logarithm of the
    greatest depth. A path's score is the mean of its nodes' (null counts as 0); ties go to the longer
    path, then to the smaller leaf. ``per_tree`` paths are kept, or all if None. Chosen
    leaves then climb by the same jumps, the longest first, which doubles the part of
    the path found in each round. Each round is written to the shared folder.

    A parent missing from the tree makes its node a root. Nodes on a cycle have no
    root and so are on no path; they are not returned. Node ids must be unique within
    a tree.
    """
    ids = nodes.select(
        F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("t"),
        F.col("tree").isNull().alias("t_null"),
        "tree",
        "node",
        "parent",
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    key = ["t", "t_null"]
    known = ids.select(*key, F.col("node").alias("parent"), F.col("node").alias("up"))
    first = ids.join(known, [*key, "parent"], "left").select(
        *key, "tree", "node", "up", F.lit(1).cast("bigint").alias("steps"), "score"
    )
    now = start = stored(first)
    done, jumps = [], []
    count = nodes.count()
    while True:
        open_ = now.where("up is not null")
        done.append(now.where("up is null"))
        if 1 << len(jumps) > count or open_.isEmpty():
            break
        jumps.append(open_)
        above = _union([*done, open_]).select(
            *key,
            F.col("node").alias("up"),
            F.col("up").alias("next_up"),
            F.col("steps").alias("more"),
            F.col("score").alias("above"),
        )
        # nodes whose root is found are not joined any more
        now = stored(
            open_.join(above, [*key, "up"]).select(
                *key,
                "tree",
                "node",
                F.col("next_up").alias("up"),
                (F.col("steps") + F.col("more")).alias("steps"),
                (F.col("score") + F.col("above")).alias("score"),
            )
        )
    rooted = _union(done)  # steps: nodes on the way from the root
    parents = start.where("up is not null").select(*key, F.col("up").alias("node")).distinct()
    leaves = rooted.join(parents, [*key, "node"], "left_anti").withColumn(
        "path_score", F.col("score") / F.col("steps")
    )
    rank = F.row_number().over(
        Window.partitionBy(*key).orderBy(F.desc("path_score"), F.desc("steps"), "node")
    )
    leaves = leaves.withColumn("path_rank", rank.cast("bigint"))
    if per_tree is not None:
        leaves = leaves.where(F.col("path_rank") <= per_tree)
    path = leaves.select(
        *key, "tree", F.col("node").alias("leaf"), "node", F.col("steps").alias("depth"), "path_rank"
    )
    for level in reversed(range(len(jumps))):
        # by now the nodes 2^(level+1), 2 * 2^(level+1), ... steps above the leaf are found
        jump = jumps[level].select(*key, "node", "up")
        higher = path.join(jump, [*key, "node"]).select(
            *key,
            "tree",
            "leaf",
            F.col("up").alias("node"),
            (F.col("depth") - F.lit(1 << level)).alias("depth"),
            "path_rank",
        )
        path = stored(path.unionByName(higher))
    return path.select("tree", "leaf", "node", "depth", "path_rank")


def format_paths(nodes: DataFrame, paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: ``formatted``, and ``segments`` that join to it.

    A turn is written as start mark, role, line break, text, end mark. A segment is a
    piece of the formatted string and whether the loss covers it: true for the texts of
    role ``learn`` alone, without marks. ``loss_spans`` gives the same as (start,
    length) in code points. Null roles and texts count as empty.
    """
    turn = (
        paths.alias("p")
        .join(
            nodes.alias("n"),
            F.col("p.tree").eqNullSafe(F.col("n.tree")) & (F.col("p.node") == F.col("n.node")),
        )
        .select("p.tree", "p.leaf", "p.path_rank", "p.depth", "n.role", "n.text")
    )
    turn = turn.select(
        "tree",
        "leaf",
        "path_rank",
        "depth",
        F.concat(F.lit(START), _role_out(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        escaped(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.col("role") == learn, F.lit(False)).alias("loss"),
    )
    path = ("tree", "leaf", "path_rank")
    before = Window.partitionBy(*path).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + len(END)
    turn = turn.withColumn(
        "start",
        F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head"),
    )
    turn = turn.select(*path, F.struct("depth", "start", "head", "body", "loss").alias("turn"))
    grouped = turn.groupBy(*path).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    spans = F.transform(
        F.filter("turns", lambda t: t["loss"]),
        lambda t: F.struct(
            t["start"].alias("start"), F.char_length(t["body"]).cast("bigint").alias("length")
        ),
    )
    out = grouped.select(*path, pieces.alias("segments"), spans.alias("loss_spans"))
    return out.withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) got back from a formatted string."""
    raw = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda t: t != "")
    return F.transform(
        raw,
        lambda t: F.struct(
            _role_in(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(t, F.char_length(F.substring_index(t, "\n", 1)) + 2)).alias("text"),
        ),
    )


def masked_text(segments: str) -> Column:
    """All text under the loss mask, unescaped."""
    covered = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return F.array_join(covered, "")
