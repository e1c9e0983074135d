"""License scan: phrases, and an exact set-similarity join with templates, in SQL functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import sql_words, stored

PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The licences' own notices. A template is the set of a notice's words.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)
THRESHOLD = 0.8
# A block is 2 * STRIDE words from every STRIDE-th word on, so any STRIDE + 1 words that follow
# each other, wherever lines break, lie in one block. No notice above is longer.
STRIDE = 24


def templates(df: DataFrame, rows=TEMPLATES) -> DataFrame:
    """(template, label, tokens): the words of each notice, each once."""
    frame = df.sparkSession.createDataFrame(
        [(i, label, text) for i, (label, text) in enumerate(rows)],
        "template int, label string, notice string",
    )
    tokens = F.array_distinct(F.split(sql_words(F.col("notice")), " "))
    return frame.select("template", "label", tokens.alias("tokens"))


def phrase_columns(words: str, phrases: dict[str, str]) -> dict[str, Column]:
    """Counts and places of phrases in a column of words joined by single blanks."""
    # every word between blanks of its own, so neighbouring places share no character
    padded = F.concat(F.lit(" "), F.replace(F.col(words), F.lit(" "), F.lit("  ")), F.lit(" "))
    n_words = F.when(F.col(words) == "", 0).otherwise(
        F.char_length(words) - F.char_length(F.replace(F.col(words), F.lit(" "), F.lit(""))) + 1
    )
    blanks = lambda c: (F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))) / 2
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        form = "".join(f" {w} " for w in phrase.split())
        has = F.contains(F.col(words), F.lit(phrase)) & F.contains(padded, F.lit(form))
        cut = F.char_length(F.replace(padded, F.lit(form), F.lit("")))
        counts.append(F.when(has, (F.char_length(padded) - cut) / len(form)).otherwise(0))
        firsts.append(F.when(has, blanks(F.substring_index(padded, form, 1))))
        after = blanks(F.substring_index(padded, form, -1))
        lasts.append(F.when(has, n_words - after - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    several = len(phrases) > 1
    return {
        "n_words": n_words.cast("bigint"),
        "n_base": sum(counts[1:], counts[0]).cast("bigint"),
        "first_word": (F.least(*firsts) if several else firsts[0]).cast("bigint"),
        "last_word": (F.greatest(*lasts) if several else lasts[0]).cast("bigint"),
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def _ordered(tokens: DataFrame, key: list[str], order: DataFrame) -> DataFrame:
    """Tokens of each set numbered from 1, the rarest in the corpus first."""
    by = Window.partitionBy(*key).orderBy("df", "token")
    return tokens.join(order, "token").withColumn("pos", F.row_number().over(by))


def containment_join(
    blocks: DataFrame, templates: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """(block, template, overlap, containment) of all pairs that reach the threshold.

    ``blocks`` has ``block`` and ``tokens``, ``templates`` has ``template`` and
    ``tokens`` (sets of words, all of them words of some template). A template of t words
    is contained if at least ``need = ceil(threshold * t)`` of its words are in the block.

    Words are ordered by their frequency among all blocks, rarest first. Two sets with
    ``need`` words in common meet in the first ``size - need + 1`` of either (prefix filter);
    a block has ``need`` words at least (length filter); and where two words meet at
    places i and j, what follows must still allow ``need`` (positional filter). Pairs
    left are counted over all their words. A frequent word is in few prefixes, so the
    join has no crowded key; counting pairs is an aggregation.
    """
    b_tokens = blocks.select("block", F.size("tokens").alias("b_size"), F.explode("tokens").alias("token"))
    t_tokens = templates.select(
        "template",
        F.size("tokens").alias("t_size"),
        F.ceil(F.size("tokens") * threshold - 1e-9).alias("need"),
        F.explode("tokens").alias("token"),
    )
    order = (
        b_tokens.select("token")
        .unionByName(t_tokens.select("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    b_sets = stored(_ordered(b_tokens, ["block"], order))
    t_sets = stored(_ordered(t_tokens, ["template"], order))
    least = F.lit(templates.agg(F.min(F.ceil(F.size("tokens") * threshold - 1e-9))).first()[0] or 1)
    prefix = b_sets.where(F.col("pos") <= F.col("b_size") - least + 1)
    t_prefix = t_sets.where(F.col("pos") <= F.col("t_size") - F.col("need") + 1)
    pairs = (
        prefix.alias("b")
        .join(t_prefix.alias("t"), "token")
        .where("b.b_size >= t.need")
        .where("b.pos <= b.b_size - t.need + 1")
        .where("1 + least(b.b_size - b.pos, t.t_size - t.pos) + least(b.pos, t.pos) - 1 >= t.need")
        .select("block", "template")
        .distinct()
    )
    full = (
        pairs.join(b_sets.select("block", "token"), "block")
        .join(t_sets.select("template", "token", "t_size", "need"), ["template", "token"])
        .groupBy("block", "template", "t_size", "need")
        .agg(F.count(F.lit(1)).alias("overlap"))
        .where("overlap >= need")
    )
    return full.select(
        "block", "template", "overlap", (F.col("overlap") / F.col("t_size")).alias("containment")
    )


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices=TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: phrase places, labels and score.

    A text block is a run of 2 * ``STRIDE`` words from every ``STRIDE``-th word of the text on:
    line breaks do not matter, and a notice lies whole in some block. A block is labelled
    by every template it contains, except where a closer one (by share and then by words)
    explains the same words; ties all count. The score is the best containment found, 1
    where a phrase stands.

    The texts are passed over once and cut down to the places of words that some template
    has. A block that contains a template holds one of its rarest words (rarest in the
    corpus), so only blocks around such words are put together and joined. Words are dealt
    by document and block, so a text of any length is spread.

    Null and empty texts have no words, null places and no labels. Rows with the same
    id, or none, stay separate. An empty table gives no rows. Only the named columns are read.
    """
    sets = templates(docs, notices)
    of_template = [set(r.tokens) for r in sets.select("tokens").collect()]  # of the notices
    known = sorted(set().union(*of_template))
    need = [math.ceil(threshold * len(t) - 1e-9) for t in of_template]
    # the words go through ``explode``: as a plain column the split would run for every word
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.explode(F.array(sql_words(F.col(text)))).alias("words"),
    ).select("*", F.explode(F.array(F.split("words", " "))).alias("list"))
    columns = phrase_columns("words", phrases)
    places = F.filter(
        F.sequence(F.lit(0), F.size("list") - 1), lambda i: F.get("list", i).isin(*known)
    )
    held = F.transform(places, lambda i: F.struct(i.alias("at"), F.get("list", i).alias("token")))
    base = stored(
        texts.select("row", "doc_id", held.alias("held"), *[c.alias(n) for n, c in columns.items()])
    )
    seen = {
        r.token: r["count"]
        for r in base.select(F.explode("held.token").alias("token")).groupBy("token").count().collect()
    }  # one row a word of the notices
    rare = set()
    for words, least in zip(of_template, need, strict=True):
        rare |= set(sorted(words, key=lambda w: (seen.get(w, 0), w))[: len(words) - least + 1])
    some = base.where(F.exists("held.token", lambda t: t.isin(*sorted(rare))))
    number = F.expr(f"word.at div {STRIDE}")
    tokens = (
        some.select("row", F.explode("held").alias("word"))
        .select("row", "word.token", F.explode(F.array(number, number - 1)).alias("place"))
        .where("place >= 0")
    )
    around = tokens.where(F.col("token").isin(*sorted(rare))).select("row", "place").distinct()
    blocks = stored(
        tokens.join(around, ["row", "place"], "left_semi")
        .groupBy("row", "place")
        .agg(F.array_sort(F.collect_set("token")).alias("tokens"))
        .where(F.size("tokens") >= min(need, default=1))
        .select("row", F.struct("row", "place").alias("block"), "tokens")
    )
    hits = (
        containment_join(blocks, sets, threshold)
        .join(blocks.select("block", F.col("tokens").alias("held")), "block")
        .join(sets, "template")
        .select("block", "label", "containment", "overlap", F.array_intersect("held", "tokens").alias("matched"))
    )
    # a notice can hold most of a similar one: of those that the same words explain, the closest
    # stays; other notices in the block stay too. A block has a hit a template at most.
    of_block = hits.groupBy("block").agg(
        F.collect_list(F.struct("containment", "overlap", "label", "matched")).alias("all")
    )
    closer = lambda a, b: (a["containment"] > b["containment"]) | (
        (a["containment"] == b["containment"]) & (a["overlap"] > b["overlap"])
    )
    explained = lambda h: F.exists(
        "all", lambda o: closer(o, h) & (F.size(F.array_except(h["matched"], o["matched"])) == 0)
    )
    left = of_block.select("block", F.explode(F.filter("all", lambda h: ~explained(h))).alias("hit"))
    per_doc = (
        left.groupBy(F.col("block.row").alias("row"))
        .agg(F.collect_set("hit.label").alias("found"), F.max("hit.containment").alias("best"))
    )
    labels = F.array_sort(
        F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))
    )
    return base.join(per_doc, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0))
        .otherwise(F.coalesce("best", F.lit(0.0)))
        .alias("score"),
    )
