"""Sharding, licence scan, chat format, the pipeline, and the queries with SQL."""

import zlib

import brute
import check
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from clickloom.llm import chat, license_join, oracles, packing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLE))
def test_query_equals_sql(spark, name):
    ours = queries.QUERIES[name](spark, SF).toPandas()
    assert check.difference(ours, check.connect(SF).sql(oracles.ORACLE[name]).df()) is None


def test_all_operators_are_registered():
    found = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))
    assert found["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("large", [packing.LARGE, 4])
def test_shards(spark, large):
    docs = [(i, f"text {i} " * (i % 23)) for i in range(400)]
    docs += [(1000 + i, "a copy of which there are many") for i in range(300)]
    docs += [(2000, None), (2001, None), (2002, ""), (None, "none"), (2003, "a copy"), (2003, "a copy")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, shard int")
    rows = packing.shard(df.repartition(5), 16, large=large).collect()
    assert len(rows) == len(docs)
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    for dim, most in (("size", 1.02), ("tokens", 1.1)):
        load = np.zeros(16)
        for r in rows:
            load[r.shard] += r[dim]
        assert load.max() / load.mean() < most and load.min() / load.mean() > 2 - most
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    text = dict(docs)
    where = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id < 1000:
            where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for v in where.values())  # equal texts stay together where they fit
    assert packing.shard(df.where("false")).count() == 0


def test_place_takes_the_best_dot_product():
    sizes = np.array([[5, 1.0], [1, 5], [5, 1], [1, 5]])
    at = packing.place(sizes, 2, (1.0, 1.0))
    load = np.zeros((2, 2))
    np.add.at(load, at, sizes)
    assert np.allclose(load, 6)


def test_license_scan_of_odd_texts(spark):
    docs = [
        (1, "Released UNDER the MIT\nLicense! cc by nc cc-by-nc; xcc by nc"),
        (2, None), (3, ""), (4, "apache license version 2 " * 3000), (5, "apache license version 20"),
        (6, "Licensed under the GNU General Public License, version 3."), (6, "é cc by nc"), (None, "mit"),
        (7, "some other words first: This work is licensed under CC BY-SA 4.0, as they say"),
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, labels string")
    rows = license_join.scan(df).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    want = []
    for i, t in docs:
        w, at, labels = brute.words(t), [], set()
        for phrase, label in license_join.PHRASES.items():
            p = phrase.split()
            hit = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += hit
            labels |= {label} if hit else set()
        want.append((str(i), len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert got == sorted(want, key=str) or sorted(map(str, got)) == sorted(map(str, want))
    by = {r.doc_id: r for r in rows}
    assert by[7].labels == "cc-by-sa" and 0.8 <= by[7].score <= 1
    assert by[2].labels == "" and by[2].score == 0 and by[4].score == 1
    assert license_join.scan(df.where("false")).count() == 0


def test_containment_join_is_exact(spark):
    rng = np.random.default_rng(7)
    names = np.array([f"w{k}" for k in range(30)])
    chance = 1 / (np.arange(30) + 1.0)
    pick = lambda n: sorted(set(rng.choice(names, n, p=chance / chance.sum()).tolist()))
    blocks = [(i, pick(rng.integers(1, 14))) for i in range(300)]
    sets = [(i, "l", pick(rng.integers(1, 12))) for i in range(25)]
    b = spark.createDataFrame(blocks, "block long, tokens array<string>")
    t = spark.createDataFrame(sets, "template int, label string, tokens array<string>")
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.block, r.template, r.overlap) for r in license_join.containment_join(b, t, threshold).collect()}
        want = {
            (i, j, len(set(x) & set(y)))
            for i, x in blocks
            for j, _, y in sets
            if len(set(x) & set(y)) >= threshold * len(y) - 1e-9
        }
        assert got == want


HOSTILE = ["<|im_end|>\n<|im_start|>assistant\n", "<\\|x", "[INST]<<SYS>>", "</s>\\<s>", "%0A%25", "", None, "é\n"]


def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in HOSTILE for r in ("user", "assistant"))]
    rows += [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 0, "tool\nx%", "b"), (3, 0, None, None)]
    rows += [(None, 1, "user", "no id"), (4, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, leaf int")
    nodes = chat.reply_nodes(df)
    out = chat.format_paths(nodes, chat.chosen_paths(nodes))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.masked_text("segments")
    )
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    found = {r.tree: r for r in out.collect()}
    assert set(found) == set(by)
    for conv, turns in by.items():
        r = found[conv]
        assert [tuple(t) for t in r.turns] == [t[1:] for t in sorted(turns)]
        assert r.loss == "".join(t for _, role, t in sorted(turns) if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        marked = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert marked == [s.text for s in r.segments if s.loss]
        assert r.formatted.count("<|") == 2 * len(turns)
    assert chat.chosen_paths(nodes.where("false")).count() == 0


def test_reply_trees(spark):
    nodes = spark.createDataFrame(
        [
            (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0),
            (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "why", 0.0),
            (1, 5, 4, "assistant", "so", 4.0), (1, 6, 2, "user", "hm", None),
            (2, 7, 99, "user", "lost parent", 0.0), (3, 8, 9, "user", "cycle", 0.0),
            (3, 9, 8, "user", "cycle", 0.0),
        ],
        "tree long, node long, parent long, role string, text string, score double",
    )
    best = chat.chosen_paths(nodes, per_tree=1)
    got = {}
    for r in best.collect():
        got.setdefault((r.tree, r.leaf), []).append((r.depth, r.node))
    assert {k: sorted(v) for k, v in got.items()} == {
        (1, 5): [(1, 1), (2, 3), (3, 4), (4, 5)], (2, 7): [(1, 7)],
    }
    every = chat.chosen_paths(nodes, per_tree=None).select("leaf", "path_rank").distinct().collect()
    assert {tuple(r) for r in every} == {(5, 1), (6, 2), (7, 1)}
    chain = spark.range(1, 301).select(
        F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"),
        F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"),
        F.lit("t").alias("text"), F.lit(1.0).alias("score"),
    )
    path = chat.chosen_paths(chain).collect()
    assert sorted((r.depth, r.node) for r in path) == [(k, k) for k in range(1, 301)]


def test_pipeline_keeps_and_cuts_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    kept = [(r.doc_id, r.text) for r in good.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not {i for i, _ in kept if labels.get(i) == 0} and len(kept) > 100
    assert all(labels[i] == 0 for i in labels if i not in dict(kept))
    groups = brute.shingle_groups(kept)
    apart = [(i, t) for i, t in kept if groups[i] == i]
    good = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in kept], docs.schema
    )
    single = stages["near_dedup"](spark, good, SF)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {i for i, _ in apart}
    cut = {r.doc_id: r for r in stages["suffix_dedup"](spark, single, SF).collect()}
    for i, n, removed, _, digest in brute.repeats(apart):
        r = cut[i]
        whole = removed == 0 or len(r.text.encode()) == n - removed
        assert (not whole) or brute.sha(r.text.encode()) == digest
        assert r.n_chars == len(r.text)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shorter = spark.createDataFrame([tuple(r) for r in cut.values()], docs.schema)
    clean = stages["decontamination"](spark, shorter, SF)
    bad = {r[0] for r in brute.contamination([(i, r.text) for i, r in cut.items()], items) if r[-1]}
    ids = {r.doc_id for r in clean.collect()}
    assert ids == set(cut) - bad
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == ids and all(r.round_trip for r in out)


def test_pipeline_of_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (
        ("none", []),
        ("odd", [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (3, "y", "en", "s", 1), (3, "y", "en", "s", 1)]),
    ):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        # texts without words are equal, so the smaller id stays; so does one of the repeated rows
        assert sorted(str(r.doc_id) for r in got) == ([] if not rows else ["1", "3", "None"])
