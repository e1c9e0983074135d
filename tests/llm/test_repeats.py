"""Suffix-array dedup and SimHash near-dedup against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import simhash, suffix_dedup
from clickloom.llm.common import components

SF = "/root/testdata/sf0.001"


def _result(df):
    cut = df.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)
    )
    return sorted(map(tuple, cut.collect()), key=str)


def _texts(seed=1):
    """Texts that share passages at many places and lengths."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(r.randint(9, 60)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [prose(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            at = r.randrange(len(p) // 2)
            parts += [p[at:] if r.random() < 0.5 else p, prose(r.randint(0, 12))]
        docs.append((1000 - i if i % 3 else i, "".join(parts)))
    docs += [(5, docs[7][1]), (700, docs[7][1]), (700, docs[7][1]), (1, None), (2, ""), (3, "x")]
    docs += [(None, docs[9][1]), (None, docs[9][1]), (4, "ab" * 3000), (6, "ab" * 40), (8, "é" * 900)]
    docs += [(9, passages[0][:49]), (10, passages[0][:50]), (11, "q" + passages[0][3:53])]
    return docs


@pytest.mark.parametrize("crowd", [None, 1])
def test_repeated_passages(spark, crowd):
    docs = _texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = suffix_dedup.deduplicated(df, crowd=crowd)
    assert _result(found) == sorted(brute.repeats(docs), key=str)


def test_repeated_passages_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert _result(suffix_dedup.deduplicated(df, keep=("doc_id",))) == sorted(
        brute.repeats(docs), key=str
    )


def test_dedup_of_nothing_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept int, spans int, id int")
    out = suffix_dedup.deduplicated(empty)
    assert out.count() == 0 and out.columns == [
        "doc_id", "text", "id", "n_bytes", "n_removed", "spans", "kept",
    ]
    text = "gréen " * 30
    df = spark.createDataFrame(
        [(1, text, 7, 7, 7), (2, text + "é", 7, 7, 7)],
        "doc_id long, text string, kept int, content int, at int",
    )
    rows = {r.doc_id: r for r in suffix_dedup.deduplicated(df, as_text=True).collect()}
    assert rows[1].kept == text and rows[1].content == 7
    assert rows[2].kept == "é" and rows[2].n_removed == len(text.encode())


def test_suffix_sort_orders_and_keeps_ties():
    data = np.frombuffer(b"banana bandana banana", np.uint8)
    text = suffix_dedup.Prefixes(data)
    places = np.arange(len(data) - 5)
    bounds = np.array([0, 4, len(places)])
    order = suffix_dedup.sort_suffixes(text, places, bounds, 6)
    raw = data.tobytes()
    assert order.tolist() == [
        *sorted(range(4), key=lambda k: raw[k : k + 6]),
        *sorted(range(4, len(places)), key=lambda k: raw[k : k + 6]),
    ]


def test_every_window_has_a_sample_in_it():
    texts = [bytes(random.Random(s).choices(b"abc ", k=300 + s)) for s in range(4)] + [b"a" * 200]
    for i, text in enumerate(texts):
        seen = []
        for who, q0, q1, place, _ in suffix_dedup.sample_runs(texts):
            for w, a, b, p in zip(who, q0, q1, place, strict=True):
                if w == i:
                    assert a <= b <= p and p + 20 <= a + 50
                    seen += range(a, b + 1)
        assert seen == list(range(len(text) - 49))


def test_golay_keys_meet_within_two_bits():
    r = np.random.default_rng(3)
    words = r.integers(0, 1 << 23, 300)
    rows, index = simhash.codeword_indices(words)
    sizes = np.bincount(rows)
    assert set(sizes.tolist()) <= {1, 6}
    fps = r.integers(0, 1 << 63, 200).astype(np.int64)
    keys = lambda f: set(simhash.fuzzy_keys(np.array([f], np.int64))[1].tolist())
    for fp in fps.tolist():
        a, b = r.choice(64, 2, replace=False)
        other = np.array([fp], np.int64).view(np.uint64) ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b))
        assert keys(fp) & keys(int(other.view(np.int64)[0]))


def _fingerprints(n=400):
    """Clusters of words a few bits apart, some of them crowded."""
    r = random.Random(5)
    out = []
    for size in (150, 60, 30, 8, 8, 3, 3):
        word = r.getrandbits(64)
        for _ in range(size):
            out.append(word ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 2))) & (2**64 - 1))
            if r.random() < 0.2:
                word ^= 1 << r.randrange(64)
    return list(dict.fromkeys(out + [r.getrandbits(64) for _ in range(n - len(out))] + [0, 1, 2**64 - 1]))


@pytest.mark.parametrize("pairwise", [64, 2])
def test_links_connect_what_is_near(spark, pairwise):
    fps = _fingerprints()
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    rows = components(simhash.links(df, pairwise)).collect()
    group = {r.node: r.root for r in rows}
    want = brute.linked(dict(enumerate(fps)))
    ours = {}
    for i, f in enumerate(signed):
        ours.setdefault(group.get(f, f), []).append(i)
    theirs = {}
    for i, root in want.items():
        theirs.setdefault(root, []).append(i)
    assert sorted(ours.values()) == sorted(theirs.values())


def test_near_duplicates_of_texts(spark):
    r = random.Random(2)
    base = [" ".join(r.choice("red blue green dark light".split()) + str(r.randrange(40)) for _ in range(200)) for _ in range(12)]
    docs = []
    for k, t in enumerate(base):
        docs += [(100 * k + 5, t), (100 * k + 3, t.replace("red1", "Red1", 1)), (100 * k + 9, t + " more")]
    docs += [(1, None), (2, ""), (7, " \t\n"), (8, "one"), (11, "one two"), (12, "One TWO"), (13, "a b c")]
    df = spark.createDataFrame(
        [(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string"
    )
    fps = {i: brute.simhash(t) for i, t in docs}
    want = brute.linked(fps)
    out = simhash.near_duplicates(df)
    rows = out.select("doc_id", simhash.hex_fingerprint(), "component_id").collect()
    assert {tuple(x) for x in rows} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}
    assert out.columns == ["doc_id", "text", "fp", "component_id"]


def test_near_duplicates_without_ids_or_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a"), (4, "a"), (4, "a"), (None, "b")], schema)
    got = sorted((r.text, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [("a", 4), ("a", 4), ("a", 4), ("b", None)]


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") * 7 % 61 + 100).alias("b"))
    chain = edges.unionByName(spark.range(1, 59).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    roots = {r.node: r.root for r in components(chain).collect()}
    assert set(roots.values()) == {1} and len(roots) == 59 + 59
    assert components(chain.where("false")).count() == 0


def test_suffixes_are_compared_with_few_hashes(monkeypatch):
    """Two hashes a comparison say whether suffixes are alike; the search for where they part reads sums only."""
    r = random.Random(5)
    raw = bytes(r.choices(b"ab", k=3000)) * 2
    text = suffix_dedup.Prefixes(np.frombuffer(raw, np.uint8))
    calls = []
    plain = suffix_dedup.Prefixes.of
    monkeypatch.setattr(suffix_dedup.Prefixes, "of", lambda *given: calls.append(1) or plain(*given))
    a = np.array([r.randrange(2900) for _ in range(500)])
    b = np.where(np.arange(500) % 2, a + 3000, np.array([r.randrange(5900) for _ in range(500)]))
    for length in (1, 7, 50, 64):
        x = [(raw[i : i + length], raw[j : j + length]) for i, j in zip(a, b, strict=True)]
        want = [(p > q) - (p < q) for p, q in x]
        calls.clear()
        assert suffix_dedup.compare_suffixes(text, a, b, length).tolist() == want
        assert len(calls) <= 2


def test_runs_stand_for_every_window(monkeypatch):
    """Also of texts that are cut, of a window's length, and next to shorter ones."""
    r = random.Random(6)
    for chunk in (1 << 20, 512):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        texts = [bytes(r.choices(b"abc ", k=n)) for n in (0, 49, 50, 51, 300, 20, 50, 2000, 700, 50)]
        seen = {}
        for who, q0, q1, place, h in suffix_dedup.sample_runs(texts):
            for i, lo, hi, at, x in zip(who, q0, q1, place, h, strict=True):
                for q in range(lo, hi + 1):
                    assert q <= at <= q + 30
                    seen.setdefault((i, q), (at - q, x))
        assert set(seen) == {(i, q) for i, t in enumerate(texts) for q in range(len(t) - 49)}
