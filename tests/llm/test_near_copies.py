"""Near copies by shingle similarity against brute force."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from clickloom.llm import minhash, simhash


def _docs():
    """Copies with more and more words changed, a large group, short and empty texts."""
    r = random.Random(4)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    docs = [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "one two three")]
    i = 1
    for n in (30, 80, 300):
        base = text(n)
        for k in range(12):
            w = list(base)
            for _ in range(k * n // 150 + (k > 0)):
                w[r.randrange(n)] = "changed" + str(r.randrange(99))
            docs.append((i, " ".join(w)))
            i += 1
    base = text(100)
    for k in range(60):  # all differ from each other in one or two words
        w = list(base)
        w[k] = "x"
        docs.append((i, " ".join(w)))
        i += 1
    return docs + [(i + k, " ".join(text(60))) for k in range(20)]


def _found(df):
    return minhash.near_copies(df.withColumn("row", F.col("doc_id") * 3), "row")


def test_near_copies_are_those_of_all_pairs(spark):
    docs = _docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in _found(df).collect()}
    assert got == brute.shingle_groups(docs)


def test_links_that_heads_leave_are_found_by_rarest_shingles(spark, monkeypatch):
    """With no help from the central sets, the exact join alone finds every link."""
    none = lambda mates, least: mates.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    monkeypatch.setattr(minhash, "_head_pairs", none)
    docs = _docs()
    got = {r.doc_id: r.component_id for r in _found(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.shingle_groups(docs)


def test_common_passage_makes_no_pairs(spark, monkeypatch):
    """Unlike texts around one passage: none is linked, and hardly any pair is compared."""
    r = random.Random(7)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = words(120)
    docs = [(i, f"{words(25)} {passage} {words(25)}") for i in range(300)]
    docs.append((300, docs[0][1] + " end"))
    pairs = []
    plain = minhash._prefix_pairs

    def counted(*given):
        found = plain(*given)
        pairs.append(found[0].count())
        return found

    monkeypatch.setattr(minhash, "_prefix_pairs", counted)
    got = {r.doc_id: r.component_id for r in _found(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.shingle_groups(docs) and got[300] == 0
    assert pairs[0] < 10


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, repeated and null ids, clashing names, very long texts."""
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [
        (1, "a b c", "en", "s", 5, True, "mine", 1), (1, "a b c", "en", "s", 5, True, "mine", 1),
        (2, "d e f", "en", "s", 5, True, "mine", 2), (2, "a b c", "de", "t", 5, False, "mine", 3),
        (None, "a b c", None, None, None, None, None, 4), (None, "only", None, None, None, True, "k", 5),
        (7, long, "en", "s", 9, True, "q", 6), (6, long + " more", "en", "s", 9, True, "q", 7),
    ]
    names = ["doc_id", "text", "lang", "source", "n_chars", "good", "kept", "component_id"]
    kinds = ("long", "string", "string", "string", "long", "boolean", "string", "int")
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_dedup"](spark, df, "")
    assert kept.schema == df.schema
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[5], rows[7]], key=str)
    cut = stages["suffix_dedup"](spark, kept, "").select(*names)
    assert cut.schema == df.schema and cut.count() == 4


def test_pipeline_stage_drops_copies_that_two_bits_leave(spark):
    docs = _docs()
    want = {i for i, root in brute.shingle_groups(docs).items() if i == root}
    by_bits = {i for i, root in brute.linked({i: brute.simhash(t) for i, t in docs}).items() if i == root}
    assert len(want) < len(by_bits)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert {r.doc_id for r in kept.collect()} == want
    assert corpus_pipeline.drop_near_copies(spark, df.where("false"), "").count() == 0


def test_pipeline_stage_groups_by_fingerprints(spark, monkeypatch):
    """Copies within two bits go though no band has them; texts that are only close in bits stay."""
    alone = lambda sets: np.random.default_rng().integers(0, 1 << 63, (len(sets), minhash.BANDS), np.uint64)
    monkeypatch.setattr(minhash, "band_keys", alone)
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    docs = [(1, " ".join(base)), (2, "other words of another text"), (3, "other words of another page")]
    for i in range(4, 7):  # one word in 20,000 differs
        docs.append((i, " ".join([*base[: 3000 * i], "changed", *base[3000 * i + 1 :]])))
    near = brute.linked({i: simhash.fingerprint(t.encode(), minhash.WIDTH) for i, t in docs})
    assert any(near[i] == 1 for i in (4, 5, 6))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == {i for i, root in near.items() if i == root}


def test_pipeline_of_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = spark.createDataFrame(stages["quality"](spark, docs, sf).collect(), docs.schema)
    groups = brute.shingle_groups([(r.doc_id, r.text) for r in good.collect()])
    single = stages["near_dedup"](spark, good, sf).collect()
    assert {r.doc_id for r in single} == {i for i, root in groups.items() if i == root}
    single = spark.createDataFrame(single, docs.schema)
    cut = stages["suffix_dedup"](spark, single, sf).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination([(r.doc_id, r.text) for r in cut], items) if r[-1]}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in cut} - bad and all(r.round_trip for r in out)
