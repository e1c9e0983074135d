"""BPE, decontamination, LZ fingerprints, quality and toxicity."""

import base64

import brute
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from clickloom.llm import bpe, decontam, linear, lzprint, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = ("word 12, don't  stop!\n" * 9000) + "　" * 50 + "字" * 3000 + " " * 70_000 + "end"


def _coder():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_bpe_is_the_library_s(spark):
    texts = [None, "", " ", "<|endoftext|>", "it's  we'll\r\n\tx", "é字\U0001f600", LONG, "a", "a"]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coder = _coder()
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decode=True)
    assert coded.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    for r in coded.collect():
        want = coder.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    back = bpe.decode(coded.select("doc_id", "ids"), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()}[6] == LONG.encode()
    assert bpe.encode(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_decodes_parts_of_characters(spark):
    coder = _coder()
    ids = coder.encode_ordinary("\U0001f600")
    assert len(ids) > 1
    raw = np.array(ids[:1], "<u4").tobytes()
    df = spark.createDataFrame([(1, raw), (2, None)], "k int, ids binary")
    got = {r.k: bytes(r.decoded) for r in bpe.decode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {1: coder.decode_single_token_bytes(ids[0]), 2: b""}


def test_bpe_chunks_of_awkward_texts():
    coder = _coder()
    with open(RANKS, "rb") as file:
        own = bpe.ByteBpe(file.read(), public_tokenizers.PATTERN)
    for text in ("x" * 90_000, ("ab  cd" * 20_000), "\n \n" * 40_000 + "z", "1a'll " * 20_000):
        assert own.encode(text) == coder.encode_ordinary(text)
    assert "".join(bpe.safe_chunks(LONG, 1000)) == LONG
    wide = " " * (bpe.LONGEST_CHUNK + 5) + "end"
    assert own.decode(own.encode(wide)) == wide.encode()
    assert own._by_match(LONG) == coder.encode_ordinary(LONG)


ITEMS = [
    (1, "The Quick brown-fox jumps over the lazy dog while seven small birds sing a song at dawn"),
    (2, "short Question"), (3, None), (4, "..."), (None, "short question"), (5, "Short, question!"),
]
DOCS = [
    (1, "x y. THE quick brown fox jumps over the lazy dog while seven small birds sing a song! z"),
    (2, "the quick brown fox jumps over the lazy dog"), (3, None), (4, ""), (5, "short question"),
    (6, "a " * 50_000 + "short question"), (7, "shorts question short questions"),
    (8, "é short question short question ñ"), (8, "é short question short question ñ"), (None, "a"),
]


def test_decontamination(spark):
    docs = spark.createDataFrame(
        [(i, t, "k") for i, t in DOCS], "doc_id long, text string, spans string"
    )
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute.contamination(DOCS, ITEMS), key=str)
    for size in (decontam.BLOCK_BYTES, 40):  # one automaton, or several one after the other
        found = decontam.contamination(docs, items, block_bytes=size)
        got = found.select("doc_id", "n_words", "n_hit", "item_ids", "contaminated").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert decontam.contamination(docs, items.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.contamination(docs.where("false"), items).count() == 0


def test_items_without_an_id_hit_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "beta gamma"), (7, "gamma"), (None, None)], "item_id long, text string")
    for size in (8 << 20, 4):
        rows = decontam.contamination(docs, items, block_bytes=size, spans=True).collect()
        got = {r.doc_id: (r.n_hit, r.item_ids, r.contaminated) for r in rows}
        assert got == {1: (2, ["7"], True), 2: (0, [], False)}
        spans = {(s.first_word, s.last_word, s.item_id) for r in rows for s in r.spans}
        assert spans == {(1, 2, None), (2, 2, "7")}


def test_contamination_spans_are_of_the_original(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (decontam.BLOCK_BYTES, 40):
        found = decontam.contamination(docs, items, spans=True, block_bytes=size)
        row = found.where("doc_id = 8").first()
        raw = row.text.encode()
        assert {raw[s.start : s.stop] for s in row.spans} == {b"short question"}
        assert sorted({(s.first_word, s.last_word) for s in row.spans}) == [(1, 2), (3, 4)]


def test_lz_parse_is_lz78():
    rng = np.random.default_rng(1)
    texts = ["", "a", "aaaaaaa", "abababab" * 9, "é字" * 50]
    texts += ["".join(rng.choice(list("abc de"), 400)) for _ in range(20)]
    for t in texts:
        ends, rest = lzprint.parse(t)
        pieces = [t[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        assert set(pieces) == brute.lz78(t) and len(set(pieces)) == len(pieces)
        assert "".join(pieces) + t[rest:] == t
        doc = lzprint.Parsed(1, t)
        assert doc.fingerprint == lzprint.fingerprint(t)
        edited, print_ = doc.edited("zz" * 300)
        assert print_ == lzprint.fingerprint(edited)


def test_lz_neighbours(spark):
    docs = [(i, f"text number {i} " * (i % 17)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "é" * 40_000), (103, docs[30][1])]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, fingerprint string")
    rows = {r.doc_id: r for r in lzprint.compare_with_next(df.repartition(7)).collect()}
    ordered = sorted(docs, reverse=True)
    assert len(rows) == len(docs)
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, following = t or "", following or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited.encode()))
        assert r.fingerprint == lzprint.fingerprint(t)
        assert r.edited_fingerprint == lzprint.fingerprint(edited)
        assert r.near_next == lzprint.likeness(r.fingerprint, lzprint.fingerprint(following))
        assert 0 <= r.near_edited <= 1
    assert rows[103].fingerprint == rows[30].fingerprint
    alone = lzprint.compare_with_next(df.where("doc_id = 5")).collect()
    assert [r.near_next for r in alone] == [1.0]
    assert lzprint.compare_with_next(df.where("false")).count() == 0
    prints = lzprint.fingerprints(df)
    assert prints.columns == ["doc_id", "text", "fingerprint"] and prints.count() == len(docs)


def test_lz_likeness_follows_phrase_sets(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    out = queries.op7_lz_fingerprint(spark, SF).collect()
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    error = []
    for r in out:
        a, b = brute.lz78(texts[r.doc_id]), brute.lz78(texts[after[r.doc_id]])
        error.append(abs(len(a & b) / len(a | b) - r.near_next))
    assert np.mean(error) < 0.06
    assert np.mean([r.near_edited > r.near_next for r in out]) > 0.97


def test_logistic_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    model = linear.fit(x, y)
    assert ((model.predict(x) > 0.5) == y).mean() > 0.95
    assert np.allclose(linear.fit(x, np.ones(400)).predict(x), 1, atol=0.01)


def _halves(spark, column):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", column)
    even = F.col("doc_id") % 2 == 0
    return docs, labels.where(even), labels.where(~even)


def test_quality_on_held_out_labels(spark):
    docs, train, test = _halves(spark, "quality")
    out = quality.classified(
        docs, train, F.col("source"), F.concat_ws("/", "source", "lang"), keep=("doc_id",)
    )
    seen = out.join(test, "doc_id").groupBy("quality", "good").count().collect()
    n = {(r.quality, r.good): r["count"] for r in seen}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.99
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.97


def test_quality_shrinks_sparse_sites(spark):
    rows = [("a", "a/x", 0.9)] * 60 + [("b", "b/x", 0.2)] * 60 + [("c", "c/x", 0.1)] + [(None, None, 0.5)]
    df = spark.createDataFrame(rows, "host string, path string, p_doc double")
    mean, k_path, sites = quality.site_posteriors(df)
    prior = {r.host: r.prior for r in sites.collect()}
    assert abs(prior["a"] - 0.9) < 0.05 and abs(prior["b"] - 0.2) < 0.05
    assert 0.1 < prior["c"] < mean  # one document says little
    assert k_path == float("inf")  # one path to a host: nothing to tell them apart
    same = spark.createDataFrame([("a", "p", 0.5), ("b", "q", 0.5)] * 9, df.schema)
    _, _, flat = quality.site_posteriors(same)
    assert {r.prior for r in flat.collect()} == {0.5}


def test_quality_posteriors_by_definition(spark):
    """Sites, weights and decisions against plain loops over the same evidence."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn(
        "source", F.expr("if(doc_id % 17 = 0, null, source)")
    )
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classified(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    rows = [(r.source, r.source and f"{r.source}/{r.lang}", r.p_doc) for r in out]
    mean = np.mean([p for *_, p in rows])
    sited = [r for r in rows if r[0] is not None]

    def groups(key):
        found = {}
        for r in sited:
            found.setdefault(r[key], []).append(r[2])
        return found

    def weight(found, center, count):
        sizes = [len(v) for v in found.values()]
        return quality.strength(
            mean, sum(sizes), count, sum(n * n for n in sizes),
            sum(len(v) * (np.mean(v) - center(k)) ** 2 for k, v in found.items()),
            sum(np.var(v) * len(v) for v in found.values()),
        )

    hosts, paths = groups(0), groups(1)
    k_host = weight(hosts, lambda _: mean, len(hosts))
    host_mean = {h: np.mean(v) for h, v in hosts.items()}
    free = min(len(paths), max(1, len(paths) - len(hosts)) + 1)
    k_path = weight(paths, lambda p: host_mean[p.split("/")[0]], free)
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    for r, (host, path, p) in zip(out, rows, strict=True):
        site = mean
        if host is not None:
            v = hosts[host]
            prior = mean if np.isinf(k_host) else (sum(v) + k_host * mean) / (len(v) + k_host)
            v = paths[path]
            site = prior if np.isinf(k_path) else (sum(v) - p + k_path * prior) / (len(v) - 1 + k_path)
        good = 1 / (1 + np.exp(-(logit(p) + logit(site) - logit(mean))))
        assert abs(r.p_site - site) < 1e-6 and abs(r.p_good - good) < 1e-6
        assert r.good == (r.p_good >= quality.KEEP)


def test_byte_sequences_are_shares():
    got = quality.sequences(b"abcABC")
    assert abs((got**2).sum() - 1) < 1e-9 and abs(got.max() - np.sqrt(0.5)) < 1e-9  # abc twice of four
    assert not quality.sequences(b"ab").any()


def test_quality_and_toxicity_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, lang string, good string"
    docs = spark.createDataFrame(
        [(1, None, None, None, "k"), (2, "", "s", "en", "k"), (2, "", "s", "en", "k"),
         (None, "x " * 100_000, "s", None, "k")], schema,
    )
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    host = (F.col("source"), F.concat_ws("/", "source", "lang"))
    out = quality.classified(docs, labels, *host)
    assert [r.good for r in out.collect()] == [True] * 4  # nothing known: nothing rejected
    assert out.columns[:4] == ["doc_id", "text", "source", "lang"]
    assert quality.classified(docs.where("false"), labels, *host).count() == 0
    assert toxicity.fit_chain(docs, labels) is None
    got = toxicity.scored(docs, None).collect()
    assert [r.toxic for r in got] == [False] * 4 and sorted(r.n_words for r in got) == [0, 0, 0, 100_000]
    both = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (2, None, None)], labels.schema)
    assert quality.classified(docs, both, *host).count() == 4
    assert toxicity.scored(docs, toxicity.fit_chain(docs, both)).count() == 4


def test_toxicity_on_held_out_labels(spark):
    docs, train, test = _halves(spark, "toxic")
    chain = toxicity.fit_chain(docs, train)
    assert len(chain.models) == len(toxicity.CATEGORIES)
    test = test.withColumnRenamed("toxic", "truth")
    out = toxicity.scored(docs.join(test, "doc_id"), chain, keep=("doc_id", "truth"))
    n = {(r.truth, r.toxic): r["count"] for r in out.groupBy("truth", "toxic").count().collect()}
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.99
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.88  # some are labelled so without a sign


def _labelled(spark, truth, common=60):
    """Documents of ``common`` words and insults; ``truth`` gives the label of (id, generator)."""
    rng = np.random.default_rng(7)
    common = [f"word{i}" for i in range(common)]
    rows = []
    for i in range(400):
        words = list(rng.choice(common, 30))
        if i % 4 == 0:
            for at in rng.choice(30, rng.integers(1, 6), replace=False):
                words[at] = rng.choice(["vilest", "rotter", "cursed"])
            if i % 8 == 0:
                words[3:5] = ["you", "vilest"]
        rows.append((i, " ".join(words), truth(i, rng)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def _chain_by_definition(rows, least):
    """Plain loops: markers without the row's fold, features, then the chain; also the last lexicon."""
    def lexicon(seen):
        df, hits = {}, {}
        for _, words, y, _ in seen:
            for m in {m for w in words for m in toxicity.markers(w)}:
                df[m], hits[m] = df.get(m, 0) + 1, hits.get(m, 0) + y
        n, pos = len(seen), sum(r[2] for r in seen)
        part = lambda k, of: k * np.log(k / of) if k else 0.0
        odds, hostile = {}, set()
        for m, d in df.items():
            h, share = hits[m], pos / n
            if h > d * share and 2 * (part(h, d * share) + part(d - h, d * (1 - share))) >= least:
                odds[m] = np.log((h + 0.5) / (pos + 1)) - np.log((d - h + 0.5) / (n - pos + 1))
                if h >= 0.9 * d:
                    hostile.add(m)
        return toxicity.Lexicon(odds, frozenset(hostile))

    x, truth = [], []
    without = {f: lexicon([r for r in rows if r[3] != f]) for f in {r[3] for r in rows}}
    for _, words, y, fold in rows:
        own = without[fold]
        hostile = [any(m in own.hostile for m in toxicity.markers(w)) for w in words]
        targeted = any(b and w in toxicity.POINTING for w, b in zip(words, hostile[1:], strict=False))
        severe = any(sum(hostile[i : i + toxicity.CLOSE]) >= toxicity.TOGETHER for i in range(len(words)))
        x.append(own.features(words))
        truth.append([y, y * targeted, y * severe])
    x, truth, folds = np.array(x), np.array(truth, float), np.array([r[3] for r in rows])
    models, seen = [], x
    for y in truth.T:
        models.append(linear.fit(seen, y))
        again = np.zeros(len(y))
        for f in set(folds.tolist()):
            again[folds == f] = linear.fit(seen[folds != f], y[folds != f]).predict(seen[folds == f])
        seen = np.column_stack([seen, again])
    return lexicon(rows), models, truth


def test_chain_by_definition(spark):
    docs = _labelled(spark, lambda i, rng: int(i % 4 == 0 and i % 160 != 0))
    chain = toxicity.fit_chain(docs.drop("toxic"), docs.select("doc_id", "toxic"), least=10.0)
    held = docs.selectExpr("*", f"cast(pmod(xxhash64(cast(text as binary)), {toxicity.FOLDS}) as int) as fold")
    rows = [(r.doc_id, r.text.encode().split(), r.toxic, r.fold) for r in held.collect()]
    lexicon, models, truth = _chain_by_definition(rows, 10.0)
    assert lexicon.odds.keys() == chain.lexicon.odds.keys() and b"vilest" in lexicon.hostile
    assert 0 < truth[:, 1].sum() < truth[:, 0].sum() and 0 < truth[:, 2].sum() < truth[:, 0].sum()
    got = {r.doc_id: r for r in toxicity.scored(docs, chain, keep=("doc_id",)).collect()}
    for who, words, *_ in rows:
        seen = np.array([lexicon.features(words)])
        for category, model in zip(toxicity.CATEGORIES, models, strict=True):
            p = model.predict(seen)
            assert abs(got[who][f"p_{category}"] - p[0]) < 1e-6
            seen = np.column_stack([seen, p])


def test_labels_by_chance_give_no_gain_out_of_fold(spark):
    docs = _labelled(spark, lambda i, rng: int(rng.integers(0, 2)), common=3000)
    sample = docs.selectExpr("text", "toxic as y", "cast(doc_id % 5 as int) as fold")
    *by_fold, whole = toxicity.lexicons(sample, least=1.0)

    def right(lexicons):
        x, truth, fold = toxicity.training_rows(sample, lexicons)
        return ((toxicity.out_of_fold(x, truth[:, 0], fold) > 0.5) == truth[:, 0]).mean()

    honest = right(by_fold)
    # markers chosen with a row's own label tell it
    assert honest < 0.58 and right([whole] * toxicity.FOLDS) > honest + 0.1


def test_repeated_documents_do_not_add_to_the_sample(spark):
    docs = spark.createDataFrame([(1, "b", "x")] * 50 + [(1, "c", "y"), (2, None, "z"), (None, "q", "k")],
                                 "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (None, 1)], "doc_id long, toxic int")
    got = linear.labelled_sample(docs, labels, "doc_id", "text", ("toxic",), 10).collect()
    assert sorted((r.doc_id, r.toxic, r.text) for r in got) == [(1, 0, "c"), (1, 1, "c"), (2, 1, None)]
    out = toxicity.scored(docs.withColumn("p_toxic", F.lit("mine")), toxicity.fit_chain(docs, labels))
    assert out.count() == 53 and dict(out.dtypes)["p_toxic"] == "double"


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 60)), rng.integers(0, 2, 200).astype(float)
    fold = np.arange(200) % 5
    honest = toxicity.out_of_fold(x, y, fold)
    own = linear.fit(x, y).predict(x)
    assert ((own > 0.5) == y).mean() > 0.7 > ((honest > 0.5) == y).mean()
