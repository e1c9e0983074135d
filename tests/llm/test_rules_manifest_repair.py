"""Quality rules, Merkle manifest and conversation repair against plain versions of them."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from clickloom.llm import compression, manifest, ordered, queries, repair

SF = "/root/testdata/sf0.001"


def rules(text):
    """The contract's counts, by definition; the verdict from the ratios of text and chunks."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    bands, size = compression.Bands(), zstandard.ZstdCompressor(level=compression.LEVEL).compress
    ok = not failed
    limits = [b[1:] for b in bands.texts if len(raw) >= b[0]]
    if raw and limits:
        ok &= limits[-1][0] <= len(size(raw)) / len(raw) <= limits[-1][1]
    pieces = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    pieces = [p for p in pieces if len(p) >= 2048 and len(raw) > 4096]
    bad = [p for p in pieces if not 0.20 <= len(size(p)) / len(p) <= 0.72]
    ok &= sum(map(len, bad)) <= 0.25 * sum(map(len, pieces))
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        len(re.findall(rb"[#*$%&|<>]", raw)),
        len(lines) - len(set(lines)),
        len(inside),
        failed,
        ok,
    )


def prose(n, seed=0):
    rng = random.Random(seed)
    made = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choices(made, k=n))


def test_rules_by_definition(spark):
    rng = random.Random(1)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=30_000))
    eight = "a b c d e f g h "
    texts = [
        None, "", " \n\t ", "one", eight, eight * 2, eight + "x " + eight, "z " * 5000,
        prose(30), prose(300), prose(30_000), prose(200_000), "wörter ünd 字 " * 7 + prose(40),
        "a line\nb\na line\n\n\n \n \nA line\n" + prose(60), noise, " ".join(noise[i : i + 60] for i in range(0, 30_000, 60)),
        prose(900) + " " + " ".join(noise[i : i + 40] for i in range(0, 30_000, 40)), "# * $ % & | < > " + prose(50),
        "  \u0085 x " * 30, prose(300), "a\x0bb\x0cc\rd",
    ]
    rows = [(i, t, f"r{i}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ratio string, other int")
    found = compression.judged(df)
    assert found.columns[:3] == ["doc_id", "text", "other"]
    for r in found.collect():
        got = tuple(
            r[c]
            for c in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            )
        )
        assert got == rules(texts[r.doc_id]), r.doc_id
        assert (r.ratio is None) == (not texts[r.doc_id])
    kept = {r.doc_id for r in found.collect() if r.kept}
    assert {9, 10, 11, 19} <= kept and not {0, 1, 2, 7, 14, 15, 16} & kept
    assert compression.judged(df.where("false")).count() == 0


def test_rules_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op11_quality_rules(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        r = got[i]
        assert (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept,
        ) == rules(t)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row[0], row[2], row[1], row[3], text)  # doc_id, source, lang, n_chars, text
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(nodes):
    """Levels from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def steps_of(levels, at):
    for level in levels[:-1]:
        first = at // 8 * 8
        yield level[first:at], level[at + 1 : first + 8]
        at //= 8


def merkle(rows):
    """(doc_id, lang, source, n_chars, text) rows -> result rows, sorted."""
    langs = sorted({r[1] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, parts = {}, {}
    for lang in langs:
        part = [(r, leaf_of(r, r[4])) for r in rows if r[1] == lang]
        parts[lang] = sorted(part, key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))
        trees[lang] = tree_of([leaf for _, leaf in parts[lang]])
    top = tree_of([trees[v][-1][0] for v in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (row, leaf) in enumerate(parts[lang]):
            steps = [*steps_of(trees[lang], i), *steps_of(top, k)]
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                lowered = re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
                node = leaf_of(row, lowered)
            for left, right in steps:
                node = digest(*left, node, *right)
            proof = digest(*[x for left, right in steps for x in (*left, *right)])
            out.append((row[0], leaf, trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


RESULT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_by_definition(spark):
    rows = [(i, "en", "s", 3, f"Text {i}") for i in range(700)]
    rows += [(i, None, None, None, None) for i in range(700, 709)]
    rows += [(1000 + i, f"l{i}", "é", i, "ABC") for i in range(70)]
    rows += [(5, "de", "a", 1, "X")] * 9 + [(None, "de", "a", 1, "X"), (2**60 + 3, "de", "", 0, "")]
    rows += [(3000, "", "s", 1, "lone"), (-4, "fr", "s", 10**6, "Long " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    df = df.withColumns({"tree": F.lit(1), "idx": F.lit("x"), "leaf": F.lit("y")})
    found = manifest.verified_documents(df)
    assert tuple(found.columns) == RESULT
    assert sorted((tuple(r) for r in found.collect()), key=str) == merkle(rows)
    assert manifest.verified_documents(df.where("false")).count() == 0


@pytest.mark.parametrize("arity_levels", [1, 2])
def test_manifest_of_several_tiers(spark, monkeypatch, arity_levels):
    """Short blocks, so that trees need tiers above tiers."""
    block = 8**arity_levels
    monkeypatch.setattr(manifest, "LEVELS", arity_levels)
    monkeypatch.setattr(manifest, "BLOCK", block)
    monkeypatch.setattr(manifest, "SEGMENT", sum(8**k for k in range(arity_levels + 1)))
    for n in (1, 8, 9, 63, 64, 65, 513, 600):
        nodes = [digest(str(i)) for i in range(n)]
        levels = tree_of(nodes)
        current, total, path = nodes, n, [[] for _ in range(n)]
        while True:
            logs = [
                [d for _, d in manifest.append_log(current[i : i + block], total)]
                for i in range(0, len(current), block)
            ]
            stride = n if total == n else None
            if stride:
                for b, log in enumerate(logs):
                    part = current[b * block : (b + 1) * block]
                    for k, steps in enumerate(manifest.local_steps(log, len(part), total)):
                        path[b * block + k] = steps
            if total <= block:
                break
            current, total = [log[-1] for log in logs], -(-total // block)
        assert logs[0][-1] == levels[-1][0]
        for i in range(n):
            want = [("".join(a), "".join(b)) for a, b in steps_of(levels, i)]
            assert path[i] == want[: len(path[i])]


def test_manifest_tiers_in_spark(spark):
    rows = [(i, "en", "s", 3, f"Text {i}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    found = manifest.verified_documents(df.repartition(7))
    assert sorted((tuple(r) for r in found.collect()), key=str) == merkle(rows)


def test_manifest_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "lang", "source", "n_chars", "text").collect()]
    found = queries.op12_merkle_manifest(spark, SF)
    assert sorted((tuple(r) for r in found.collect()), key=str) == merkle(rows)


def damage(rows):
    """(conv_id, turn, role, text) rows -> conversations with damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        found = out.setdefault(conv, [])
        blank = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        found += [(turn, role, text)] * (2 if kind == 3 else 1)
    for found in out.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def best_repair(rows):
    """All edit sequences, by recursion over (row, state); the least (cost, letters, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    following = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def least(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[i]
            extra = 5 if faults[i] == "truncated" else 0
            cost, letters, lines = least(i + 1, state, 0)
            ways.append((2 + cost, "D" + letters, lines))
            if faults[i] not in ("blank", "duplicate"):
                to = following[state].get(role[:1])
                if to:
                    cost, letters, lines = least(i + 1, to, 0)
                    ways.append((extra + cost, "K" + letters, (f"{role}:{text}", *lines)))
                for to in set(following[state]) & set(names):
                    cost, letters, lines = least(i + 1, to, 0)
                    ways.append((1 + extra + cost, "R" + letters, (f"{names[to]}:{text}", *lines)))
        if inserted < 3:
            for to in set(following[state]) & set(names):
                cost, letters, lines = least(i, to, inserted + 1)
                ways.append((5 + cost, "I" + letters, (f"{names[to]}:", *lines)))
        return min(ways) if ways else (10**9, "", ())

    cost, letters, lines = least(0, "", 0)
    return faults, cost, letters, digest("\n".join(lines))


def repaired_rows(rows):
    out = []
    for conv, found in damage(rows).items():
        faults, cost, letters, sha = best_repair(found)
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:], strict=False)]
        counts = Counter(faults)
        out.append(
            (
                conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"],
                sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, sha,
            )
        )
    return sorted(out, key=str)


FOUND = (
    "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "usr"]
    texts = ["Hi.", "Hi", "ok!", "", " \n\t", "Why?", "a\n", "b.\n", None, "é. \u0085", "x\x0b", "long " * 50 + "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            at = rng.choice([turn, turn, turn, turn + 3, None])
            role = rng.choice(roles if rng.random() < 0.3 else roles[turn % 2 : turn % 2 + 1])
            rows.append((conv, at, role, rng.choice(texts) if rng.random() < 0.6 else f"t{turn}{rng.choice('.x')}"))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_by_definition(spark):
    rows = conversations(3, 400, 9) + [(None, 1, "user", "Q?"), (None, 2, "assistant", "A."), (None, None, None, None)]
    rows += [(10**6 + i, 0, "user", "only.") for i in range(60)]  # some are dropped whole
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "idx": F.lit(2), "audit": F.lit("Z")})
    found = repair.repaired(repair.damaged(df)).select(*FOUND)
    assert sorted((tuple(r) for r in found.collect()), key=str) == repaired_rows(rows)
    assert repair.repaired(repair.damaged(df.where("false"))).count() == 0
    assert {r[8] for r in repaired_rows(rows) if r[7] == ""} == {digest("")}


def test_repair_of_long_conversations_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 4)
    monkeypatch.setattr(repair, "FAN", 3)
    rows = conversations(5, 12, 150)
    found = repair.repaired(repair.damaged(spark.createDataFrame(rows, SCHEMA))).select(*FOUND)
    assert sorted((tuple(r) for r in found.collect()), key=str) == repaired_rows(rows)


def test_repair_of_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversation_repair(spark, SF).select(*FOUND)
    assert sorted((tuple(r) for r in found.collect()), key=str) == repaired_rows(rows)


def test_repair_needs_a_price_for_rows():
    with pytest.raises(ValueError):
        repair.Costs(insert=0)


def test_numbered_spreads_a_large_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.lit(1).alias("v"), "id")
    df = df.unionByName(df.limit(3).withColumn("g", F.lit("h")))
    found = ordered.numbered(df, "g", [F.col("v")])
    got = found.groupBy("g").agg(F.collect_set("idx").alias("i"), F.max("total").alias("t")).collect()
    assert {r.g: (sorted(r.i), r.t) for r in got} == {"g": (list(range(5000)), 5000), "h": ([0, 1, 2], 3)}
