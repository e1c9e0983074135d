"""Licence labels of notices wherever they stand, against brute force."""

import random

import brute
import check
from pyspark.sql import functions as F

from clickloom.llm import license_join, oracles

GPL = "This work is licensed under the GNU General Public License, version 3."
NOTICES = dict(reversed(license_join.TEMPLATES))


def _wrapped(text, words=6):
    w = text.split()
    return "\n * ".join(" ".join(w[k : k + words]) for k in range(0, len(w), words))


def _docs():
    rng = random.Random(6)
    common = sorted({w for _, n in license_join.TEMPLATES for w in n.lower().split()})
    filler = lambda n: " ".join(f"word{rng.randrange(500)}" for _ in range(n))
    two = "Licensed under CC BY-SA 4.0. " + GPL
    texts = [
        None, "", two, GPL, GPL.replace("General", "Lesser General"), "Licensed under CC BY-SA 4.0.",
        " ".join(n for label, n in license_join.TEMPLATES if label in ("agpl-3", "bsd-3", "mpl-2")),
        GPL.replace("Public ", "Public\n"), _wrapped(NOTICES["bsd-3"], 4), _wrapped(NOTICES["gpl-3"], 1),
        "\r\n\r\n".join(NOTICES["mit"].split()), "Released under the MIT License.",
        filler(30_000) + " " + _wrapped(GPL) + " " + filler(120_000), filler(200),
        GPL.lower().replace("this work is ", ""), " ".join([GPL] * 2000),
    ]
    for at in range(60):  # a notice at every place of a block
        texts.append(f"{filler(at)} {_wrapped(NOTICES['bsd-3'], 3)} {filler(9)} {two if at % 2 else ''}")
    for _ in range(60):
        texts.append(" ".join(rng.choices([*common, "other"], k=rng.randint(1, 150))))
    return [(i, t) for i, t in enumerate(texts)]


def test_labels_are_those_of_brute_force(spark, tmp_path):
    docs = _docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {"row": F.lit("x"), "words": F.lit(1), "held": F.lit(2), "labels": F.lit("mine")}
    )
    rows = {r.doc_id: r for r in license_join.scan(df).collect()}
    for i, text in docs:
        found, best = brute.licence_labels(
            text, license_join.TEMPLATES, license_join.THRESHOLD, license_join.STRIDE
        )
        joined = f" {' '.join(brute.words(text))} "
        base = {label for phrase, label in license_join.PHRASES.items() if f" {phrase} " in joined}
        assert rows[i].labels == ",".join(sorted(found | base)), i
        assert rows[i].base_labels == ",".join(sorted(base))
        assert abs(rows[i].score - (1.0 if base else best)) < 1e-12
    for i, want in {2: "cc-by-sa,gpl-3", 7: "gpl-3", 8: "bsd-3", 9: "gpl-3", 12: "gpl-3", 4: "lgpl-3"}.items():
        assert rows[i].labels == want and rows[i].score == 1
    short = df.where("coalesce(length(text), 0) < 5000")  # the SQL copies a text for each of its words
    short.select("doc_id", "text").write.parquet(str(tmp_path / "d.parquet"))
    con = check.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet/*.parquet'")
    ours = license_join.scan(short).toPandas()
    assert check.difference(ours, con.sql(oracles.OP8).df()) is None
