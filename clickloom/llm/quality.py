"""Quality classifier: document evidence with host and path posteriors by empirical Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import map_batches, stored, with_bytes
from clickloom.llm.linear import Logistic, fit, labelled_sample

# Labelled rows the document classifier is fitted on, at most.
MAX_TRAIN = 10_000
KEEP = 0.5

_PUNCTUATION = np.array([b in b".,;:'\"-()?" for b in range(256)])
_SYMBOL = np.array(
    [32 < b < 127 and not chr(b).isalnum() and b not in b".,;:'\"-()?" for b in range(256)]
)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
SHARES = 14
# Three-byte sequences are counted in so many classes by a hash.
CLASSES = 128
FEATURES = SHARES + CLASSES


def sequences(text: bytes) -> np.ndarray:
    """Square roots of the shares of three-byte sequences in each class: how words are written."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(CLASSES)
    key = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    found = np.bincount((key * np.uint32(2654435761)) >> np.uint32(25), minlength=CLASSES)
    return np.sqrt(found / len(key))


def features(text: bytes) -> list[float]:
    """Shares and lengths that tell prose from junk; an empty text gives zeros."""
    words = text.split()
    if not words:
        return [0.0] * SHARES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, total = len(words), max(1, len(text) - int(counts[32] + counts[10] + counts[9]))
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = float(counts[_SYMBOL].sum()) / total
    upper = float(counts[_UPPER].sum()) / letters
    return [
        np.log1p(n),
        total / n,
        distinct / n,
        np.log(distinct) / np.log1p(n),
        again / n,
        min(1.0, 10 * again / n),
        symbols,
        min(1.0, 20 * symbols),
        upper,
        min(1.0, 3 * upper),
        float(counts[_DIGIT].sum()) / total,
        float(counts[_PUNCTUATION].sum()) / total,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
    ]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column("__bytes").to_pylist()
    return np.array([[*features(raw), *sequences(raw)] for raw in texts]).reshape(-1, FEATURES)


def fit_documents(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most: int = MAX_TRAIN,
) -> Logistic | None:
    """Classifier of good (1) and bad (0) documents, or None without labels of both kinds."""
    sample = labelled_sample(docs, labels, doc_id, text, (label,), most)
    rows = map_batches(
        with_bytes(sample.withColumn("__y", F.col(label).cast("double")), text, ("__y",), ()),
        lambda: lambda batch: {"x": [row.tobytes() for row in _matrix(batch)]},
        {"x": "binary"},
        ("__bytes",),
    ).collect()
    y = np.array([r["__y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([np.frombuffer(r["x"]) for r in rows]), y)


def document_evidence(
    df: DataFrame, model: Logistic | None, text: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """``df`` with ``p_doc``, the probability of a good document by its text alone."""

    def make():
        def step(batch):
            x = _matrix(batch)
            p = np.full(len(x), 0.5) if model is None else model.predict(x)
            return {"p_doc": pa.array(p)}

        return step

    return map_batches(with_bytes(df, text, keep, ("p_doc",)), make, {"p_doc": "double"}, ("__bytes",))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def strength(mean: float, rows: int, groups: int, squares: float, between: float, within: float) -> float:
    """Prior weight in documents, by moments: the less sites differ, the more.

    ``between`` is the sum over sites of n (site mean - mean)^2, ``within`` that of the
    squared deviations inside sites, ``squares`` that of n^2. Sites that differ no more
    than chance allows get an infinite prior: they are worth nothing as evidence.
    """
    if rows <= groups or groups < 2 or not 0 < mean < 1:
        return float("inf")
    noise = within / (rows - groups)
    variance = (between - (groups - 1) * noise) / max(1e-12, rows - squares / rows)
    return float("inf") if variance <= 1e-9 else max(1.0, mean * (1 - mean) / variance - 1)


def _moments(groups: DataFrame, mean: Column) -> dict:
    """Of a table of sites with n, s (sum) and q (sum of squares) around a mean per row."""
    row = groups.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") * F.col("n").cast("double")).alias("squares"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
    ).first()
    return {k: row[k] or 0 for k in ("rows", "groups", "squares", "between", "within")}


def site_posteriors(evidence: DataFrame) -> tuple[float, float, DataFrame]:
    """(global mean, path prior weight, table of ``host``, ``path``, ``n``, ``s``, ``prior``).

    ``evidence`` has ``host``, ``path`` and ``p_doc``. One grouped aggregation gives
    counts and sums by path; hosts and the whole are sums of these, and rows without a
    site count for the whole. ``prior`` is the posterior mean of the host, shrunk to the
    global mean; paths shrink to it in turn.
    """
    every = stored(
        evidence.groupBy("host", "path")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("p_doc").alias("s"),
            F.sum(F.col("p_doc") * F.col("p_doc")).alias("q"),
        )
    )
    paths = every.where("host is not null and path is not null")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    total = every.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = 0.5 if total is None else float(total)
    k_host = strength(mean, **_moments(hosts, F.lit(mean)))
    by_host = hosts.select(
        "host",
        (F.col("s") / F.col("n")).alias("host_mean"),
        (
            F.lit(mean)
            if k_host == float("inf")
            else (F.col("s") + F.lit(k_host * mean)) / (F.col("n") + F.lit(k_host))
        ).alias("prior"),
    )
    joined = paths.join(by_host, "host")
    moments = _moments(joined, F.col("host_mean"))
    # one mean is used up for each host
    extra = max(1, moments["groups"] - hosts.count()) + 1
    k_path = strength(mean, **(moments | {"groups": min(moments["groups"], extra)}))
    return mean, k_path, joined.select("host", "path", "n", "s", "prior")


def classified(
    df: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    keep: tuple[str, ...] | None = None,
    most: int = MAX_TRAIN,
) -> DataFrame:
    """``df`` with ``p_doc``, ``p_site``, ``p_good`` and ``good``.

    ``p_doc`` is the document classifier's evidence, fitted on at most ``most`` labelled
    rows. ``p_site`` is the posterior mean of the document's path, without the document
    itself: path evidence shrunk to the host's posterior, which is shrunk to the global
    mean, each by a weight estimated from how much sites really differ. ``p_good`` adds to the
    document's log odds those by which its site differs from the global mean.

    Evidence is summed by site before it is shuffled, so a site with a third of all
    rows is no burden. Null hosts or paths have the global mean. Null and empty texts
    are judged by empty features. Without labels of both kinds every document has 0.5 and
    is good. Other columns are carried along (or those in ``keep``).
    """
    spark_model = fit_documents(df, labels, doc_id, text, label, most)
    new = ("p_doc", "p_site", "p_good", "good")
    names = [c for c in (df.columns if keep is None else keep) if c not in new]
    marked = df.withColumns({"__host": host.cast("string"), "__path": path.cast("string")})
    narrow = document_evidence(marked, spark_model, text, ("__host", "__path"))
    mean, k_path, sites = site_posteriors(
        narrow.select(F.col("__host").alias("host"), F.col("__path").alias("path"), "p_doc")
    )
    sites = sites.select(
        F.col("host").alias("__host"), F.col("path").alias("__path"), "n", "s", "prior"
    )
    rows = document_evidence(marked, spark_model, text, (*names, "__host", "__path"))
    rows = rows.join(sites, ["__host", "__path"], "left")
    others = (
        F.col("prior")
        if k_path == float("inf")
        else (F.col("s") - F.col("p_doc") + F.lit(k_path) * F.col("prior"))
        / (F.col("n") - 1 + F.lit(k_path))
    )
    p_site = F.coalesce(others, F.lit(mean))
    odds = _logit(F.col("p_doc")) + _logit(F.col("p_site")) - _logit(F.lit(mean))
    return (
        rows.withColumn("p_site", p_site)
        .withColumn("p_good", 1 / (1 + F.exp(-odds)))
        .withColumn("good", F.col("p_good") >= KEEP)
        .select(*names, *new)
    )
