"""Toxicity by a classifier chain over words, fitted with folds that never see themselves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import as_bytes, byte_words, map_batches, stored, with_bytes
from clickloom.llm.linear import Logistic, fit, labelled_sample

MAX_TRAIN = 10_000
# Markers kept of each fold and of the whole sample, at most.
VOCABULARY = 4096
FOLDS = 5
CUT = 0.5

# In the order of the chain. ``toxic`` is the label given by hand. The other two are read from
# texts so labelled, by evidence that the features (which know no order of words) do not hold:
# ``targeted`` ones point at somebody, ``severe`` ones hold hostile words close together.
CATEGORIES = ("toxic", "targeted", "severe")
# Words that point at somebody when a hostile word follows.
POINTING = frozenset(
    "the this that these those you your he she they his her their is are "
    "der die das du ihr er sie dein euer ist "
    "le la les tu vous il elle ton votre est "
    "el los las usted él ella tu su es un una ein eine une a an".encode().split()
)
CLOSE, TOGETHER = 25, 3  # severe: so many hostile words within so many words

# A marker of which this share of texts is toxic is a hostile one.
_TELLING = 0.9
# Log-likelihood ratio of a marker and the label: beyond chance also among a million markers.
EVIDENCE = 30.0
# A word stands for itself and for its beginnings of so many bytes, as insults are inflected.
_STEMS = (3, 4, 5, 6, 7)
_REMEMBERED = 200_000
# Words whose log odds reach these are counted apart.
_BANDS = (1.0, 2.0, 3.0, 4.0, 5.0)
FEATURES = 6 + len(_BANDS)


def markers(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a star."""
    return [word, *(word[:n] + b"*" for n in _STEMS if n < len(word))]


class Lexicon:
    """Log odds of markers; ``hostile`` are those found in toxic texts almost only."""

    def __init__(self, odds: dict[bytes, float], hostile: frozenset[bytes]):
        self.odds, self.hostile = odds, hostile
        self._seen: dict[bytes, tuple[float, bool]] = {}

    def __reduce__(self):
        return Lexicon, (self.odds, self.hostile)

    def _word(self, word: bytes) -> tuple[float, bool]:
        if (known := self._seen.get(word)) is None:
            if len(self._seen) > _REMEMBERED:
                self._seen.clear()
            found = [m for m in markers(word) if m in self.odds]
            known = self._seen[word] = (
                max((self.odds[m] for m in found), default=0.0),
                any(m in self.hostile for m in found),
            )
        return known

    def features(self, words: list[bytes]) -> list[float]:
        """Greatest, summed and mean log odds of the words, hostile words, bands, length."""
        found = [v for v in map(self._word, words) if v[0]]
        odds = [v[0] for v in found]
        total = sum(odds)
        return [
            max(odds, default=0.0),
            np.log1p(total),
            np.log1p(100 * total / max(20, len(words))),
            np.log1p(sum(v[1] for v in found)),
            float(any(v[1] for v in found)),
            *(np.log1p(sum(o >= b for o in odds)) for b in _BANDS),
            np.log1p(len(words)),
        ]

    def targeted(self, words: list[bytes]) -> bool:
        """Whether a hostile word follows one that points at somebody."""
        return any(a in POINTING and self._word(b)[1] for a, b in zip(words, words[1:], strict=False))

    def severe(self, words: list[bytes]) -> bool:
        """Whether ``TOGETHER`` hostile words stand within ``CLOSE`` words."""
        at = [i for i, w in enumerate(words) if self._word(w)[1]]
        return any(j - i < CLOSE for i, j in zip(at, at[TOGETHER - 1 :], strict=False))


@dataclass(frozen=True)
class Chain:
    lexicon: Lexicon
    models: tuple[Logistic, ...]

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, features)."""
        words = [byte_words(raw) for raw in texts]
        x = np.array([self.lexicon.features(w) for w in words]).reshape(-1, FEATURES)
        return np.array([len(w) for w in words], np.int64), x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of every category; each model also sees those of earlier ones."""
        out = np.zeros((len(x), len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.predict(np.column_stack([x, out[:, :k]]))
        return out


def _counted(batches):
    """Task: in how many texts, and toxic texts, of each fold each marker is."""
    held: dict[tuple[int, bytes], list[int]] = {}

    def rows():
        return pa.RecordBatch.from_arrays(
            [
                pa.array([m for _, m in held], pa.binary()),
                pa.array([f for f, _ in held], pa.int32()),
                pa.array([v[0] for v in held.values()], pa.int64()),
                pa.array([v[1] for v in held.values()], pa.int64()),
            ],
            names=["marker", "fold", "df", "hits"],
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("__bytes", "y", "fold"))
        for raw, y, fold in zip(*columns, strict=True):
            for m in {m for w in set(byte_words(raw)) for m in markers(w)}:
                count = held.setdefault((fold, m), [0, 0])
                count[0] += 1
                count[1] += y
            if len(held) > 4 * _REMEMBERED:
                yield rows()
                held.clear()
    if held:
        yield rows()


def _ratio(df: Column, hits: Column, share: Column) -> Column:
    """Log-likelihood ratio of a marker and the label."""
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    return 2 * (part(hits, df * share) + part(df - hits, df * (1 - share)))


def lexicons(
    sample: DataFrame, vocabulary: int = VOCABULARY, least: float = EVIDENCE
) -> list[Lexicon]:
    """One lexicon for each fold, made without its rows, and last the one of all rows.

    ``sample`` has ``text``, ``y`` (0 or 1) and ``fold``. Markers are counted once by marker and
    fold in the cluster; what a fold sees is the sum of all less its own. Only the
    ``vocabulary`` best of each come to the driver.
    """
    sizes = {r["fold"]: (r["n"], r["pos"]) for r in sample.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).collect()}
    n, pos = (sum(s[i] for s in sizes.values()) for i in (0, 1))
    seen = [
        (n - sizes.get(f, (0, 0))[0], pos - sizes.get(f, (0, 0))[1]) for f in range(FOLDS)
    ] + [(n, pos)]
    of_fold = lambda c, f: F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0))
    counted = (
        with_bytes(sample, "text", ("y", "fold"), ())
        .mapInArrow(_counted, "marker binary, fold int, df long, hits long")
        .groupBy("marker")
        .agg(
            F.sum("df").alias("df"),
            F.sum("hits").alias("hits"),
            *[of_fold(c, f).alias(f"{c}{f}") for c in ("df", "hits") for f in range(FOLDS)],
        )
    )
    views = [
        F.struct(
            F.lit(f).alias("view"),
            (F.col("df") - (F.col(f"df{f}") if f < FOLDS else 0)).alias("df"),
            (F.col("hits") - (F.col(f"hits{f}") if f < FOLDS else 0)).alias("hits"),
            F.lit(seen[f][1] / max(1, seen[f][0])).alias("share"),
        )
        for f in range(FOLDS + 1)
    ]
    df, hits, share = F.col("df"), F.col("hits"), F.col("share")
    best = (
        counted.select("marker", F.inline(F.array(*views)))
        .where(hits > df * share)
        .withColumn("evidence", _ratio(df, hits, share))
        .where(F.col("evidence") >= least)
        .withColumn(
            "place", F.row_number().over(Window.partitionBy("view").orderBy(F.desc("evidence"), "marker"))
        )
        .where(F.col("place") <= vocabulary)
        .select("view", "marker", "df", "hits")
        .collect()
    )
    out = []
    for view, (rows, toxic) in enumerate(seen):
        own = [(bytes(r["marker"]), r["df"], r["hits"]) for r in best if r["view"] == view]
        odds = {
            m: float(np.log((h + 0.5) / (toxic + 1)) - np.log((d - h + 0.5) / (rows - toxic + 1)))
            for m, d, h in own
        }
        out.append(Lexicon(odds, frozenset(m for m, d, h in own if h >= _TELLING * d)))
    return out


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Predictions for every row by a model that has not seen its fold."""
    out = np.zeros(len(x))
    for f in np.unique(fold):
        held = fold == f
        if held.all():
            out[held] = y.mean()
        else:
            out[held] = fit(x[~held], y[~held]).predict(x[held])
    return out


def training_rows(
    sample: DataFrame, by_fold: list[Lexicon]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, truth of every category, fold) of the sample.

    Features and the evidence of categories are read with the lexicon of the row's fold,
    which its own label has no part in. Every row is a few numbers, so the bounded sample fits the driver.
    """

    def make():
        def step(batch):
            x, truth = [], []
            columns = (batch.column(c).to_pylist() for c in ("__bytes", "y", "fold"))
            for raw, y, fold in zip(*columns, strict=True):
                words, lexicon = byte_words(raw), by_fold[fold]
                x.append(lexicon.features(words))
                truth.append([y, y * lexicon.targeted(words), y * lexicon.severe(words)])
            return {"x": x, "truth": truth}

        return step

    fields = {"x": "array<double>", "truth": "array<int>"}
    rows = map_batches(with_bytes(sample, "text", ("y", "fold"), fields), make, fields, ("__bytes",))
    got = rows.select("fold", "x", "truth").orderBy("fold", "x", "truth").collect()
    return (
        np.array([r["x"] for r in got], float).reshape(-1, FEATURES),
        np.array([r["truth"] for r in got], float).reshape(-1, len(CATEGORIES)),
        np.array([r["fold"] for r in got]),
    )


def chained(x: np.ndarray, truth: np.ndarray, fold: np.ndarray) -> tuple[Logistic, ...]:
    """One model a category; later ones see out-of-fold predictions of those before."""
    models, seen = [], x
    for y in truth.T:
        models.append(fit(seen, y))
        seen = np.column_stack([seen, out_of_fold(seen, y, fold)])
    return tuple(models)


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most: int = MAX_TRAIN,
    vocabulary: int = VOCABULARY,
    least: float = EVIDENCE,
) -> Chain | None:
    """Chain fitted on at most ``most`` labelled rows, or None without both kinds of them.

    Markers, that is words and their beginnings, are taken if they go with the label more often than
    by chance (``least``), the ``vocabulary`` best of them. Each training row is read with
    markers and weights counted without its fold, and each later model sees predictions of models fitted
    without it, as later it will see predictions and not truth. Folds go by text, so copies share one.
    """
    sample = labelled_sample(docs, labels, doc_id, text, (label,), most)
    sample = sample.select(
        F.col(text).alias("text"),
        (F.col(label) > 0).cast("int").alias("y"),
        F.pmod(F.xxhash64(as_bytes(text)), F.lit(FOLDS)).cast("int").alias("fold"),
    )
    # written once: the sample is read for the markers and for the features
    sample = stored(sample)
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    if not 0 < (size["pos"] or 0) < size["n"]:
        return None
    *by_fold, whole = lexicons(sample, vocabulary, least)
    return Chain(whole, chained(*training_rows(sample, by_fold)))


def scored(
    df: DataFrame, chain: Chain | None, text: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """``df`` with ``n_words``, ``p_abusive``, ``p_toxic``, ``p_severe`` and ``toxic``.

    Null and empty texts have no words and are judged by that. Without a chain all
    probabilities are 0 and nothing is toxic. Repeated rows get the same result; other
    columns, or those in ``keep``, are carried along, same-named ones replaced.
    """
    fields = {"n_words": "bigint"} | {f"p_{c}": "double" for c in CATEGORIES} | {"toxic": "boolean"}

    def make():
        def step(batch):
            texts = batch.column("__bytes").to_pylist()
            if chain is None:
                sizes, p = [len(byte_words(t)) for t in texts], np.zeros((len(texts), len(CATEGORIES)))
            else:
                sizes, x = chain.rows(texts)
                p = chain.predict(x)
            out = {f"p_{c}": pa.array(p[:, k].copy()) for k, c in enumerate(CATEGORIES)}
            toxic = pa.array(p[:, CATEGORIES.index("toxic")] >= CUT)
            return {"n_words": pa.array(sizes, pa.int64()), **out, "toxic": toxic}

        return step

    return map_batches(with_bytes(df, text, keep, fields), make, fields, ("__bytes",))
