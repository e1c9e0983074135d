"""A corpus cleaned and tokenised in five stages, each a DataFrame of documents.

Every stage works on all documents its predecessor kept and is written to the shared
folder before the next one reads it, so a lost executor repeats one stage at most.
Stages keep the columns of ``documents``; the last one returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import bpe, decontam, minhash, quality, simhash, suffix_dedup
from clickloom.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# No stage but decontamination can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def _names_kept(stage: Callable) -> Callable:
    """The stage over documents whose further columns have other names meanwhile.

    So a column of the user's that is called like one that an operator makes comes
    back as it was.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"__further_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run_stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    marked = quality.classified(
        docs,
        table(spark, sf_dir, "labels"),
        F.col("source"),
        F.concat_ws("/", "source", "lang"),
    )
    return marked.where("good").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id.

    Near means that 0.8 of the five-word shingles of both texts are common to them. The
    operator of op6 groups all rows by SimHash fingerprints of these shingles; what it finds is
    confirmed by the whole sets of shingles. As two bits leave nearly all such copies, those
    that are left are sought by bands and exactly. Rows are told apart as
    rows: of repeated rows, rows that share an id, or rows without one, only those go that
    are near copies of a row that stays.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    close = simhash.near_duplicates(rows, "__row", width=minhash.WIDTH, keep=("__row",))
    found = minhash.near_copies(rows, "__row", close=close)
    gone = found.where("not first").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has too; all rows stay."""
    done = suffix_dedup.deduplicated(docs, as_text=True)
    cut = F.col("n_removed") > 0
    return done.withColumns(
        {
            "text": F.when(cut, F.col("kept")).otherwise(F.col("text")),
            "n_chars": F.when(cut, F.char_length("kept").cast("bigint")).otherwise(F.col("n_chars")),
        }
    ).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not contaminated by benchmark items."""
    marked = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.where("not contaminated").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, and whether decoding gives its text again."""
    import public_tokenizers

    coded = bpe.encode(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        decode=True,
    )
    same = F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality", _names_kept(keep_good)),
    ("near_dedup", _names_kept(drop_near_copies)),
    ("suffix_dedup", _names_kept(cut_repeats)),
    ("decontamination", _names_kept(drop_contaminated)),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
