"""The registered queries of the text operators; each reads whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import (
    bpe,
    chat,
    compression,
    decontam,
    license_join,
    lzprint,
    manifest,
    packing,
    quality,
    repair,
    simhash,
    suffix_dedup,
    toxicity,
)
from clickloom.llm.common import stored, table


def op1_toxicity(s: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document by a classifier chain."""
    docs = table(s, d, "documents")
    chain = toxicity.fit_chain(docs, table(s, d, "labels"))
    return toxicity.scored(docs, chain, keep=("doc_id",))


def op2_suffix_dedup(s: SparkSession, d: str) -> DataFrame:
    """Bytes of documents that repeat 50 bytes of one with a smaller id."""
    found = suffix_dedup.deduplicated(table(s, d, "documents"), keep=("doc_id",))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_byte_bpe(s: SparkSession, d: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes got back from them."""
    import public_tokenizers

    coded = bpe.encode(
        table(s, d, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        decode=True,
        keep=("doc_id",),
    )
    return coded.select(
        "doc_id",
        "n_tokens",
        bpe.digest("ids").alias("ids_sha256"),
        bpe.digest("decoded").alias("decoded_sha256"),
    )


def op4_quality(s: SparkSession, d: str) -> DataFrame:
    """Quality of every document from its text and its source; a path is a source's language."""
    docs = table(s, d, "documents")
    return quality.classified(
        docs,
        table(s, d, "labels"),
        F.col("source"),
        F.concat_ws("/", "source", "lang"),
        keep=("doc_id", "source"),
    )


def op5_decontamination(s: SparkSession, d: str) -> DataFrame:
    """Words of documents inside windows of benchmark items."""
    found = decontam.contamination(
        table(s, d, "documents"), table(s, d, "benchmark"), keep=("doc_id",)
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_simhash(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints and components of near-duplicates."""
    found = simhash.near_duplicates(table(s, d, "documents"), keep=("doc_id",))
    return found.select(
        "doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id"
    )


def op7_lz_fingerprint(s: SparkSession, d: str) -> DataFrame:
    """Lempel-Ziv fingerprints of texts, edited texts and their neighbours."""
    return lzprint.compare_with_next(table(s, d, "documents"))


def op8_license_scan(s: SparkSession, d: str) -> DataFrame:
    """Licence phrases and labels."""
    return license_join.scan(table(s, d, "documents"))


def op9_sharding(s: SparkSession, d: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes."""
    dealt = packing.shard(table(s, d, "documents"), 16)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op10_chat_format(s: SparkSession, d: str) -> DataFrame:
    """Conversations formatted along their reply trees, read back from the output."""
    probe = s.createDataFrame(
        [
            (-7, 0, "user", "</s>[INST] ok [/INST]"),
            (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(s, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    nodes = stored(chat.reply_nodes(rows))
    written = chat.format_paths(nodes, chat.chosen_paths(nodes, per_tree=1))
    turns = chat.read_turns(F.col("formatted"))
    back = written.select(
        F.col("tree").alias("conv_id"),
        turns.alias("turns"),
        chat.masked_text("segments").alias("loss"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_quality_rules(s: SparkSession, d: str) -> DataFrame:
    """Counts, compression ratio and verdict of every document."""
    return compression.judged(table(s, d, "documents"), keep=("doc_id",))


def op12_merkle_manifest(s: SparkSession, d: str) -> DataFrame:
    """Merkle leaves, roots and proofs of documents, checked against tampered texts."""
    return manifest.verified_documents(table(s, d, "documents"))


def op13_conversation_repair(s: SparkSession, d: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    return repair.repaired(repair.damaged(table(s, d, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_suffix_dedup,
        op3_byte_bpe,
        op4_quality,
        op5_decontamination,
        op6_simhash,
        op7_lz_fingerprint,
        op8_license_scan,
        op9_sharding,
        op10_chat_format,
        op11_quality_rules,
        op12_merkle_manifest,
        op13_conversation_repair,
    )
}
