"""One query per operator over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, merkle_manifest, mixing, ngram_join, quality_rules, sharding, simhash_dedup, sql, suffix_dedup, token_alignment, token_counts, url_reputation, window_dedup
from .frames import table

#: Files of the public tokenizers, found by each task on its own machine.
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def __getattr__(name: str) -> str:
    """TOKENIZER is the path of the first one on this machine, looked up only when asked for."""
    if name == "TOKENIZER":
        return token_alignment.file_of(BYTE_BPE)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def op1_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is the label with its number: bad if of low quality or toxic."""
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_reputation.judge(table(spark, folder, "pages"), outcomes)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).drop("n_repeats")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), BYTE_BPE)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.link(table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(table(spark, folder, "documents"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op9_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.near_duplicate_passages(table(spark, folder, "documents"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose number's CRC is a multiple of 7 are claimed to be one character longer; their proofs fail."""
    docs = table(spark, folder, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    longer = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claimed = merkle_manifest.leaf_hash([longer if f == "n_chars" else F.col(f) for f in merkle_manifest.FIELDS])
    proofs = merkle_manifest.manifest(docs, carry={"claimed": claimed})
    folded = merkle_manifest.fold(F.col("claimed"), F.col("path"), F.col("place"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", merkle_manifest.path_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align(table(spark, folder, "documents"), BYTE_BPE, PIECES)


def op13_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_reputation,
        op2_quality_rules,
        op3_token_counts,
        op4_decontamination,
        op5_simhash_dedup,
        op6_mixing,
        op7_line_dedup,
        op8_sharding,
        op9_window_dedup,
        op10_suffix_dedup,
        op11_merkle_manifest,
        op12_token_alignment,
        op13_ngram_join,
    )
}

SQL: dict[str, str] = {"op1_url_reputation": sql.OP1, "op2_quality_rules": sql.OP2, "op6_mixing": sql.OP6, "op8_sharding": sql.OP8, "op11_merkle_manifest": sql.OP11}
