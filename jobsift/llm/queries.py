"""Registered queries of the subpackage (name → callable(spark, sf_dir))."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, licenses, linededup, maintext, merkle, packing, pii, quality, ranked, simhash, tokencount
from .common import table
from .oracle import ORACLE  # noqa: F401

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents")).select("doc_id", *pii.digest())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_sides(chat.swapped_replies(table(spark, sf_dir, "conversations")))
    return pairs.select(
        *[c for c in pairs.columns if not c.endswith("_mask")],
        chat.mask_text("chosen_mask").alias("chosen_mask"), chat.mask_text("rejected_mask").alias("rejected_mask"),
    )


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document: characters, lines, and a digest of the text."""
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.length(text).cast("long").alias("n_chars"), F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("lang", "source")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.encode(table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode_column("ids", path), 256).alias("decoded_sha256"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), {"tampered": merkle.tampered()})
    checked = merkle.verify(proofs)
    return checked.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole counts, and where to cut for the limit: both from the stored prefix counts."""
    counts = tokencount.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    within = tokencount.longest_within(tokencount.LIMIT)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokencount.LIMIT).alias("over_limit"), within.alias("chars_within_limit"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_packing, op3_preference_chat, op4_main_text, op5_license_scan, op6_line_dedup, op7_exact_dedup, op8_quality,
        op9_simhash_near_dedup, op10_bpe, op11_merkle_manifest, op12_ranked_search, op13_token_counts,
    )
} | {"pipeline": corpus_pipeline.run}
