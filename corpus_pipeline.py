"""From raw documents to packed sequences: quality rules, line dedup, SimHash
near-dedup, PII, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a table that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobsift.llm import linededup, packing, pii, quality, simhash
from jobsift.llm.common import Staged, prepare, table

TOKENIZER = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    prepare(spark)
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar lines one stays; texts and n_chars follow."""
    prepare(spark)
    return linededup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    prepare(spark)
    return pii.redact_table(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: No SQL: MinHash, XXH64 fingerprints and a tokenizer's ids aren't DuckDB's.  tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's result is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    kept = Staged(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        stored = kept.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            kept.drop(before)
        docs = before = stored
    return STAGES[-1][1](spark, docs, sf_dir)
