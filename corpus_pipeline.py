"""Documents to packed training sequences: five stages, each written as Parquet and reread as the next one's documents.

Every stage takes whole texts of any length, null ones as empty, null doc_ids, repeated rows, empty tables and
further columns of any names; what it does with them, its operator's docstring says in full.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corestrata.llm import exact, packing, quality, secrets, simhash
from corestrata.llm.common import read, scratch, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; nulls and empty texts are scored like others, repeated rows share their fate, and without trusted labels all stay."""
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the one of the largest doc_id stays; of rows that repeat it too, one; null texts equal empty ones; a null doc_id stays only where its text has no other."""
    return exact.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are near copies (SimHash over five words, confirmed at a Jaccard similarity of 0.8 or more) the one of the smallest doc_id stays, a null one only if there is no other; texts without words are alike."""
    return simhash.drop_near_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; every row stays, null texts null, with n_chars as it then is."""
    from pyspark.sql import functions as F

    clean = secrets.redact_secrets(docs)
    return clean.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in clean.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, over all rows that are left; an empty or null text is its end mark alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    base = scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{base}/{name}")
    return docs
