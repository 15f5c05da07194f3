"""The corpus pipeline: language ID, near-duplicate removal, sanitising, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecairn.llm import bm25_packing, gru_language, hyperminhash, mixing, sanitize
from filecairn.plans.cut import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    kept = gru_language.identify(docs, carry=COLUMNS).filter(F.col("lang_pred") != gru_language.UNKNOWN)
    return kept.select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; rows are known by id and whole text."""
    return hyperminhash.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it replaced in the text."""
    return sanitize.sanitized(docs.select(*COLUMNS)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the target weights of their sources ask for, row by row."""
    return mixing.emit(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return bm25_packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

# Trained models, exact signatures and a tokenizer: no SQL expresses these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
