"""The corpus pipeline: quality rules, near-duplicate join, secret scan, source mix, encoding.

``STAGES`` are (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. All stages but the
last return the columns of ``documents``.

Defined results, of every stage: null texts are empty texts; rows without id are documents like the
others; an empty table gives an empty table; ``documents`` may have further columns, whose names do
not begin with an underscore. Repeated rows are copies, of which the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictflow.llm import jaccard_join, piece_tokenizer, quality_rules, secret_scan, source_mix
from verdictflow.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs."""
    return quality_rules.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the characters of every secret replaced by as many ``*``."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Document copies in training order, sources mixed to their target weights."""
    return source_mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every copy: doc_id, n_tokens, ids, and whether they decode to its text again."""
    return piece_tokenizer.round_trips(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix),
          ("sentencepiece", encode)]

#: Encoding has no SQL; the pipeline is tested against a plain Python version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
