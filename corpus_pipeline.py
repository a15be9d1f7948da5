"""Documents to packed training sequences: the stages in order, each over what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notarium.llm import stages
from notarium.session import materialise

STAGES = [
    ("language_id", stages.language_id),
    ("quality_rules", stages.quality_rules),
    ("ngram_join", stages.ngram_join),
    ("suffix_dedup", stages.suffix_dedup),
    ("packing", stages.packing),
]

# The language model, the log-likelihood ratio and the tokenizer can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of all documents that pass every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
