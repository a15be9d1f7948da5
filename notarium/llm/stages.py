"""Pipeline stages: (spark, docs, folder) -> documents, each by one operator of this package.

Every stage but the last returns the columns that it was given, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.llm import language_id as languages
from notarium.llm import ngram_join as join
from notarium.llm import packing as packs
from notarium.llm import quality_rules as rules
from notarium.llm import suffix_dedup as suffixes
from notarium.llm.memory import small_batches
from notarium.llm.queries import held_out, table, word_vocabulary


def _others(docs: DataFrame) -> tuple[str, ...]:
    """All columns but the text, which operators hand through by themselves."""
    return tuple(c for c in docs.columns if c != "text")


def _carried(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*((F.col("text") if c == "text" else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or far from every language, go.

    The model is fitted on the given documents with a language, without the held-out third.
    """
    small_batches(spark)
    model = languages.fit(docs.filter(~held_out()))
    rows = languages.predict(docs, model, carry=_others(docs))
    return _carried(docs, rows.filter("NOT rejected"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the ratio."""
    rows = rules.quality(docs, table(spark, sf_dir, "labels"), carry=tuple(docs.columns))
    return rows.filter("kept").select(*(F.col(f"carried.`{c}`").alias(c) for c in docs.columns))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id."""
    small_batches(spark)
    return join.first_documents(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings that earlier documents hold; ``n_chars`` follows.

    Bytes of a character that a cut runs through go too.  A document of which nothing is left
    goes; one that was null or empty before stays as it was.
    """
    small_batches(spark)
    rows = suffixes.remove_repeats(docs, carry=_others(docs)).filter("n_removed = 0 OR n_removed < n_bytes")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("carried.n_chars"))
    return _carried(docs, rows.withColumn("carried", F.col("carried").withField("n_chars", n_chars)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences."""
    small_batches(spark)
    return packs.pack(docs, word_vocabulary()).drop("tokens", "part")
