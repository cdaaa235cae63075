"""A corpus pipeline: language ID, exact and near deduplication, mixing to target weights, and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and extra ones of any name with them. An empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuswright.llm import common, exact_dedup, language_id, mixing, near_dedup, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that are rejected go.

    Null and empty texts, and such without a letter, go. Without any label to learn from, as in an empty table, all stay.
    Rows that repeat are judged alike; very long texts are scored whole, in parts of bounded size.
    """
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest doc_id.

    Null text equals empty text. A null doc_id comes after all others; of rows that repeat a doc_id and text one stays.
    """
    return exact_dedup.exact_dedup(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Documents without words have no copies, and all stay, as do rows without a doc_id; rows that repeat a doc_id share its
    fate. Very long texts are compared whole.
    """
    return near_dedup.near_dedup(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: consecutive files, and so the packer's tasks, hold consecutive slots.

    A null source is a source of its own; null doc_ids and repeated rows have places like all others.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 1024 tokens.

    Null text is empty and takes one token, its end. Each row is packed, also if its doc_id is null or repeats.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The tokenizer, the language models and near-duplicate groups can't be put in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a table in the shared folder, removed when the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.table(stage(spark, docs, sf_dir), name)
        common.remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
