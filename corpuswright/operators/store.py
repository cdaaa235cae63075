"""The record store: rows to token records with ordinals and offsets, statistics derived and never kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.codec import record_bytes
from corpuswright.functions.tokenizers import Tokenizer

from . import catalog, dedup
from .ranks import RANGE, ranked, running


def ingest(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Token records of rows (ordinal, text, category): ordinal, category, category_id, content_hash, token_count, tokens.

    Copies go before anything is tokenised and before categories are numbered, so a copy adds no category.
    """
    kept = dedup.first_arrivals(rows.select("ordinal", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("category", F.lit("")).alias("category")))
    coded = catalog.encoded(dedup.hashed(kept), catalog.dictionary(kept))
    tokens = coded.withColumn("tokens", tokenizer.tokenize(F.col("text")))
    return tokens.select("ordinal", "category", "category_id", "content_hash", F.size("tokens").alias("token_count"), "tokens")


def with_offsets(records: DataFrame, span: int = RANGE) -> DataFrame:
    """records with file_offset: the bytes of all records before, in the order of their ordinals."""
    return running(records, "ordinal", record_bytes(F.col("token_count")), "file_offset", span=span)


def write(records: DataFrame, path: str, span: int = RANGE) -> None:
    """Writes a whole store: records with their position (the rank of their ordinal, from 0) and file_offset, in that order
    over the files, so that a range of positions or offsets is read from few of them. A table that is there is replaced."""
    placed = with_offsets(ranked(records, "ordinal", "position", span=span), span)
    placed.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").parquet(path)


def append(records: DataFrame, path: str) -> None:
    """Adds records to the store at path; a batch becomes visible as a whole."""
    records.write.mode("append").parquet(path)


def opened(spark, path: str, like: DataFrame) -> DataFrame:
    """The store at path; an empty one if there is none yet. Columns of `like` that its files lack are null, so a store that
    was written before a column was added still opens; a column of another type is an error that names it."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    if not there:
        return like.limit(0)
    kinds = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    if other := [f.name for f in like.schema.fields if f.name in kinds and kinds[f.name] != f.dataType]:
        raise ValueError(f"the store at {path} has other types in {other}")
    return spark.read.schema(like.schema).parquet(path)
