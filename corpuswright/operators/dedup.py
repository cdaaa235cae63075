"""Exact deduplication by content hash, first arrival first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of a row without an ordinal: after all others.
LAST = 2**63 - 1
#: Hashes that are broadcast, at most, to find them in a store: some 100 MB.
BROADCAST_ROWS = 1_000_000


def content_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text's bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def hashed(rows: DataFrame) -> DataFrame:
    """rows (text) with content_hash."""
    return rows.withColumn("content_hash", content_hash(F.col("text")))


def first_arrivals(rows: DataFrame) -> DataFrame:
    """rows (ordinal, text) without later copies: of equal texts the one of the smallest ordinal stays.

    Null ordinals come last; of copies with the same ordinal one stays. Hashes are aggregated before the shuffle, so no
    task gets all copies of a text; whole rows move once, to meet the ordinals that stay.
    """
    order = F.coalesce(F.col("ordinal").cast("long"), F.lit(LAST))
    keyed = rows.withColumns({"__hash": F.unhex(content_hash(F.col("text"))), "__order": order})
    keep = keyed.groupBy("__hash").agg(F.min("__order").alias("__order"))
    return keyed.join(keep, ["__hash", "__order"], "left_semi").dropDuplicates(["__hash", "__order"]).select(*rows.columns)


def against_store(rows: DataFrame, store: DataFrame, most: int | None = None) -> DataFrame:
    """rows whose content_hash isn't in the store.

    If the caller knows that rows are at most `most`, and that is no more than BROADCAST_ROWS, their hashes are broadcast
    and the store is only scanned for them; else both meet by hash.
    """
    held = store.select("content_hash")
    if most is not None and most <= BROADCAST_ROWS:
        held = held.join(F.broadcast(rows.select("content_hash").distinct()), "content_hash", "left_semi")
    return rows.join(held.distinct(), "content_hash", "left_anti")


def ingest_response(rows: DataFrame, stored: DataFrame, vocabulary: int) -> DataFrame:
    """One answer per row: duplicate, and the tokens stored for it (0 for a duplicate)."""
    kept = stored.select("ordinal", F.col("token_count").alias("_n"))
    found = rows.select("ordinal").join(kept, "ordinal", "left")
    return found.select("ordinal", F.lit(vocabulary).cast("long").alias("tokenizer_vocab_size"), F.coalesce("_n", F.lit(0)).cast("long").alias("token_count"), F.col("_n").isNull().alias("duplicate"))
