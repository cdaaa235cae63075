"""Statistics of a store, derived from its records and from what was served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 25
#: Bytes of a record besides its tokens.
RECORD_BYTES = 9


def category_stats(names: DataFrame, records: DataFrame, served: DataFrame) -> DataFrame:
    """Each category's stored and served samples and tokens, zeros where there are none."""
    stored = records.groupBy("category_id").agg(F.count(F.lit(1)).alias("sample_count"), F.sum("token_count").cast("long").alias("token_count"))
    out = served.groupBy("category_id").agg(F.count(F.lit(1)).alias("served_count"), F.sum("token_count").cast("long").alias("served_token_count"))
    found = names.join(stored, "category_id", "left").join(out, "category_id", "left")
    return found.select("category_id", "category", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sample_count", "token_count", "served_count", "served_token_count")])


def totals(stats: DataFrame) -> DataFrame:
    """One row: samples, tokens, categories, tokens served, and the log's size in bytes (current_file_index).

    A record has RECORD_BYTES and two for each token, so the sums give the size too.
    """
    sums = stats.agg(
        F.coalesce(F.sum("sample_count"), F.lit(0)).alias("total_samples"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"),
        F.count(F.lit(1)).alias("n_categories"),
        F.coalesce(F.sum("served_token_count"), F.lit(0)).alias("total_served_tokens"),
    )
    return sums.withColumn("current_file_index", RECORD_BYTES * F.col("total_samples") + 2 * F.col("total_tokens"))


def served_maps(stats: DataFrame) -> DataFrame:
    """Categories that were served at all."""
    return stats.where("served_count > 0 OR served_token_count > 0").select("category", "served_count", "served_token_count")


def top(stats: DataFrame, by: str, n: int = TOP) -> DataFrame:
    """The n categories with most of `by`, ties by name."""
    return stats.orderBy(F.desc(by), "category").limit(n)


def listed(stats: DataFrame, by: str = "token_count", descending: bool | None = None, holding: str = "") -> DataFrame:
    """stats sorted for the table: names up, numbers down unless told otherwise; only names that hold a string, in any case."""
    down = by != "category" if descending is None else descending
    key: Column = F.lower("category") if by == "category" else F.col(by)
    rows = stats.where(F.lower("category").contains(holding.lower())) if holding else stats
    return rows.orderBy(key.desc() if down else key.asc(), "category")
