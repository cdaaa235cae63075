"""The category dictionary: ids from 1 in the order of first appearance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuswright.schemas import CODE_LANGUAGES, MAX_CATEGORIES, OTHER

CODE_NAMES = (*CODE_LANGUAGES, OTHER)


def dictionary(rows: DataFrame, most: int = MAX_CATEGORIES) -> DataFrame:
    """category and category_id of rows (ordinal, category); an error if there are more categories than ids.

    Names are aggregated first, and of those only the first most + 1 are ranked; null counts as the empty name.
    """
    first = rows.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.min("ordinal").alias("first"))
    ids = first.orderBy("first", "category").limit(most + 1).withColumn("category_id", F.row_number().over(Window.orderBy("first", "category")))
    limit = F.when(F.col("category_id") > most, F.raise_error(F.lit(f"more than {most} categories")).cast("int")).otherwise(F.col("category_id"))
    return ids.select("category", limit.cast("int").alias("category_id"))


def encoded(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with the category's id. The dictionary has at most MAX_CATEGORIES rows, so it is broadcast."""
    to = names.select(F.col("category").alias("_name"), "category_id")
    return rows.join(F.broadcast(to), F.coalesce("category", F.lit("")) == F.col("_name")).drop("_name")


def index(names: DataFrame) -> DataFrame:
    """One row with the map from name to id."""
    pairs = F.array_sort(F.collect_list(F.struct("category", "category_id")))
    return names.agg(F.map_from_entries(pairs).alias("category_index"))


def code_ids(names: DataFrame, code: Iterable[str] = CODE_NAMES) -> DataFrame:
    """category_id of the categories that hold code."""
    return names.where(F.col("category").isin(list(code))).select("category_id")
