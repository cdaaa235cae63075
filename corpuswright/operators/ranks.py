"""Ranks and running sums over an order, without one task for all rows.

Rows are cut into ranges of their order; each range is ranked or summed alone, and the ranges' totals, of which there is
one row each, give every range its start. Only that small table meets in one task (or one for each key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a whole-number order that make up a range.
RANGE = 1 << 16


#: Rows of a range that one task should rank, at most.
ROWS = 1 << 20


def fitting_span(df: DataFrame, order: str, keys: tuple[str, ...] = (), span: int = RANGE, rows: int = ROWS) -> int:
    """The largest span of span, span / 2, ... by which no range within keys has over `rows` rows; 1 if ties alone do."""
    while span > 1:
        sizes = df.groupBy(*keys, F.floor(F.col(order) / span)).agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= rows:
            break
        span = max(1, span >> max(1, (-(-most // rows) - 1).bit_length()))
    return span


def running(df: DataFrame, order: str, value: Column, name: str, keys: tuple[str, ...] = (), span: int = RANGE, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`: the sum of value over the rows before, in the order of a whole number (and then `ties`) within keys.

    With value 1 this is the rank from 0. Null orders come first.
    """
    cut = F.floor(F.col(order) / span).cast("long")
    held = df.withColumn("_range", F.coalesce(cut, F.lit(-(2**62)))).withColumn("_value", value.cast("long"))
    totals = held.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.sum("_value").over(Window.partitionBy(*keys, "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1))
    local = held.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    on = local["_range"] == starts["_r"]
    for k in keys:
        on &= local[k].eqNullSafe(starts[f"_k_{k}"])
    return local.join(starts, on).withColumn(name, F.col("_start") + F.col("_inside")).select(*df.columns, name)


def ranked(df: DataFrame, order: str, name: str, keys: tuple[str, ...] = (), span: int = RANGE, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`: the rank from 0 in the order within keys."""
    return running(df, order, F.lit(1), name, keys, span, ties)
