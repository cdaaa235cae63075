"""Serving records: in order with wrap-around, or at random; how often each category was served."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuswright.functions.draws import SPAN, draw
from corpuswright.schemas import DEFAULT_SAMPLES

from .ranks import RANGE, ranked


@dataclass(frozen=True)
class Cursor:
    """Where sequential serving goes on: a position among the records."""

    position: int = 0

    def reset(self) -> Cursor:
        return Cursor()


def _count(wanted: int) -> int:
    return wanted if wanted > 0 else DEFAULT_SAMPLES


def next_samples(records: DataFrame, cursor: Cursor = Cursor(), wanted: int = 0, span: int = RANGE) -> tuple[DataFrame, Cursor]:
    """`wanted` records from the cursor on, with slot and position, and the cursor after them.

    At the end serving starts over, as often as it takes. Without records there are no samples. Records with a column
    position (from 0 in the order of ordinals, see `store.write`) aren't ranked again: the one or two ranges of positions
    that are served are a filter on the scan.
    """
    wanted = _count(wanted)
    placed = records if "position" in records.columns else ranked(records, "ordinal", "position", span=span)
    n = records.count()
    if not n:
        return placed.withColumn("slot", F.lit(0).cast("long")).limit(0), cursor
    start, position = cursor.position % n, F.col("position")
    if wanted < n:
        served = (position >= start) & (position < start + wanted)
        placed = placed.where(served | (position < start + wanted - n) if start + wanted > n else served)
    slots = records.sparkSession.range(wanted).select(F.col("id").alias("slot"), F.pmod(F.col("id") + cursor.position, F.lit(n)).alias("position"))
    return slots.join(placed, "position"), Cursor((cursor.position + wanted) % n)


def at_or_after(points: DataFrame, ids: DataFrame, most: int, span: int = RANGE) -> DataFrame:
    """slot and id of each of points (slot, at): the least of ids (id), whole numbers from 0 to most, that is at or after.

    Ids are cut into ranges of span, and only ranges with points are sorted; a point beyond the last id of its range takes
    the first id of the next range that has one, which is found in the same way among the ranges. So gaps of any width
    cost nothing, and no task gets more than a range of ids and the points there.
    """
    cut = lambda c: F.floor(F.col(c) / span).cast("long").alias("_range")
    at, held = points.select("slot", "at", cut("at")), ids.select("id", cut("id"))
    here = held.join(at.select("_range").distinct(), "_range", "left_semi")
    none = F.lit(None).cast("long")
    both = at.select("_range", F.col("at").alias("_v"), "slot", none.alias("id")).unionByName(here.select("_range", F.col("id").alias("_v"), none.alias("slot"), "id"))
    # from the end: an id comes before the points at it and below it
    w = Window.partitionBy("_range").orderBy(F.desc("_v"), F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("id", F.last("id", ignorenulls=True).over(w)).where("slot IS NOT NULL").select("slot", "id", "_range")
    found = met.where("id IS NOT NULL").select("slot", "id")
    if most < span:
        return found
    heads = held.groupBy("_range").agg(F.min("id").alias("_head"))
    later = at_or_after(met.where("id IS NULL").select("slot", (F.col("_range") + 1).alias("at")), heads.select(F.col("_range").alias("id")), most // span, span)
    return found.unionByName(later.select("slot", F.col("id").alias("_range")).join(heads, "_range").select("slot", F.col("_head").alias("id")))


def random_samples(records: DataFrame, wanted: int = 0, seed: int = 0, span: int = RANGE) -> DataFrame:
    """`wanted` draws with replacement: slot, and the record of the first id at or after the number drawn.

    Numbers are even over 1 to the largest id (records: record_id); the id after a gap, however wide, is drawn the more
    often. Ids aren't below 1, and rows without one are never drawn.
    """
    wanted = _count(wanted)
    ids = records.where("record_id >= 1")
    most = ids.agg(F.coalesce(F.max("record_id"), F.lit(0)).alias("n")).first()["n"]
    if not most:
        return records.withColumns({"slot": F.lit(0).cast("long"), "drawn": F.lit(0).cast("long")}).limit(0)
    number = draw(F.col("id"), str(seed))
    if most > SPAN:
        number = F.shiftright(draw(F.col("id"), f"{seed}:low"), 1) + number * (SPAN >> 1)
    drawn = records.sparkSession.range(wanted).select(F.col("id").alias("slot"), (1 + F.pmod(number, F.lit(most))).alias("drawn"))
    found = at_or_after(drawn.select("slot", F.col("drawn").alias("at")), ids.select(F.col("record_id").cast("long").alias("id")), most, span)
    return drawn.join(found.withColumnRenamed("id", "record_id"), "slot").join(records, "record_id")


def served_counts(served: DataFrame) -> DataFrame:
    """category, served_count and served_token_count of served records; recomputed, so nothing is updated in place."""
    return served.groupBy("category").agg(F.count(F.lit(1)).alias("served_count"), F.sum("token_count").cast("long").alias("served_token_count"))
