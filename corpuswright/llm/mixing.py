"""Mixing sources to target weights by Pfair scheduling: the schedule is made from the sources' sizes, rows are placed by expressions."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, columns_of, salt_of, salted, table

#: Rows of a block; slots of a `shares` period.
BLOCK, PERIOD = 64, 1024
#: Rows that a ranking task gets, about.
STREAM = 8192
#: Consecutive blocks of a lane that the look-up of slots keeps together; blocks that the driver holds at once.
TOGETHER, HELD = 128, 1 << 20
#: Without given weights a source's weight is its number of rows to this power.
TEMPER = 0.5


def shares(weights: list[float], period: int) -> list[int]:
    """Whole slots of a period for each weight, at least one each, by largest remainders."""
    if len(weights) > period:
        raise ValueError("more lanes than slots")
    if not weights:
        return []
    total = sum(weights)
    spare = period - len(weights)
    exact = [max(0.0, w / total * period - 1) for w in weights]
    scale = spare / sum(exact) if sum(exact) else 0.0
    slots = [1 + int(x * scale) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (int(exact[i] * scale) - exact[i] * scale, i))
    for i in range(period - sum(slots)):
        slots[order[i % len(order)]] += 1
    return slots


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*[x.denominator for x in exact])
    return [int(x * scale) for x in exact]


def schedule(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, lane, block, release, deadline) of all blocks by slot, earliest deadline first over the whole horizon.

    Block j of a lane with a of q parts is released at floor(j q / a) and due by ceil((j + 1) q / a), in whole numbers, so
    nothing adds up over the horizon. The parts sum to q, so the schedule is feasible on one processor, and earliest
    deadline first among the released finds it; while no lane has run out, a lane's blocks so far differ from its share
    of the slots so far by less than one. Slots in which nothing is released stay empty and cost no step.
    """
    q = sum(weights)
    waiting = [(0, lane) for lane, n in enumerate(blocks) if n]  # by release
    ready: list[tuple[int, int]] = []  # by deadline
    done = array("q", bytes(8 * len(blocks)))
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            lane = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[lane] + 1) * q // weights[lane]), lane))
        deadline, lane = heapq.heappop(ready)
        assert t < deadline
        j = done[lane]
        yield t, lane, j, j * q // weights[lane], deadline
        done[lane] = j + 1
        if j + 1 < blocks[lane]:
            heapq.heappush(waiting, ((j + 1) * q // weights[lane], lane))
        t += 1


def timetable(slots: list[int]) -> list[list[int]]:
    """For each lane the slots of its blocks in a period of sum(slots): the `schedule` of as many blocks as slots."""
    out: list[list[int]] = [[] for _ in slots]
    for t, lane, *_ in schedule(slots, slots):
        out[lane].append(t)
    return out


def _lanes(docs: DataFrame, weights: dict[str, float] | None) -> list[tuple[str | None, int, float]]:
    """(source, rows, weight) of each lane, the rest lane last with source None."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    named = sizes.where(F.col("source").isNotNull())
    if weights is not None:
        if any(w <= 0 for w in weights.values()):
            raise ValueError("weights are positive")
        named = named.where(F.col("source").isin(list(weights)))
    rows = named.toArrow().sort_by("source")  # as many as there are lanes
    found = zip(rows["source"].to_pylist(), rows["n"].to_pylist(), strict=True)
    lanes = [(name, n, weights[name] if weights else n**TEMPER) for name, n in found]
    left = total - sum(n for _, n, _ in lanes)
    return lanes + ([(None, left, min([w for *_, w in lanes], default=1.0) if weights else left**TEMPER)] if left else [])


def _slots(spark: SparkSession, lanes: list[tuple[str | None, int, float]], block: int) -> DataFrame:
    """_lane, _g and _t: for TOGETHER consecutive blocks of a lane their (slot, release, deadline)."""
    names = ["_slot", "_lane", "_block", "_release", "_deadline"]
    parts: list[DataFrame] = []
    held: list[array] = [array("q") for _ in names]

    def put() -> None:
        part = spark.createDataFrame(pa.table({n: pa.array(memoryview(x), pa.int64()) for n, x in zip(names, held, strict=True)}))
        parts.append(part if not parts and len(held[0]) < HELD else table(part, "slots"))
        for x in held:
            del x[:]

    for row in schedule(whole([w for *_, w in lanes]), [-(-n // block) for _, n, _ in lanes]):
        for x, v in zip(held, row, strict=True):
            x.append(v)
        if len(held[0]) == HELD:
            put()
    if held[0] or not parts:
        put()
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    times = F.sort_array(F.collect_list(F.struct("_block", "_slot", "_release", "_deadline")))
    return rows.groupBy(F.col("_lane").cast("int").alias("_lane"), F.floor(F.col("_block") / TOGETHER).cast("long").alias("_g")).agg(times.alias("_t"))


def _scheduled(docs: DataFrame, weights: dict[str, float] | None, block: int) -> tuple[DataFrame, dict[str, Column]]:
    """docs' rows, each as one struct _row, with the columns that place them, and lane, block, place, slot, release, deadline."""
    columns_of(docs, ["doc_id", "source"], "mixing")
    lanes = _lanes(docs, weights)
    spark = docs.sparkSession
    times = _slots(spark, lanes, block)
    columns = {
        "_lane": pa.array(range(len(lanes)), pa.int32()),
        "_source": pa.array([name for name, *_ in lanes], pa.string()),
        "_k": pa.array([max(1, -(-n // STREAM)) for _, n, _ in lanes], pa.int64()),
    }
    known = spark.createDataFrame(pa.table(columns))
    rest = next((i for i, (name, *_) in enumerate(lanes) if name is None), 0)
    rest_k = lanes[rest][1] // STREAM + 1 if lanes else 1

    first = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    names = salted(known.where(F.col("_source").isNotNull()))

    def streamed(rows: DataFrame) -> DataFrame:
        """rows (_from, _u) with their lane, its number of streams and the stream _s."""
        found = rows.withColumn("_salt", salt_of(F.col("_u"), n=SALTS)).join(names.withColumnRenamed("_source", "_from"), ["_from", "_salt"], "left")
        found = found.withColumns({"_lane": F.coalesce("_lane", F.lit(rest)), "_k": F.coalesce("_k", F.lit(rest_k).cast("long"))}).drop("_from", "_salt")
        return found.withColumn("_s", F.shiftright(F.col("_u") * F.col("_k"), 32))

    source = F.col("source").cast("string").alias("_from")
    placed = streamed(docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), source, first.alias("_u")))
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_lane", "_s").orderBy("_u", "_id")) - 1)
    sizes = streamed(docs.select(source, first.alias("_u"))).groupBy("_lane", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_lane").orderBy("_s")) - F.col("_n"))
    groups = F.sequence(F.floor(F.col("_before") / (block * TOGETHER)), F.floor((F.col("_before") + F.col("_n") - 1) / (block * TOGETHER)))
    parts = before.withColumn("_g", F.explode(groups)).join(times, ["_lane", "_g"])
    starts = parts.groupBy("_lane", "_s").agg(F.first("_before").alias("_before"), F.min("_g").alias("_least"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_g", "_t"))), lambda x: x["_t"])).alias("_t"))
    found = ranked.join(starts, ["_lane", "_s"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    found = found.withColumn("_block", F.floor(F.col("_rank") / block).cast("long"))
    at = F.get("_t", (F.col("_block") - F.col("_least") * TOGETHER).cast("int"))
    out = {
        "lane": F.col("_lane"),
        "block": F.col("_block"),
        "place": F.pmod(F.col("_rank"), F.lit(block)).cast("int"),
        "slot": at["_slot"],
        "release": at["_release"],
        "deadline": at["_deadline"],
    }
    return found, out


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, prefix: str = "") -> DataFrame:
    """docs with lane, block, place, slot, release and deadline, each name after `prefix`; no row is left out.

    A lane is a source, of which there may be any number; the null source, and where weights are given all sources without
    one, share the rest lane. Within a lane rows are put in the order of a hash of doc_id and cut into blocks; the place is
    the row's in its block. Blocks get slots of the `schedule` by the exact weights over the whole horizon; only when a
    lane runs out do its slots stay empty, so `period` has no effect. The order (slot, place) is the mix: while no
    lane has run out, each lane's number of blocks in the first t slots differs from its target by less than one. Without
    weights a source weighs its number of rows to the power TEMPER.

    A lane may hold any part of all rows: its rows are ranked in streams of about STREAM by ranges of the hash, and
    the streams' sizes, summed up, give each stream its first rank and its blocks' slots. The driver holds the sources
    and steps through the blocks, HELD of them at once. Null doc_ids rank by an empty id; rows with equal ids stand
    together, in any order. A column of docs that has the name of one of the schedule's gives way to it. An empty table gives
    none.
    """
    found, out = _scheduled(docs, weights, block)
    taken = {(prefix + name).lower() for name in out}
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in taken]
    return found.select(*own, *[c.alias(prefix + name) for name, c in out.items()])


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """docs in the order of the mix, with its own columns and all rows: consecutive files hold consecutive slots."""
    found, out = _scheduled(docs, weights, block)
    placed = found.select("_row", out["slot"].alias("_slot"), out["place"].alias("_place"))
    return placed.orderBy("_slot", "_place").select("_row.*")
