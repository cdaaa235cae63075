"""Expressions over arrays of a row that take time in proportion to their length, or nearly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded one after another; a fold copies what it has so far, so that arrays are cut into such blocks.
BLOCK = 128
#: Code points of a segment of a text.
SEGMENT = 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def let_sql(value: str, name: str, use: str) -> str:
    """`let` as SQL: use, where name stands for the value."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def prefix_sql(values: str, op: str) -> str:
    """SQL for each place of an array of whole numbers: the fold of those before it, from 0, by op, which has {a} and {x}."""
    none = "cast(array() AS array<int>)"

    def walk(over: str, start: str) -> str:
        step = f"(w, x) -> struct({op.format(a='w.at', x='x')} AS at, concat(w.out, array(w.at)) AS out)"
        return f"aggregate({over}, struct({start} AS at, {none} AS out), {step}, w -> w.out)"

    block = f"slice(v, b * {BLOCK} + 1, {BLOCK})"
    sums = f"transform(sequence(0, cast(floor((size(v) - 1) / {BLOCK}) AS int)), b -> aggregate({block}, 0, (a, x) -> {op.format(a='a', x='x')}))"
    return let_sql(values, "v", f"if(size(v) = 0, {none}, flatten(transform({walk(sums, '0')}, (o, b) -> {walk(block, 'o')})))")


def prefix(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The same of a column of whole numbers."""
    none = F.array().cast("array<int>")
    block = lambda v, b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))

    def walk(v: Column, start: Column) -> Column:
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(v, F.struct(start.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(block(v, b), F.lit(0), lambda a, x: op(a, x)))
        return F.flatten(F.transform(walk(sums, F.lit(0)), lambda start, b: walk(block(v, b), start)))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(blocks(v)))


def tops(values: Column) -> Column:
    """The largest of the first k numbers, at least 0, for k from 0 to all of them."""
    return prefix(F.concat(values, F.array(F.lit(0))), F.greatest)


def ranks(ordered: Column, wanted: Column, equal: bool) -> Column:
    """For each number wanted how many of the numbers `ordered`, an ascending array, are below it, or equal if they count."""
    items = F.transform(ordered, lambda v: F.struct(v.alias("v"), F.lit(1).alias("t"), F.lit(-1).alias("i")))
    asked = F.transform(wanted, lambda v, i: F.struct(v.alias("v"), F.lit(2 if equal else 0).alias("t"), i.alias("i")))

    def counted(merged: Column) -> Column:
        def answers(before: Column) -> Column:
            told = F.transform(merged, lambda m, j: F.struct(m["i"].alias("i"), F.get(before, j).alias("n")))
            return F.transform(F.array_sort(F.filter(told, lambda x: x["i"] >= 0)), lambda x: x["n"])

        return let(prefix(F.transform(merged, lambda m: (m["t"] == 1).cast("int")), lambda a, x: a + x), answers)

    return let(F.array_sort(F.concat(items, asked)), counted)


def segments(text: Column) -> Column:
    """The text in pieces of SEGMENT code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}+"), F.lit(0))


def piece(cut: Column, start: Column, stop: Column) -> Column:
    """The code points from start to below stop of a text that `segments` cut; empty if there are none."""

    def inside(k: Column) -> Column:
        low = F.greatest(start - k * SEGMENT, F.lit(0))
        return F.substring(F.get(cut, k), low + 1, F.least(stop - k * SEGMENT, F.lit(SEGMENT)) - low)  # type: ignore[arg-type]

    at = lambda c: F.floor(c / SEGMENT).cast("int")
    return F.when(stop > start, F.array_join(F.transform(F.sequence(at(start), at(stop - 1)), inside), "")).otherwise(F.lit(""))
