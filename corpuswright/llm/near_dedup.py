"""Near-duplicate detection by HyperMinHash registers, banding, and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components
from .common import columns_of, looked_up, remove, table, text_of
from .shingles import batches, mix, names, sets

#: Bands of ROWS registers: at a similarity of exactly 0.8 a pair shares no band with probability (1 - 0.8^6)^40 = 5e-6.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: A register is one byte: five bits of leading zeros and three of the mantissa after the leading one.
ZEROS, MANTISSA = 31, 3
#: Pairs whose estimate is this far below the threshold aren't confirmed. By Chernoff's bound for 240 registers a pair at
#: the threshold of 0.8 lies there with probability under 1e-8, far less than the bands' own.
MARGIN = 0.17
#: Buckets of up to so many members give all their pairs; larger ones are worked off by pivots and blocks.
SMALL = 16
#: Members of a block, about, and bytes of their full sets.
BLOCK, BYTES = 1000, 16 << 20
SETS = "doc_id long, n_shingles long, digest binary, registers binary"


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
    return (seeds[:REGISTERS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[REGISTERS:] >> np.uint64(32)).astype(np.uint32)


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of registers for each set of hashes (set i from at[i] to at[i + 1]); zeros for empty sets.

    Register j sees every shingle under its own permutation, rather than only the shingles dealt to it: short texts
    would leave most of them empty. It keeps the least value's leading zeros and the first bits after the leading one.
    """
    out = np.zeros((len(at) - 1, REGISTERS), np.uint8)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    x, starts = (hashes >> np.uint64(32)).astype(np.uint32), at[:-1][full]
    least = np.empty((len(full), REGISTERS), np.uint32)
    buffer = np.empty_like(x)
    for j, (a, b) in enumerate(zip(*_permutations(), strict=True)):
        np.multiply(x, a, out=buffer)
        buffer += b
        least[:, j] = np.minimum.reduceat(buffer, starts)
    part, power = np.frexp(least.astype(np.float64))  # value = part * 2^power, part from 0.5; 0 gives power 0
    zeros = np.minimum(32 - power, ZEROS)
    mantissa = np.maximum((part * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint8)
    out[full] = (zeros << MANTISSA).astype(np.uint8) + mantissa
    return out


def _cells() -> tuple[np.ndarray, np.ndarray]:
    zeros, mantissa = np.meshgrid(np.arange(1, ZEROS + 2), np.arange(1 << MANTISSA), indexing="ij")
    low = 2.0 ** -zeros * (1 + mantissa / (1 << MANTISSA))
    return low.ravel(), (low + 2.0 ** -zeros / (1 << MANTISSA)).ravel()


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that a register of two disjoint sets of n and m shingles agrees: the sum over its cells of the
    products of the chances that either least value lies there. Sizes count by quarter powers of two."""
    low, high = _cells()
    steps = np.round(4 * np.log2(np.maximum(np.c_[n, m], 1))).astype(int)
    kinds, which = np.unique(steps, axis=0, return_inverse=True)
    size = 2.0 ** (kinds / 4)
    inside = [(1 - low) ** s[:, None] - (1 - np.minimum(high, 1)) ** s[:, None] for s in size.T]
    return (inside[0] * inside[1]).sum(axis=1)[which.ravel()]


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two blocks of registers, corrected for chance agreement."""
    same = (a == b).mean(axis=1)
    by_chance = np.minimum(chance(n, m), 0.9)
    return (same - by_chance) / (1 - by_chance)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set, and registers, for each row of docs."""

    def sign(found: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in found:
            for first, bodies in batches(batch.column(1)):
                hashes, at = sets(bodies, words)
                rows = np.ascontiguousarray(registers(hashes, at))
                ends = (np.arange(len(bodies) + 1) * REGISTERS).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(bodies), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
                ids = batch.column(0).slice(first, len(bodies))
                digests = pa.array(names(bodies, hashes, at, words), pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), digests, held], [x.split()[0] for x in SETS.split(", ")])

    rows = columns_of(docs, ["doc_id", "text"], "near-duplicate detection").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(sign, SETS)


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose estimate is near it or above: a, b, estimate."""
    for end in ("a", "b"):
        side = classes.select(F.col("rep").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("registers").alias(f"r_{end}"))
        pairs = pairs.join(side, end)
    near = pairs.where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))

    def judge(found: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in found:
            if not batch.num_rows:
                continue
            block = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("r_a", "r_b")]
            guess = estimate(*block, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            keep = pa.array(guess >= least - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(guess)], ["a", "b", "estimate"]).filter(keep)

    return near.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(judge, "a long, b long, estimate double")


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and its sorted distinct shingle hashes, for the nodes given."""

    def whole(found: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in found:
            for first, bodies in batches(batch.column(1)):
                hashes, at = sets(bodies, words)
                held = [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(held, pa.binary())], ["node", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), text_of("text").alias("text")).join(nodes, "node")
    return rows.select("node", "text").mapInArrow(whole, "node long, set binary")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of which the full sets share `percent` in a hundred of their union, or more."""
    for end in ("a", "b"):
        pairs = pairs.join(full.select(F.col("node").alias(end), F.col("set").alias(f"s_{end}")), end)

    def judge(found: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in found:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                keep.append(_linked(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "s_a", "s_b").mapInArrow(judge, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame | None, on: str, name: str) -> DataFrame:
    """rows with the component of the node in column `on`; a node without links is its own."""
    if labels is None:
        return rows.withColumn(name, F.col(on))
    found = rows.join(labels.select(F.col("node").alias(on), F.col("root").alias("_root")), on, "left")
    return found.withColumn(name, F.coalesce("_root", on)).drop("_root")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs that aren't connected yet."""
    return _labelled(_labelled(pairs, labels, "a", "_ca"), labels, "b", "_cb").where("_ca <> _cb").drop("_ca", "_cb")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share `percent` in a hundred of their union, or more."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _blocks(members: DataFrame, classes: DataFrame, full: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) between components inside large buckets, confirmed in blocks; enough of them to join what is linked.

    Buckets whose members are connected already are done. In the others, those outside the bucket's largest component are
    compared with all members that aren't in their own; both are dealt into blocks of about BLOCK members and BYTES of sets,
    and each two blocks meet in one task, whose memory the blocks bound. Full sets move once for a block, not for a
    pair; pairs are compared there and never listed, each in the first band that it shares, and not once it's connected.
    """
    least = percent / 100
    known = table(_labelled(members, labels, "rep", "root"), "members")
    parts = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_c"), F.sum("n_shingles").alias("_s"))
    main = F.max(F.struct("_c", "_s", "root")).alias("_main")
    whole = parts.groupBy("key").agg(main, F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.count(F.lit(1)).alias("_roots")).where("_roots > 1")

    def blocks(rows: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(rows / BLOCK, 8 * shingles / BYTES, F.lit(1))).cast("int")

    out = blocks(F.col("_c") - F.col("_main._c"), F.col("_s") - F.col("_main._s")).alias("_i")
    opened = whole.select("key", F.col("_main.root").alias("_to"), out, blocks(F.col("_c"), F.col("_s")).alias("_j"))
    held = known.join(opened, "key").join(classes.select("rep", "registers"), "rep").join(full.select(F.col("node").alias("rep"), "set"), "rep")
    i, j = (F.pmod(F.xxhash64("rep", F.lit(k)), F.col(n)).cast("int") for k, n in enumerate(("_i", "_j")))
    outside, values = F.col("root") != F.col("_to"), ["rep", "root", "n_shingles", "registers", "set", "outer", "inner"]
    # an outer row in its own block meets all inner blocks, and an inner row all outer ones; where both meet it is one row
    as_outer = F.when(outside, F.transform(F.sequence(F.lit(0), F.col("_j") - 1), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(True).alias("outer"), (x == j).alias("inner"))))
    as_inner = F.transform(F.sequence(F.lit(0), F.col("_i") - 1), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(False).alias("outer"), F.lit(True).alias("inner")))
    as_inner = F.filter(as_inner, lambda m: ~outside | (m["i"] != i))
    met = held.withColumn("_m", F.explode(F.concat(F.coalesce(as_outer, F.array().cast("array<struct<i:int,j:int,outer:boolean,inner:boolean>>")), as_inner)))
    met = met.select("key", "band", "_m.i", "_m.j", *values[:5], "_m.outer", "_m.inner")

    def compare(key, group):
        import pyarrow as pa

        band = key[1].as_py()
        rep, n, outer, inner = (group.column(c).to_numpy() for c in ("rep", "n_shingles", "outer", "inner"))
        root = group.column("root").to_numpy().copy()
        a, b = [], []
        if root.min() != root.max():
            held = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            sets_of = group.column("set").combine_chunks()
            right = np.flatnonzero(inner)
            for x in np.flatnonzero(outer):
                # of two outer rows of this pair of blocks, the lesser one looks for the other
                near = right[(root[right] != root[x]) & (np.minimum(n[right], n[x]) >= least * np.maximum(n[right], n[x])) & ~(outer[right] & bool(inner[x]) & (rep[right] < rep[x]))]
                alike = held[near] == held[x]
                likely = alike.mean(axis=1) >= least - MARGIN  # correcting for chance lowers it further
                near, alike = near[likely], alike[likely]
                if not len(near):
                    continue
                likely = estimate(held[near], held[x][None, :], n[near], np.full(len(near), n[x])) >= least - MARGIN
                shared = alike[likely].reshape(-1, BANDS, ROWS).all(axis=2)
                own = np.frombuffer(sets_of[int(x)].as_buffer(), np.uint64)
                for y in near[likely][shared.argmax(axis=1) == band]:
                    if root[x] != root[y] and _linked(own, np.frombuffer(sets_of[int(y)].as_buffer(), np.uint64), percent):
                        a.append(int(min(rep[x], rep[y])))
                        b.append(int(max(rep[x], rep[y])))
                        root[root == root[y]] = root[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("key", "band", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of `words`-word shingles (see
    `shingles.sets`); component_id is the smallest doc_id reachable over links, and kept says that it is the row's own.
    Texts without words are linked with nothing. A null doc_id has no component and is kept. Rows that repeat a doc_id
    are one node of the graph. Extra columns are ignored; an empty table gives none. Very long texts are cut into words
    in segments, and their sets are compared whole.

    1. Each set's 128-bit digest (see `shingles.names`) and HyperMinHash registers; rows with equal ones become one
       class, however many they are.
    2. Classes meet in the buckets of BANDS bands. Small buckets give all their pairs, larger ones each member with one
       pivot, another in each band. Estimates, corrected for chance, leave pairs near the threshold or above.
    3. Every class is confirmed with its most similar partner first, on full sets; then pairs between components that
       are still apart; last, in large buckets with several components, all pairs between them (`_blocks`).
       So no candidate is left out: a pair that isn't confirmed was in one component already, or fell below.
    """
    least = percent / 100
    signed = table(signatures(docs, words), "signed")
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("n_shingles", "digest", "registers").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    classes = table(classes, "classes")
    n = classes.count()
    bands = classes.select("rep", "n_shingles", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(registers, i * {ROWS} + 1, {ROWS})))")).alias("band", "key"))
    # xor with the bucket's key makes another member the least in each bucket
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("rep").bitwiseXOR(F.col("key"))).alias("least")).where("n > 1")
    members = table(bands.join(buckets, "key").select("band", "key", "n", "rep", "n_shingles", F.col("least").bitwiseXOR(F.col("key")).alias("pivot")), "buckets")
    few = members.where(f"n <= {SMALL}").groupBy("key").agg(F.array_sort(F.collect_list("rep")).alias("all"))
    few = few.select(F.explode(F.expr("flatten(transform(all, x -> transform(filter(all, y -> y > x), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    many = members.where(f"n > {SMALL} AND rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    pairs = table(_estimated(few.unionByName(many).distinct(), classes, least), "pairs")
    large = members.where(f"n > {SMALL}").select("band", "key", "rep", "n_shingles")
    ends = (pairs.select(F.col("a").alias("node")), pairs.select(F.col("b").alias("node")), large.select(F.col("rep").alias("node")))
    nodes = ends[0].unionByName(ends[1]).unionByName(ends[2]).distinct()
    full = table(_full_sets(docs, nodes, words), "sets")

    ends = pairs.selectExpr("a as node", "b as other", "estimate").unionByName(pairs.selectExpr("b as node", "a as other", "estimate"))
    best = ends.groupBy("node").agg(F.max(F.struct("estimate", "other")).alias("m")).select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b"))
    first = table(best.distinct(), "first", n)
    labels = components.merge(None, table(_confirmed(first, full, percent), "links"))
    rest = table(_apart(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), labels), "rest")
    labels = components.merge(labels, table(_confirmed(rest, full, percent), "links"))
    labels = components.merge(labels, table(_blocks(large, classes, full, labels, percent), "links"))

    # only classes of several rows, or with a smaller component, are looked up
    told = _labelled(classes, labels, "rep", "root").where("rows > 1 OR root <> rep").select("digest", "n_shingles", "root", "rows")
    told = table(told, "told", n)
    remove(classes, members, pairs, full, first, rest, labels)
    rows = linked.select("doc_id", "n_shingles", "digest")
    found = looked_up(rows, told, ["digest", "n_shingles"], "rows", F.col("doc_id")).select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component of near copies: that of the smallest doc_id. All columns stay.

    Rows that repeat a doc_id share its fate; rows without a doc_id stay. Only ids are hashed in the last join, and whole
    rows aren't sorted.
    """
    gone = near_groups(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
