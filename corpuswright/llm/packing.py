"""Best-fit packing of documents into sequences, with certified bin counts and repacking."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, table, text_of
from .token_ids import chunks, default_vocabulary, load

SEQUENCE = 1024
END = 2
#: Documents that one packing task gets, about; also of the pools of later rounds.
GROUP = 20_000
#: Bins of a group that are filled anew, at most, where its bound isn't met.
TIGHTEN = 2048
#: Rounds of exchange after the first packing.
ROUNDS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PLACED = PIECES + ", place long"
_ROUND_BITS, _GROUP_BITS = 58, 20


def pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row per piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset, place.

    A document is its text's ids and then END; null text is empty. Only longer ones than `size` are cut, into pieces
    of `size`, the first of which may be shorter. Full pieces fill a sequence each and have it here already; the
    others have a null sequence_id, and their task and rank in its order as place. Numbers of full sequences and places
    are dealt by task, so the result is to be written once.
    """
    folder = vocabulary or default_vocabulary()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, end = load(folder), END.to_bytes(4, "little")
        number = place = TaskContext.get().partitionId() << 32
        for batch in batches:
            out = [[] for _ in range(8)]
            packed = (p for some in chunks(batch.column(1).to_pylist()) for p in bpe.packed(some))
            for doc, body in zip(batch.column(0).to_pylist(), packed, strict=True):
                ids = memoryview(body + end)
                n = len(ids) // 4
                ends = range(n % size or size, n + 1, size) if n > size else (n,)
                start = 0
                for piece, stop in enumerate(ends):
                    full = stop - start == size
                    for column, value in zip(out, (doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), number if full else None, 0 if full else None, None if full else place), strict=True):
                        column.append(value)
                    number += full
                    place += not full
                    start = stop
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in _PLACED.split(", ")])

    rows = columns_of(docs, ["doc_id", "text"], "packing").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(cut, _PLACED)


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Best-fit decreasing: the bin and place of each item, and the number of bins.

    Open bins are kept by room left, and a bit mask says which rooms there are, so that each item finds the tightest
    bin in one step, whatever their number.
    """
    bins, places = [0] * len(lengths), [0] * len(lengths)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    mask = n = 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        x = lengths[i]
        if fitting := mask >> x:
            room = x + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = size, n, n + 1
        bins[i], places[i] = b, size - room
        if left := room - x:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, places, n


def bins_needed(lengths: list[int], size: int) -> int:
    """A lower bound on the bins that any packing needs, from two families of dual feasible functions.

    For each threshold e up to half a bin, items longer than size - e count as a whole bin, items shorter than e as
    nothing, others by length; and for k = 1..20 a length x counts as floor((k + 1) x / size) / k, or as x / size where
    (k + 1) x is a multiple of size. Sums of either over all items can't exceed the number of bins.
    """
    counts = Counter(lengths)
    total = sum(x * c for x, c in counts.items())
    best = -(-total // size)
    held, whole = total, 0
    longest = sorted(counts, reverse=True)
    at = 0
    for e in sorted({x for x in counts if 2 * x <= size} | {0} | {x + 1 for x in counts if 2 * (x + 1) <= size}):
        while at < len(longest) and longest[at] > size - e:
            whole += counts[longest[at]] * size - longest[at] * counts[longest[at]]
            at += 1
        short = sum(x * counts[x] for x in counts if x < e) if e else 0
        best = max(best, -(-(held + whole - short) // size))
    for k in range(1, 21):
        units = sum(c * (x * k if (k + 1) * x % size == 0 else (k + 1) * x // size * size) for x, c in counts.items())
        best = max(best, -(-units // (size * k)))
    return best


def fill(lengths: list[int], size: int) -> list[list[int]]:
    """Bins filled one by one: the longest item left, and of the others the set that leaves least room.

    Sums that can be reached are bits of a whole number; longer items are tried first, so short ones stay for later bins.
    """
    held: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        held.setdefault(x, []).append(i)
    kinds = sorted(held, reverse=True)
    out = []
    while kinds:
        first = kinds[0]
        content = [held[first].pop()]
        room = size - first
        limit, sums, steps = (1 << room + 1) - 1, 1, []
        for x in kinds:
            if x > room or sums >> room & 1:
                continue
            for _ in range(min(len(held[x]), room // x)):
                more = sums | (sums << x & limit)
                if more == sums:
                    break
                steps.append((x, sums))
                sums = more
        at = sums.bit_length() - 1
        for x, before in reversed(steps):
            if not before >> at & 1:
                content.append(held[x].pop())
                at -= x
        out.append(content)
        kinds = [x for x in kinds if held[x]]
    return out


def tighten(lengths: list[int], bins: list[int], places: list[int], n: int, size: int, bound: int) -> int:
    """Packs the emptiest bins again by `fill`, more and more of them, until the bound is met; bins and places change.

    Returns the number of bins, which are numbered without gaps.
    """
    several = 64
    while n > bound and several < 4 * TIGHTEN:
        filled = [0] * n
        for b, x in zip(bins, lengths, strict=True):
            filled[b] += x
        loose = sorted(range(n), key=filled.__getitem__)[: min(several, TIGHTEN)]
        number = {b: k for k, b in enumerate(loose)}
        items = [i for i, b in enumerate(bins) if b in number]
        again = fill([lengths[i] for i in items], size)
        if len(again) < len(loose):
            for content, b in zip(again, loose, strict=False):
                at = 0
                for k in content:
                    bins[items[k]], places[items[k]] = b, at
                    at += lengths[items[k]]
            spare = sorted(loose[len(again) :])
            n -= len(spare)
            gone = set(spare)
            # the last bins take the numbers that are free now
            to = dict(zip((b for b in range(n, n + len(spare)) if b not in gone), (b for b in spare if b < n), strict=True))
            if to:
                bins[:] = [to.get(b, b) for b in bins]
        elif several >= n:
            break
        several *= 2
    return n


def _packer(turn: int, size: int, last: bool):
    """Packs a group; where its bins exceed the bound, frees its emptiest bins for the next round unless last."""

    def pack(key, group):
        import pyarrow as pa

        lengths = group.column("length").to_pylist()
        bins, places, n = best_fit(lengths, size)
        bound = bins_needed(lengths, size)
        n = tighten(lengths, bins, places, n, size, bound)
        gap = n - bound
        freed: set[int] = set()
        if gap > 0 and not last:
            filled = [0] * n
            for b, x in zip(bins, lengths, strict=True):
                filled[b] += x
            # as many bins as hold the gap's worth of free room, emptiest first; full bins never move
            order = sorted((b for b in range(n) if filled[b] < size), key=filled.__getitem__)
            freed = set(order[: 8 * gap + 8])
        base = (turn + 1 << _ROUND_BITS) | (key[0].as_py() << _GROUP_BITS)
        sequence = pa.array([None if b in freed else base + b for b in bins], pa.int64())
        offset = pa.array([None if b in freed else p for b, p in zip(bins, places, strict=True)], pa.int64())
        kept = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", sequence).append_column("offset", offset)

    return pack


def _neighbours(short: DataFrame, group: int) -> DataFrame:
    """short without place, with _g: groups of `group` neighbours, over the ends of tasks.

    Tasks' sizes, one row each, are summed up in their order, which gives each row its rank.
    """
    task = F.shiftright("place", 32).cast("int")
    sizes = short.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_start"))
    rank = F.col("_start") + F.pmod(F.col("place"), F.lit(1 << 32))
    ranked = short.withColumn("_task", task).join(starts, "_task")
    return ranked.withColumn("_g", F.floor(rank / group).cast("long")).drop("place", "_task", "_start")


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """The pieces of docs (see `pieces`), each with its sequence_id and the offset there, in few sequences.

    Short pieces form groups of `group` neighbours in the order of docs, so that sequences hold what stood together there.
    Each group is packed best-fit decreasing. Dual feasible functions bound the bins that a group needs. Groups that reach the bound, if need be after their emptiest bins are filled anew (`tighten`), are done. Others
    free their emptiest bins; the documents of those of several groups meet in a pool of about `group` and are packed
    again, for up to ROUNDS rounds, the last of which keeps all its bins. Only lengths move, never texts. A row is packed
    once, also if its doc_id repeats or is null; of equal lengths, which is packed first is open. Very long texts are cut
    into pieces of `size`. Extra columns are ignored, and an empty table gives none.
    """
    cut = table(pieces(docs, vocabulary, size), "pieces")
    done = [cut.where("sequence_id IS NOT NULL").drop("place")]
    rest, turn = _neighbours(cut.where("sequence_id IS NULL"), group), 0
    while n := rest.count():
        pools, last = max(1, n // group), turn == ROUNDS
        if turn:
            rest = rest.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.lit(turn)), F.lit(pools)))
        last = last or bool(turn) and pools == 1
        dealt = rest.drop("sequence_id", "offset").repartition(pools, "_g")
        packed = table(dealt.groupBy("_g").applyInArrow(_packer(turn, size, last), PIECES), f"packed{turn}")
        done.append(packed.where("sequence_id IS NOT NULL"))
        if last:
            break
        rest, turn = packed.where("sequence_id IS NULL"), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
