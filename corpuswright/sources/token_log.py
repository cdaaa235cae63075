"""Token records as one binary log: written from a store, and scanned back record by record."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.functions.codec import decoded

SCANNED = "path string, file_offset long, category_id int, token_count int, tokens array<int>"


def log_segments(records: DataFrame) -> DataFrame:
    """segment and body: the records (segment, ordinal, record) of each segment one after another.

    A segment is built in one task, so the caller bounds its records; segments in their order make up the log.
    """

    def join(key, group):
        import pyarrow as pa

        body = b"".join(group.sort_by("ordinal").column("record").to_pylist())
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([body], pa.binary())})

    return records.select("segment", "ordinal", "record").groupBy("segment").applyInArrow(join, "segment long, body binary")


def parse(body: bytes) -> Iterator[tuple[int, int, int, list[int]]]:
    """(offset, category, tokens, ids) of each record; a damaged or cut tail ends the scan without an error."""
    at = 0
    while at < len(body):
        found = decoded(body[at : at + 9 + (int.from_bytes(body[at : at + 8], "little") if at + 8 <= len(body) else 0)])
        if found["error"]:
            return
        yield at, found["category_id"], found["token_count"], found["tokens"]
        at += 9 + 2 * found["token_count"]


def scan(bodies: DataFrame) -> DataFrame:
    """The records of binary logs (path, body): path, file_offset, category_id, token_count, tokens."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = []
                for row in parse(body or b""):
                    held.append((path, *row))
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], [x.split()[0] for x in SCANNED.split(", ")])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], [x.split()[0] for x in SCANNED.split(", ")])

    return bodies.select(F.col("path").cast("string"), "body").mapInArrow(read, SCANNED)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """`scan` over files."""
    return scan(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body")))
