"""State that outlives a session: the serving cursor and what was served, as appended rows of a table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .serve import Cursor, next_samples, served_counts
from .store import append, opened

CURSOR = "version long, position long"
SERVED = "version long, category string, served_count long, served_token_count long"


class ServingState:
    """Cursor and served counts in a folder, for one writer. A step writes its counts first and then the cursor, under one
    version; counts whose version has no cursor are of a step that was cut short, and don't count."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _rows(self, name: str, schema: str) -> DataFrame:
        return opened(self.spark, f"{self.folder}/{name}", self.spark.createDataFrame([], schema))

    def _latest(self) -> tuple[int, Cursor]:
        row = self._rows("cursor", CURSOR).agg(F.max_by(F.struct("version", "position"), "version").alias("r")).first()["r"]
        return (row["version"], Cursor(row["position"])) if row else (0, Cursor())

    @property
    def cursor(self) -> Cursor:
        return self._latest()[1]

    def _move(self, version: int, to: Cursor) -> None:
        append(self.spark.createDataFrame([(version, to.position)], CURSOR).coalesce(1), f"{self.folder}/cursor")

    def serve(self, records: DataFrame, wanted: int = 0) -> DataFrame:
        """The next records; the cursor moves on and the counts grow."""
        version, at = self._latest()
        found, to = next_samples(records, at, wanted)
        found = found.persist(StorageLevel.MEMORY_AND_DISK)  # as many rows as are wanted; the counts and the caller read them
        counts = served_counts(found).select(F.lit(version + 1).cast("long").alias("version"), "category", "served_count", "served_token_count")
        append(counts, f"{self.folder}/served")
        self._move(version + 1, to)
        return found

    def reset(self) -> None:
        """The cursor goes back to the beginning; the counts stay."""
        version, at = self._latest()
        self._move(version + 1, at.reset())

    def served(self) -> DataFrame:
        """category, served_count, served_token_count over all steps."""
        done = self._rows("cursor", CURSOR).select("version")
        rows = self._rows("served", SERVED).join(done, "version", "left_semi")
        return rows.groupBy("category").agg(F.sum("served_count").alias("served_count"), F.sum("served_token_count").alias("served_token_count"))
