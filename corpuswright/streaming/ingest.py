"""Continuous ingest: JSON rows to the record store, copies dropped against all history, restarts without loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuswright.functions.tokenizers import Tokenizer
from corpuswright.operators import dedup, store
from corpuswright.schemas import MAX_CATEGORIES

ROWS = "ordinal long, text string, category string"


def _names(spark: SparkSession, path: str) -> DataFrame:
    return store.opened(spark, path, spark.createDataFrame([], "category string, category_id int"))


def _extended(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """The dictionary at path, with the new categories of rows appended in the order of appearance."""
    known = _names(spark, path)
    start = known.agg(F.coalesce(F.max("category_id"), F.lit(0))).first()[0]
    new = rows.groupBy("category").agg(F.min("ordinal").alias("_o")).join(known, "category", "left_anti")
    new = new.orderBy("_o", "category").limit(MAX_CATEGORIES + 1).select("category", (F.row_number().over(Window.orderBy("_o", "category")) + start).cast("int").alias("category_id"))
    if (most := new.agg(F.max("category_id")).first()[0]) is None:
        return known
    if most > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    store.append(new.coalesce(1), path)
    return _names(spark, path)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, tokenizer: Tokenizer, files_at_once: int = 100) -> StreamingQuery:
    """Reads what JSON files (ordinal, text, category) are in `source` and not yet in `target`, and stops.

    Each batch takes the first arrival of each new text, numbers new categories, and appends to target/records. A batch
    that is repeated after a failure finds its texts in the store and adds nothing. Offsets are kept in `checkpoint`.
    """

    def take(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        rows = batch.select("ordinal", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("category", F.lit("")).alias("category"))
        like = session.createDataFrame([], "ordinal long, category string, category_id int, content_hash string, token_count int, tokens array<int>")
        first = dedup.hashed(dedup.first_arrivals(rows)).persist()
        # the batch is bounded by its files; of the history only hashes are read, and those of the batch are sought there
        new = dedup.against_store(first, store.opened(session, f"{target}/records", like), first.count()).persist()
        try:
            coded = new.join(F.broadcast(_extended(session, new, f"{target}/categories")), "category")
            tokens = coded.withColumn("tokens", tokenizer.tokenize(F.col("text")))
            store.append(tokens.select("ordinal", "category", "category_id", "content_hash", F.size("tokens").alias("token_count"), "tokens"), f"{target}/records")
        finally:
            new.unpersist()
            first.unpersist()

    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_at_once).json(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(rows: DataFrame, done: int) -> DataFrame:
    """Rows beyond the ordinal that was reached: the batch form of a checkpoint."""
    return rows.where(F.col("ordinal") > done)
