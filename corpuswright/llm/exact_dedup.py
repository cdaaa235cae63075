"""Exact deduplication by 128-bit content hash with byte comparison inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, looked_up, lower_az, remove, table, text_of


def exact_groups(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are, after lower-casing A-Z; null counts as empty. The row of the smallest
    (keep="min") or largest ("max") doc_id of a group stays.

    The aggregation's key is the 128-bit hash and the normalised bytes: rows meet by hash, and two texts that
    collide in it are still told apart, as Spark compares the whole key. Copies merge before the shuffle, so a text
    that a third of all rows share moves once per input task. Groups of two or more are written as a table without
    their texts, and rows look up theirs by (hash, SHA-256), see `looked_up`: single rows answer for themselves.

    Null doc_id: the row counts in its group, is kept only if the whole group has no id, and then keep_id is null.
    Rows that repeat a doc_id with equal text share one verdict. Very long texts move and are compared whole. Extra
    columns are ignored, an empty table gives none.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    body = columns_of(docs, ["doc_id", "text"], "exact_groups").select("doc_id", lower_az(text_of("text")).alias("body"))
    keyed = body.select("doc_id", "body", F.unhex(F.md5("body")).alias("h"))
    pick = F.max if keep == "max" else F.min
    groups = (
        keyed.groupBy("h", "body")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("h", F.unhex(F.sha2("body", 256)).alias("s"), "keep_id", "group_size")
    )
    rows = keyed.select("doc_id", "h", F.unhex(F.sha2("body", 256)).alias("s"))
    found = looked_up(rows, table(groups, "groups"), ["h", "s"], "group_size", F.col("doc_id"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs without all but one of each group of equal texts, with all its columns and in no order.

    Which row stays: see `exact_groups`, on whose verdicts, kept as a table of ids and hashes, all is decided. Whole
    rows are then touched once, by an anti-join with the ids that go, which hashes those and sorts nothing. Rows that
    repeat one doc_id and text are cut to one of them: only these, if there are any, meet in an aggregation. An empty
    table stays empty.
    """

    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_id")

    verdicts = table(exact_groups(docs, keep).select(named("doc_id"), F.unhex("text_sha256").alias("_s"), "kept"), "verdicts")
    # one row for each id and text that goes, or that stays but repeats
    marked = verdicts.groupBy("_id", "_s").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("_n"))
    marked = table(marked.where("NOT kept OR _n > 1").select("_id", "_s", "kept"), "marked")
    remove(verdicts)
    rows = docs.select(F.struct("*").alias("_row"), named("doc_id"), F.unhex(F.sha2(lower_az(text_of("text")), 256)).alias("_s"))
    left = rows.join(marked.drop("kept").hint("shuffle_hash"), ["_id", "_s"], "left_anti").select("_row.*")
    again = marked.where("kept").drop("kept")
    if again.isEmpty():
        return left
    return left.unionByName(rows.join(again, ["_id", "_s"], "left_semi").dropDuplicates(["_id", "_s"]).select("_row.*"))
