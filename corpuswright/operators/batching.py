"""Training batches from token records: overlapping chunks, next-token pairs, fill-in-the-middle, the evaluation set.

Everything is a projection of one row, but for the evaluation set; nothing is shuffled and no draw depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.draws import randint, uniform
from corpuswright.functions.text import last_lines, wrap_text
from corpuswright.functions.tokenizers import Tokenizer
from corpuswright.schemas import BLOCK_SIZE, EVAL_SAMPLES, FIM_END, FIM_MID, FIM_PRE, FIM_SUF, IGNORE, MIN_CHUNK, MIN_EVAL, MIN_FIM, PAD_TOKEN


def _padded(ids: Column, n: int, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), (F.lit(n) - F.size(ids)).cast("int")))


def chunks(records: DataFrame, block: int = BLOCK_SIZE, keep: tuple[str, ...] = ("ordinal", "category_id")) -> DataFrame:
    """keep, chunk and ids: tokens in pieces of up to block + 1 that share one token with the piece before.

    Pieces of fewer than MIN_CHUNK tokens go; no tail is lost otherwise.
    """
    n = F.greatest(F.lit(1), F.ceil((F.size("tokens") - 1) / block)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(F.col("tokens"), k * block + 1, block + 1))
    return records.where(F.size("tokens") >= MIN_CHUNK).select(*keep, F.posexplode(parts).alias("chunk", "ids")).where(F.size("ids") >= MIN_CHUNK)


def lm_pairs(chunked: DataFrame, block: int = BLOCK_SIZE) -> DataFrame:
    """chunked with x and y: ids and the ids one further on, of length block, filled with PAD_TOKEN and IGNORE."""
    n = F.least(F.size("ids") - 1, F.lit(block))
    return chunked.withColumn("x", _padded(F.slice("ids", F.lit(1), n), block, PAD_TOKEN)).withColumn("y", _padded(F.slice("ids", F.lit(2), n), block, IGNORE))


def fim_rows(chunked: DataFrame, vocabulary: int, code: Column, block: int = BLOCK_SIZE, rate: float = 0.5) -> DataFrame:
    """chunked with is_fim and ids: about `rate` of the code chunks of MIN_FIM tokens or more, rearranged.

    A chunk is cut at most block - 3 tokens long, and split into prefix, middle and suffix by draws on (ordinal, chunk);
    its ids become PRE prefix SUF suffix MID middle END. Chunks whose middle could have no 16 tokens stay as they are.
    mid_at is the place of MID.
    """
    key = F.concat_ws("-", F.col("ordinal").cast("string"), F.col("chunk").cast("string"))
    rows = chunked.withColumn("_t", F.slice("ids", 1, block - 3)).withColumn("_n", F.size("_t"))
    wanted = code & (uniform(key, "fim") < rate) & (F.size("ids") >= MIN_FIM)
    rows = rows.withColumn("_pre", randint(key, "pre", F.floor(F.col("_n") / 4), F.floor(7 * F.col("_n") / 10)).cast("int"))
    rows = rows.withColumn("_most", F.least(F.col("_n") - F.col("_pre") - 4, F.floor(F.col("_n") / 4)).cast("int"))
    rows = rows.withColumn("is_fim", F.coalesce(wanted & (F.col("_most") >= 16), F.lit(False)))
    low = F.least(F.lit(64), F.col("_most"))
    rows = rows.withColumn("_mid", F.when(F.col("is_fim"), randint(key, "mid", low, F.col("_most"))).otherwise(0).cast("int"))
    rows = rows.withColumn("_end", F.least(F.col("_pre") + F.col("_mid"), F.col("_n") - 4))
    mark = lambda offset: F.array(F.lit(vocabulary + offset))
    t, rest = F.col("_t"), F.greatest(F.col("_n") - F.col("_end"), F.lit(0))
    fim = F.concat(mark(FIM_PRE), F.slice(t, F.lit(1), F.col("_pre")), mark(FIM_SUF), F.slice(t, F.col("_end") + 1, rest), mark(FIM_MID), F.slice(t, F.col("_pre") + 1, F.col("_end") - F.col("_pre")), mark(FIM_END))
    place = F.when(F.col("is_fim"), F.col("_pre") + rest + 2)
    return rows.withColumn("ids", F.when(F.col("is_fim"), fim).otherwise(F.col("ids"))).withColumn("mid_at", place.cast("int")).drop("_t", "_n", "_pre", "_most", "_mid", "_end")


def fim_pairs(rows: DataFrame, block: int = BLOCK_SIZE) -> DataFrame:
    """rows of `fim_rows` with x and y: plain pairs, but in rearranged rows only what follows MID is learned."""
    n = F.least(F.size("ids") - 1, F.lit(block))
    y = F.slice("ids", F.lit(2), n)
    masked = F.transform(y, lambda t, i: F.when(F.col("is_fim") & (i < F.col("mid_at")), F.lit(IGNORE)).otherwise(t))
    return rows.withColumn("x", _padded(F.slice("ids", F.lit(1), n), block, PAD_TOKEN)).withColumn("y", _padded(masked, block, IGNORE))


def eval_set(records: DataFrame, block: int = BLOCK_SIZE, n: int = EVAL_SAMPLES) -> DataFrame:
    """The first n records of MIN_EVAL tokens or more, cut to a block: a fixed set, so losses compare over time."""
    return records.where(F.size("tokens") >= MIN_EVAL).orderBy("ordinal").limit(n).withColumn("ids", F.slice("tokens", 1, block))


def sample_block(step: Column, prompt_text: Column, generated: Column, lines: int = 6, tokens: int = 32, columns: int = 80) -> Column:
    """The lines that a sample at a checkpoint is shown in: step, prompt, what was generated, and a rule."""
    head = F.concat(F.lit("===== step "), step.cast("string"), F.lit(" | checkpoint sample ====="))
    asked, made = F.array(head, F.lit(f"-- prompt (last {lines} lines) --")), F.array(F.lit(f"-- generated ({tokens} tokens) --"))
    return F.concat(asked, wrap_text(prompt_text), made, wrap_text(generated), F.array(F.lit("=" * (columns - 4))))


def last_chunk(chunked: DataFrame) -> DataFrame:
    """The ids of the last chunk in the order of (ordinal, chunk)."""
    return chunked.agg(F.max_by("ids", F.struct("ordinal", "chunk")).alias("ids"))


def prompt(chunked: DataFrame, tokenizer: Tokenizer, block: int = BLOCK_SIZE, room: int = 32, lines: int = 6) -> DataFrame:
    """text and ids for a sample at a checkpoint: the last chunk's last lines, at most block - room ids from their end.

    The end mark is left out, so that a model goes on from the text.
    """
    text = last_chunk(chunked).select(last_lines(tokenizer.detokenize(F.col("ids")), lines).alias("text"))
    ids = text.withColumn("ids", tokenizer.tokenize(F.col("text")))
    bare = F.slice("ids", F.lit(1), F.size("ids") - 1)
    return ids.withColumn("ids", F.slice(bare, F.greatest(F.size(bare) - (block - room), F.lit(0)) + 1, F.lit(block - room)))
