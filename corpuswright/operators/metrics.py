"""Training metrics: weighted losses, moving averages, accuracy under a mask, learning rates, checkpoint retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswright.functions.text import step_of
from corpuswright.schemas import IGNORE

from .ranks import fitting_span, ranked

BETA = 0.01


def weighted_loss(rows: DataFrame) -> DataFrame:
    """mode, category_id, tokens and loss of rows (mode, category_id, loss_sum, n): loss by token, null without tokens.

    A row's loss is its sum over its tokens, or over one if it has none; it weighs by its tokens.
    """
    each = F.col("loss_sum") / F.greatest(F.col("n"), F.lit(1))
    sums = rows.groupBy("mode", "category_id").agg(F.sum(each * F.col("n")).alias("_l"), F.sum("n").cast("long").alias("tokens"))
    return sums.select("mode", "category_id", "tokens", F.when(F.col("tokens") > 0, F.col("_l") / F.col("tokens")).alias("loss"))


def perplexity(loss: Column) -> Column:
    """exp of the loss, which counts up to 20; null without a loss."""
    return F.when(loss.isNotNull(), F.exp(F.least(loss, F.lit(20.0))))


def step_metrics(rows: DataFrame) -> DataFrame:
    """step, tokens, loss and ppl of micro-batches (step, loss, n); those without tokens don't count."""
    some = F.col("n") > 0
    sums = rows.groupBy("step").agg(F.sum(F.when(some, F.col("loss") * F.col("n"))).alias("_l"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).cast("long").alias("tokens"))
    loss = F.coalesce("_l", F.lit(0.0)) / F.greatest(F.col("tokens"), F.lit(1))
    return sums.select("step", "tokens", loss.alias("loss"), perplexity(loss).alias("ppl"))


def moving_average(series: DataFrame, key: str, order: str, value: str, ties: tuple[str, ...] = (), beta: float = BETA) -> DataFrame:
    """key, n and ema: the exponential moving average with weight beta on the new value, after all finite values.

    Null, infinite and not-a-number values are passed over; the first finite one starts the average. Values weigh
    beta * (1 - beta)^(values after it), the first without beta, so the fold is a sum, and no key needs one task: ranges of
    the order are cut until none is too large for one (`fitting_span`).
    """
    x = F.col(value)
    finite = series.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = ranked(finite, order, "_rank", (key,), span=fitting_span(finite, order, (key,), 1 << 40), ties=ties)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = rows.join(sizes, key)
    weight = F.pow(F.lit(1 - beta), (F.col("n") - 1 - F.col("_rank")).cast("double")) * F.when(F.col("_rank") == 0, 1.0).otherwise(beta)
    return both.groupBy(key).agg(F.max("n").alias("n"), F.sum(weight * x).alias("ema"))


def masked_accuracy(rows: DataFrame) -> DataFrame:
    """rows (y, predicted) with correct, counted and accuracy over the places where y isn't IGNORE; null without any."""
    pairs = F.filter(F.arrays_zip(F.col("y").alias("y"), F.col("predicted").alias("p")), lambda z: z["y"] != IGNORE)
    held = rows.withColumn("_z", pairs).withColumn("counted", F.size("_z").cast("long"))
    held = held.withColumn("correct", F.size(F.filter("_z", lambda z: z["y"] == z["p"])).cast("long")).drop("_z")
    return held.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("counted").cast("double")))


def eval_loss(rows: DataFrame) -> DataFrame:
    """One row: tokens, eval_loss and eval_ppl over the places of rows (y, nll) where y isn't IGNORE; null without any.

    nll has a place's negative log-likelihood. All places weigh alike, whatever their row.
    """
    places = F.filter(F.arrays_zip(F.col("y").alias("y"), F.col("nll").alias("l")), lambda z: z["y"] != IGNORE)
    each = rows.select(places.alias("_z")).select(F.size("_z").cast("long").alias("_n"), F.aggregate("_z", F.lit(0.0), lambda a, z: a + z["l"]).alias("_l"))
    sums = each.where("_n > 0").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("tokens"), F.sum("_l").alias("_l"))
    loss = F.when(F.col("tokens") > 0, F.col("_l") / F.col("tokens"))
    return sums.select("tokens", loss.alias("eval_loss"), perplexity(loss).alias("eval_ppl"))


def _cosine(s: Column, top: float, least: float, warm: int, decayed: int) -> Column:
    part = (s - warm) / (decayed - warm)
    return least + 0.5 * (1 + F.cos(F.lit(math.pi) * part)) * (top - least)


def learning_rate(step: Column, top: float = 1.5e-4, least: float = 3e-5, warm: int = 100, decayed: int = 250_000) -> Column:
    """Linear warm-up, then a cosine down to `least` by `decayed` steps."""
    return F.when(step < warm, top * (step + 1) / warm).when(step >= decayed, F.lit(least)).otherwise(_cosine(step, top, least, warm, decayed))


def learning_rate_big(step: Column, upscaled: bool, top: float = 5e-5, least: float = 1e-5, warm: int = 100, decayed: int = 250_000, wake: int = 3000, wake_top: float = 1e-4) -> Column:
    """The large trainer's schedule as it is defined: waking divides by `warm`, and without it early rates are negative."""
    s = step - wake
    later = F.when(s < warm, top * (s + 1) / warm).when(s >= decayed, F.lit(least)).otherwise(_cosine(s, top, least, warm, decayed))
    return F.when(step < wake, wake_top * (step + 1) / warm).otherwise(later) if upscaled else later


def keep_last(files: DataFrame, n: int) -> DataFrame:
    """files (name) with step, kept and latest: the n largest steps stay; 0 and -1 keep all, other negatives none."""
    rows = files.withColumn("step", step_of(F.col("name")))
    if n in (0, -1):
        rows = rows.withColumn("kept", F.lit(True))
    elif n < 0:
        rows = rows.withColumn("kept", F.lit(False))
    else:  # names in a folder, few
        rows = rows.withColumn("kept", F.row_number().over(Window.orderBy(F.desc_nulls_last("step"), "name")) <= n)
    most = files.select(F.max(step_of(F.col("name")))).first()[0]
    return rows.withColumn("latest", F.col("step").eqNullSafe(F.lit(most).cast("long")))


def keep_last_big(files: DataFrame, n: int, prefix: str = "step_big_", suffix: str = ".pt") -> DataFrame:
    """files (name) with step and kept, by the large trainer's rules.

    Of names that begin with prefix the n largest steps stay, and other checkpoints (names with the suffix) go, as they are
    superseded; 0 and -1 keep all, other negatives no checkpoint. Files that are neither are kept.
    """
    rows = files.withColumn("step", step_of(F.col("name")))
    big, checkpoint = F.col("name").startswith(prefix), F.col("name").endswith(suffix)
    if n in (0, -1):
        return rows.withColumn("kept", F.lit(True))
    if n < 0:
        return rows.withColumn("kept", ~checkpoint)
    # names in a folder, few
    rank = F.row_number().over(Window.partitionBy(big).orderBy(F.desc_nulls_last("step"), F.desc("name")))
    return rows.withColumn("kept", F.when(big, rank <= n).otherwise(~checkpoint))
