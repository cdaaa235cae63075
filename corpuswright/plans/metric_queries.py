"""Queries over training metrics; events stand in for losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswright.operators import metrics as M
from corpuswright.operators.batching import sample_block

from .registry import query, read


@query("""
    SELECT CASE WHEN user_id % 2 = 0 THEN 'fim' ELSE 'lm' END AS mode, (user_id % 7)::INT AS category_id, sum(event_id % 11)::BIGINT AS tokens,
           round(sum(value / greatest(event_id % 11, 1) * (event_id % 11)) / nullif(sum(event_id % 11), 0), 5) AS loss
    FROM events GROUP BY 1, 2""")
def weighted_loss_by_category(spark, d):
    mode = F.when(F.col("user_id") % 2 == 0, "fim").otherwise("lm")
    rows = read(spark, d, "events").select(mode.alias("mode"), (F.col("user_id") % 7).cast("int").alias("category_id"), F.col("value").alias("loss_sum"), (F.col("event_id") % 11).alias("n"))
    return M.weighted_loss(rows).withColumn("loss", F.round("loss", 5))


@query("""
    SELECT step, coalesce(sum(n) FILTER (n > 0), 0)::BIGINT AS tokens, round(coalesce(sum(value * n) FILTER (n > 0), 0) / greatest(coalesce(sum(n) FILTER (n > 0), 0), 1), 5) AS loss,
           round(exp(least(coalesce(sum(value * n) FILTER (n > 0), 0) / greatest(coalesce(sum(n) FILTER (n > 0), 0), 1), 20)), 2) AS ppl
    FROM (SELECT event_id // 50 AS step, value / 50 AS value, event_id % 5 AS n FROM events) GROUP BY step""")
def step_metrics(spark, d):
    rows = read(spark, d, "events").select(F.floor(F.col("event_id") / 50).cast("long").alias("step"), (F.col("value") / 50).alias("loss"), (F.col("event_id") % 5).alias("n"))
    return M.step_metrics(rows).withColumns({"loss": F.round("loss", 5), "ppl": F.round("ppl", 2)})


@query("""
    WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE isfinite(value))
    SELECT user_id, max(n) AS n, round(sum(value * CASE WHEN i = 0 THEN 1 ELSE 0.01 END * pow(0.99, n - 1 - i)), 6) AS ema FROM r GROUP BY user_id""")
def ema_by_user(spark, d):
    events = read(spark, d, "events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return M.moving_average(events, "user_id", "_us", "value", ("event_id",)).withColumn("ema", F.round("ema", 6))


@query("""
    WITH z AS (SELECT doc_id, string_split(text, '') AS c FROM documents),
         x AS (SELECT doc_id, unnest(range(len(c))) AS i, unnest(c) AS c FROM z WHERE len(c) > 0 AND c[1] <> ''),
         y AS (SELECT doc_id, CASE WHEN i % 5 = 0 THEN -100 ELSE unicode(c) END AS y, CASE WHEN i % 3 = 0 THEN 0 ELSE unicode(c) END AS p FROM x)
    SELECT doc_id, count(*) FILTER (y <> -100) AS counted, count(*) FILTER (y <> -100 AND y = p) AS correct,
           round(count(*) FILTER (y <> -100 AND y = p) / nullif(count(*) FILTER (y <> -100), 0), 6) AS accuracy
    FROM y GROUP BY doc_id""")
def masked_accuracy(spark, d):
    """All characters' codes as targets, a third of them predicted wrongly, a fifth masked."""
    rows = read(spark, d, "documents").where(F.char_length("text") > 0).withColumn("_c", F.transform(F.split("text", ""), lambda x: F.ascii(x)))
    rows = rows.select("doc_id", F.transform("_c", lambda x, i: F.when(i % 5 == 0, -100).otherwise(x)).alias("y"), F.transform("_c", lambda x, i: F.when(i % 3 == 0, 0).otherwise(x)).alias("predicted"))
    return M.masked_accuracy(rows).select("doc_id", "counted", "correct", F.round("accuracy", 6).alias("accuracy"))


def _lr(top: str, least: str, s: str) -> str:
    return f"CASE WHEN {s} < 100 THEN {top} * ({s} + 1) / 100 WHEN {s} >= 250000 THEN {least} ELSE {least} + 0.5 * (1 + cos(pi() * ({s} - 100) / 249900)) * ({top} - {least}) END"


@query(f"""
    SELECT event_id, round({_lr("1.5e-4", "3e-5", "event_id * 27")}, 10) AS lr, round({_lr("5e-5", "1e-5", "(event_id * 27 - 3000)")}, 10) AS lr_big,
           round(CASE WHEN event_id * 27 < 3000 THEN 1e-4 * (event_id * 27 + 1) / 100 ELSE {_lr("5e-5", "1e-5", "(event_id * 27 - 3000)")} END, 10) AS lr_woken
    FROM events""")
def lr_schedule(spark, d):
    step = F.col("event_id") * 27
    rates = {"lr": M.learning_rate(step), "lr_big": M.learning_rate_big(step, False), "lr_woken": M.learning_rate_big(step, True)}
    return read(spark, d, "events").select("event_id", *[F.round(c.cast("double"), 10).alias(n) for n, c in rates.items()])


@query("""
    SELECT name, step, row_number() OVER (ORDER BY step DESC, name) <= 5 AS kept, step = max(step) OVER () AS latest
    FROM (SELECT 'step_' || (n_nationkey * 250) || '.pt' AS name, (n_nationkey * 250)::BIGINT AS step FROM nation)""")
def keep_last_n(spark, d):
    names = read(spark, d, "nation").select(F.concat(F.lit("step_"), (F.col("n_nationkey") * 250).cast("string"), F.lit(".pt")).alias("name"))
    return M.keep_last(names, 5)


@query("""
    WITH r AS (SELECT name, step, name LIKE 'step_big_%' AS big, name LIKE '%.pt' AS pt FROM (
            SELECT CASE n_nationkey % 4 WHEN 0 THEN 'step_big_' || (n_nationkey * 250) || '.pt' WHEN 3 THEN 'log_' || n_nationkey || '.txt' ELSE 'step_' || (n_nationkey * 250) || '.pt' END AS name,
                   (CASE n_nationkey % 4 WHEN 3 THEN 1 ELSE 250 END * n_nationkey)::BIGINT AS step FROM nation))
    SELECT name, step, CASE WHEN big THEN row_number() OVER (PARTITION BY big ORDER BY step DESC) <= 2 ELSE NOT pt END AS kept FROM r""")
def keep_last_big(spark, d):
    key = F.col("n_nationkey")
    number = (key * 250).cast("string")
    big, small = F.concat(F.lit("step_big_"), number, F.lit(".pt")), F.concat(F.lit("step_"), number, F.lit(".pt"))
    other = F.concat(F.lit("log_"), key.cast("string"), F.lit(".txt"))
    names = read(spark, d, "nation").select(F.when(key % 4 == 0, big).when(key % 4 == 3, other).otherwise(small).alias("name"))
    return M.keep_last_big(names, 2)


def _wrapped(text: str) -> str:
    return f"[rtrim({text})[i * 80 + 1:(i + 1) * 80] FOR i IN range(greatest(1, ceil(length(rtrim({text})) / 80.0)::INT))]"


@query(f"""
    SELECT p_partkey, array_to_string(['===== step ' || p_partkey || ' | checkpoint sample =====', '-- prompt (last 6 lines) --'] || {_wrapped("repeat(p_name || ' ', 12)")} || {_wrapped("p_brand")}
           || ['-- generated (32 tokens) --'] || {_wrapped("repeat(p_type || ' ', 5)")} || [repeat('=', 76)], chr(10)) AS shown FROM part""")
def checkpoint_sample(spark, d):
    """Names of parts as prompts, their types as what was generated."""
    prompt = F.concat(F.repeat(F.concat("p_name", F.lit(" ")), F.lit(12)), F.lit("\n"), "p_brand")
    block = sample_block(F.col("p_partkey"), prompt, F.repeat(F.concat("p_type", F.lit(" ")), F.lit(5)))
    return read(spark, d, "part").select("p_partkey", F.array_join(block, "\n").alias("shown"))
