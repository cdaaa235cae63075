"""Quality rules with host-level verdicts, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, looked_up, table, text_of

#: White space that parts words: space, and tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Further rules, which only hosts are judged by: symbols in a hundred words, repeated lines in a hundred, letters a word.
SYMBOL_PERCENT, LINE_PERCENT, WORD_CHARS = 10, 30, (2, 12)
#: A host goes if its failure rate by any rule is above this, by the lower end of its posterior.
HOST_RATE = 0.5
#: The lower end is so many standard deviations below the posterior mean: about the 5 % quantile.
HOST_SURE = 1.645


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are sorted by a 64-bit hash with their place, so equal ones are neighbours; a run of equal neighbours
    marks its places; the places, sorted, cover three words each, less what the next place covers too.
    """

    def covered(places: Column) -> Column:
        n = F.size(places)
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, b: a + b))

    def repeated(ranked: Column) -> Column:
        def alike(i: Column) -> Column:
            return F.get(ranked, i)["h"]

        hit = F.filter(ranked, lambda w, i: (alike(i - 1) == w["h"]) | (alike(i + 1) == w["h"]))
        return _let(F.array_sort(F.transform(hit, lambda w: w["i"])), covered)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(F.sort_array(windows), repeated))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and what the rules read: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Null text counts as empty and fails. Null sources form one host. Rows that repeat a doc_id are measured each.
    """
    rows = columns_of(docs, ["doc_id", "text", "source"], "quality rules").select("doc_id", "source", text_of("text").alias("text"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.coalesce(F.char_length(F.array_join(words, "")), F.lit(0)).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    seen = rows.select(
        "doc_id",
        "source",
        _let(_words(text), of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("w.n_words"))
    return seen.select(
        "doc_id", "source", F.col("w.n_words").alias("n_words"), F.col("w.word_chars").alias("word_chars"), "n_symbols", "l.n_lines", "l.n_dup_lines",
        F.col("w.n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"),
    )


def _prior(n: float | None, k: float | None, kk: float | None, nn: float | None, hosts: int) -> tuple[float, float]:
    """Mean and strength of the beta prior from sums over hosts of rows n, failures k, k*k/n and n*n."""
    if not n:
        return 0.0, 1.0
    mean = k / n
    within, room = mean * (1 - mean), n - nn / n
    if hosts < 2 or room <= 0:
        return mean, 1000.0
    spread = (kk - n * mean * mean - (hosts - 1) * within) / room  # between hosts, beyond binomial sampling
    return mean, min(1000.0, max(1.0, within / max(spread, 1e-9) - 1))


def rules(measured: DataFrame) -> DataFrame:
    """measured with a column for each further rule, rule_symbols, rule_lines and rule_words: whether the row fails it."""
    words = F.col("n_words")
    return measured.withColumns(
        {
            "rule_symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * words,
            "rule_lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
            "rule_words": (F.col("word_chars") < WORD_CHARS[0] * words) | (F.col("word_chars") > WORD_CHARS[1] * words),
        }
    )


def host_verdicts(measured: DataFrame, rate: float = HOST_RATE, sure: float = HOST_SURE) -> DataFrame:
    """source, host_rows, host_failed (by base_failed), host_rate, host_ok: failures by host and rule, each rule's rates
    shrunk with its own empirical beta prior. Rules are base_failed and those of the columns that begin with rule_.

    A prior's mean is the corpus-wide failure rate; its strength comes from the spread of the host rates beyond
    what binomial sampling alone gives (method of moments, hosts weighted by rows). A host with few rows keeps close
    to the mean; one with many speaks for itself. A host of any size passes unless its posterior mean by some rule, less
    `sure` of the posterior's standard deviations, is above `rate`, so few rows need a clearer rate than many. host_rate is
    the largest posterior mean.
    """
    named = ["base_failed", *[c for c in measured.columns if c.startswith("rule_")]]
    failed = {c: f"host_{c.removeprefix('base_')}" for c in named}
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).alias("host_rows"), *[F.sum(F.col(c).cast("long")).alias(k) for c, k in failed.items()])
    n = F.col("host_rows").cast("double")
    sums = [F.sum(n).alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(n * n).alias("nn")]
    for k in failed.values():
        sums += [F.sum(F.col(k).cast("double")).alias(f"k_{k}"), F.sum(F.col(k).cast("double") * F.col(k) / n).alias(f"kk_{k}")]
    seen = hosts.agg(*sums).first()
    rates, fine = [], F.lit(True)
    for k in failed.values():
        mean, strength = _prior(seen["n"], seen[f"k_{k}"], seen[f"kk_{k}"], seen["nn"], seen["hosts"])
        posterior = (F.col(k) + F.lit(mean * strength)) / (F.col("host_rows") + F.lit(strength))
        spread = F.sqrt(posterior * (1 - posterior) / (F.col("host_rows") + F.lit(strength + 1)))
        rates.append(posterior)
        fine &= posterior - sure * spread <= rate
    most = F.greatest(*rates) if len(rates) > 1 else rates[0]
    return hosts.select("source", "host_rows", "host_failed", most.alias("host_rate"), fine.alias("host_ok"))


def quality_rules(docs: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """The measures of each row of docs (doc_id, text, source), with host_rate and kept.

    kept is false if the row fails by itself, else its host's verdict by base_failed and the further `rules`. The measures
    are computed once, into a table in the shared folder. Hosts may be many, and one may hold a third of all rows: rows look
    theirs up by `looked_up`. Rows without a source are one host. Very long texts are measured whole. An empty table gives
    an empty result; extra columns are ignored.
    """
    measured = table(measures(docs), "quality")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # null isn't the empty name
    hosts = table(host_verdicts(rules(measured), rate).select(key.alias("_h"), "host_rows", "host_rate", "host_ok"), "hosts")
    found = looked_up(measured.withColumn("_h", key), hosts, ["_h"], "host_rows", F.col("doc_id"))
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("_h", "host_rows", "host_ok")
